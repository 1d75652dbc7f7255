"""Quoted records over the borders of splits, against Python's own CSV reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from sievetable.sources import delimited, records


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "311")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def made(seed: int, rows: int, end: str) -> tuple[str, list[list[str]]]:
    rng = random.Random(seed)
    pieces = ["a", "é", ",", '"', "\n", "\r\n", " ", "\n\n", '""', "x" * 40, "1"]
    cells = [["id", "text", "more"]]
    for i in range(rows):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        cells.append([str(i), text, rng.choice(["", "z", "\n", '"'])])
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(cells)
    return out.getvalue(), cells[1:]


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n"), (4, "\n")])
def test_records_over_splits(spark, tmp_path, small_splits, seed, end):
    text, cells = made(seed, 120, end)
    other, more = made(seed + 10, 40, end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes(other.encode())
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    assert delimited.layout(spark, path, "utf-8") == delimited.RECORDS
    rows = delimited.read_delimited(spark, path).collect()
    assert sorted([x or "" for x in row] for row in rows) == sorted(cells + more)
    found = delimited.data_records(spark, path, ",", "UTF-8").collect()
    numbers = {name: sorted(r.number for r in found if r.file.endswith(name)) for name in ("a.csv", "b.csv")}
    assert numbers == {"a.csv": list(range(1, 121)), "b.csv": list(range(1, 41))}


def test_types_widths_and_rows_of_records(spark, tmp_path, small_splits):
    lines = ["id,note,day"] + [f'{i},"line\n{i} ""q"" {"long " * 9}",2024-01-{i % 28 + 1:02d}' for i in range(50)]
    path = tmp_path / "typed.csv"
    path.write_text("\n".join(lines) + "\n\n\n")
    typed = delimited.read_typed(spark, str(path))
    assert [t for _, t in typed.dtypes] == ["int", "string", "date"] and typed.count() == 50
    path.write_text("\n".join([*lines[:31], '"x\ny"', *lines[31:], "7,=1,a,b"]) + "\n")
    found = delimited.validate_delimited(spark, str(path)).collect()
    widths = [(r.row, r.occurrences) for r in found if r.code == "INCONSISTENT_COLUMN_COUNT"]
    assert widths == [(32, 2)]
    assert [r.row for r in found if r.code == "FORMULA_LIKE_VALUE"] == [53]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        delimited.read_delimited(spark, str(path)).collect()
    assert delimited.read_delimited(spark, str(path), relaxed=True).count() == 52


def test_other_encodings_and_a_quote_that_never_closes(spark, tmp_path, small_splits):
    path = tmp_path / "latin.csv"
    path.write_bytes('id;ö\n1;"ä\nü"\n2;ß\n'.encode("latin-1"))
    rows = delimited.read_delimited(spark, str(path), ";", encoding="ISO-8859-1").collect()
    assert sorted(map(tuple, rows)) == [("1", "ä\nü"), ("2", "ß")] and rows[0].__fields__ == ["id", "ö"]
    path.write_text('id,t\n1,"open' + "\nmore, lines" * 60)
    found = delimited.data_records(spark, str(path), ",", "UTF-8").collect()
    assert len(found) == 1 and found[0].value.count("\n") == 60


@pytest.mark.parametrize(
    "line, inside, after",
    [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('a"b,c', False, False), ('x""y', True, True),
     ('x"" ",","', True, False), ("", True, True), ("", False, False), ('"a"b,"', False, True), ('"a""', False, True)],
)
def test_the_state_a_line_leaves(line, inside, after):
    assert records.open_after(line.encode(), b",", inside) == after
