"""Cubes: names, decoding, cell grammar, periods, and PC-Axis files."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.functions.periods import any_period_ordinal, period_count, period_ordinal
from sievetable.operators import cube
from sievetable.sources import cube_files

PLACES = '''CHARSET="ANSI";
AXIS-VERSION="2000";
CODEPAGE="windows-1250";
MATRIX="m1";
TITLE="Part one "
"and ""two""";
DECIMALS=1;
STUB="Kraj";
HEADING="Leto";
VALUES("Kraj")="Črnomelj","Novo
   mesto";
CODES("Kraj")="001","002";
VALUES("Leto")="2024","2025";
CODES("Leto")="2024","2025";
TIMEVAL("Leto")=TLIST(A1),"2024","2025";
STUB[en]="Place";
VALUES[en]("Place")="Crnomelj","Novo mesto";
DATASYMBOL1="confidential";
NOTE("Kraj")="One; note = ""quoted"".";
DATA=
0 "-" 1.5
".";
'''


def files(spark, *texts, encoding="cp1250"):
    rows = [(f"f{i}", bytearray(t.encode(encoding))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "cube string, content binary")


def long_rows(spark, frame):
    dimensions = cube_files.dimensions(cube_files.statements(frame))
    cells = cube.decode(cube_files.cell_chunks(frame).drop("error"), dimensions)
    return cells.orderBy("cube", "index").collect()


def test_two_dimensions_in_windows_1250(spark):
    rows = long_rows(spark, files(spark, PLACES))
    assert [(r.labels, r.codes, r.value, r.value__symbol) for r in rows] == [
        (["Črnomelj", "2024"], ["001", "2024"], 0.0, None),
        (["Črnomelj", "2025"], ["001", "2025"], None, "-"),
        (["Novo mesto", "2024"], ["002", "2024"], 1.5, None),
        (["Novo mesto", "2025"], ["002", "2025"], None, "."),
    ]


def test_metadata_of_a_file(spark):
    rows = cube_files.statements(files(spark, PLACES))
    scalars = cube_files.scalars(rows).first()
    assert (scalars.matrix, scalars.title, scalars.decimals) == ("m1", 'Part one and "two"', "1")
    assert cube_files.symbol_names(rows).first().name == "confidential"
    assert cube_files.notes(rows).first().value == 'One; note = "quoted".'
    assert cube_files.metadata_problems(rows).collect() == []


@pytest.mark.parametrize(
    ("damage", "code"),
    [
        (lambda t: t.replace('"001","002"', '"001"'), "INVALID_PCAXIS_DATA"),
        (lambda t: t.replace('CODEPAGE="windows-1250"', 'CODEPAGE="latin1"'), "PCAXIS_ENCODING_UNSUPPORTED"),
        (lambda t: t.replace("DATA=", 'KEYS("Kraj")="VALUES";\nDATA='), "PCAXIS_KEYS_UNSUPPORTED"),
        (lambda t: t.replace('STUB[en]="Place"', 'STUB[en]="Place","More"'), "INVALID_PCAXIS_DATA"),
        (lambda t: t.replace("DECIMALS=1", "DECIMALS=16"), "INVALID_PCAXIS_DATA"),
        (lambda t: t.replace('TLIST(A1),"2024","2025"', 'TLIST(A1,"2024"-"2026")'), "INVALID_PCAXIS_DATA"),
        (lambda t: t.replace("DATA=", "DATB="), "INVALID_PCAXIS_DATA"),
        (lambda t: t.replace('MATRIX="m1";', ""), "INVALID_PCAXIS_DATA"),
        (lambda t: t.replace('HEADING="Leto"', 'HEADING="Kraj"'), "INVALID_PCAXIS_DATA"),
    ],
)
def test_damaged_files_are_rows(spark, damage, code):
    found = cube_files.metadata_problems(cube_files.statements(files(spark, damage(PLACES)))).collect()
    assert {r.code for r in found} == {code}


def test_compact_time_range_fits(spark):
    text = PLACES.replace('TLIST(A1),"2024","2025"', 'TLIST(A1,"2024"-"2025")')
    rows = cube_files.statements(files(spark, text))
    assert cube_files.metadata_problems(rows).collect() == []


def test_short_cube_is_found(spark):
    frame = files(spark, PLACES.replace("0 ", ""))
    dimensions = cube_files.dimensions(cube_files.statements(frame))
    chunks = cube_files.cell_chunks(frame).drop("error")
    found = cube.cell_counts(chunks, dimensions).first()
    assert (found.expected, found.actual, found.complete) == (4, 3, False)
    with pytest.raises(DataError):
        cube.require_complete(chunks, dimensions)


def test_column_names_do_not_collide():
    bindings = cube.column_bindings(
        [("Region", True), ("region", False), ("VALUE", True), ("value__symbol", False), (" ", False), ("Region__CODE", False)]
    )
    assert [(b.label, b.code) for b in bindings] == [
        ("Region", "Region__code"),
        ("region__2", None),
        ("VALUE__2", "VALUE__2__code"),
        ("value__symbol__2", None),
        ("dimension", None),
        ("Region__CODE__2", None),
    ]


def test_cell_grammar(spark):
    tokens = {
        '"-"': (None, "-"),
        '"......"': (None, "......"),
        '"......."': (None, None),
        "-": (None, None),
        '"1"': (None, None),
        "1.": (1.0, None),
        "-.5e2": (-50.0, None),
        "1e400": (None, None),
        "NaN": (None, None),
        "x": (None, None),
    }
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    found = frame.select("t", cube.cell_value(F.col("t")), cube.cell_symbol(F.col("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == tokens


def test_many_small_chunks_rebuild_the_cube(spark):
    sizes = (3, 4, 5)
    dims = [
        ("c", d + 1, f"d{d}", p, f"{d}-{p}", None) for d, size in enumerate(sizes) for p in range(size)
    ]
    dimensions = spark.createDataFrame(
        dims, "cube string, dimension int, name string, position int, label string, code string"
    )
    chunks = spark.createDataFrame(
        [("c", base, [str(i) for i in range(base, min(base + 7, 60))]) for base in range(0, 60, 7)],
        "cube string, base bigint, cells array<string>",
    )
    found = {r["index"]: (r.labels, r.value) for r in cube.decode(chunks, dimensions).collect()}
    expected = {}
    for i in range(60):
        a, b, c = i // 20, i // 5 % 4, i % 5
        expected[i] = ([f"0-{a}", f"1-{b}", f"2-{c}"], float(i))
    assert found == expected
    head = cube.decode(cube.prefix(chunks, 10), dimensions)
    assert sorted(r["index"] for r in head.collect()) == list(range(10))


def test_huge_shape_has_no_expected_size(spark):
    dims = [("c", d, f"d{d}", p, "x", None) for d in range(1, 5) for p in range(200)]
    dimensions = spark.createDataFrame(
        dims, "cube string, dimension int, name string, position int, label string, code string"
    )
    assert cube.shapes(dimensions).first().expected is None
    assert cube.shapes(dimensions, max_cells=None).first().expected == 200**4


def test_periods_against_calendar(spark):
    days = [datetime.date(1998, 1, 1) + datetime.timedelta(days=i) for i in range(0, 12000, 3)]
    rows = [
        (d.strftime("%Y%m%d"), f"{d.isocalendar()[0]}W{d.isocalendar()[1]:02d}", (d - datetime.date(1970, 1, 1)).days)
        for d in days
    ]
    frame = spark.createDataFrame(rows, "day string, week string, n int")
    found = frame.select(
        "n", period_ordinal(F.col("day"), "D").alias("d"), period_ordinal(F.col("week"), "W").alias("w")
    )
    for r in found.collect():
        assert r.d == r.n
        assert r.w == (r.n - (r.n + 3) % 7) // 7


@pytest.mark.parametrize(
    ("scale", "text", "ordinal"),
    [
        ("A", "2024", 2024),
        ("H", "2024H2", 4049),
        ("H", "20242", 4049),
        ("Q", "2024q3", 8098),
        ("M", "2024M12", 24299),
        ("M", "202413", None),
        ("W", "2021W53", None),
        ("W", "2020W53", 2660),
        ("D", "20240230", None),
        ("A", "24", None),
        ("X", "2024", None),
    ],
)
def test_period_forms(spark, scale, text, ordinal):
    frame = spark.createDataFrame([(text, scale)], "t string, s string")
    assert frame.select(any_period_ordinal(F.col("t"), F.col("s"))).first()[0] == ordinal


def test_period_range(spark):
    frame = spark.range(1)
    count = frame.select(
        period_count(F.lit("2020M11"), F.lit("2021M02"), "M"), period_count(F.lit("2021"), F.lit("2020"), "A")
    ).first()
    assert tuple(count) == (4, None)


def test_labels_by_page_equal_labels_by_row(spark, monkeypatch):
    monkeypatch.setattr(cube, "PAGE", 4)
    sizes = {"a": [3, 11, 5], "b": [13], "c": [2, 9]}
    dimensions = spark.createDataFrame(
        [
            (name, 10 * (d + 1), f"d{d}", p, f"{name}{d}:{p}", None if d else f"{p:03}")
            for name, shape in sizes.items()
            for d, size in enumerate(shape)
            for p in range(size)
        ],
        "cube string, dimension int, name string, position bigint, label string, code string",
    )
    chunks = []
    for name, shape in sizes.items():
        total, base = 1, 0
        for size in shape:
            total *= size
        for step in [1, 7, 40, 2, 13] * 20:
            cells = [str(i) for i in range(base, min(base + step, total))]
            if cells:
                chunks.append((name, base, cells))
            base += step
    chunks = spark.createDataFrame(chunks, "cube string, base bigint, cells array<string>")
    paged = cube.decode(chunks, dimensions, labels_in_row=0)
    by_row = cube.decode(chunks, dimensions)
    assert paged.count() == by_row.count() == 3 * 11 * 5 + 13 + 18
    assert paged.exceptAll(by_row).count() == 0
