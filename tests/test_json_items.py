"""Items of JSON arrays over the borders of splits, against Python's own JSON reader."""

from __future__ import annotations

import json
import random

import pytest

from sievetable.errors import DataError
from sievetable.sources import json_docs, json_items, tables


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def made(seed: int, rows: int) -> list:
    rng = random.Random(seed)
    pieces = ["a", "é", ",", '"', "\n", "\\", "[", "]", "{", "}", "\\\\", '\\"', "x" * 50, ",,,"]

    def value(depth: int):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        if kind == 2:
            return rng.choice([None, True, 17, -2.5])
        if kind < 5:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(pieces) + str(i): value(depth + 1) for i in range(rng.randrange(4))}

    return [value(0) for _ in range(rows)]


@pytest.mark.parametrize("seed, indent", [(1, None), (2, 1), (3, None), (4, 3)])
def test_items_over_splits(spark, tmp_path, small_splits, seed, indent):
    wanted = {"a.json": made(seed, 40), "b.json": made(seed + 10, 15), "c.json": [], "d.json": {"k": made(seed, 9)}}
    for name, data in wanted.items():
        space = "﻿ \n" if seed == 2 else ""
        (tmp_path / name).write_text(space + json.dumps(data, indent=indent, ensure_ascii=seed == 3), encoding="utf-8")
    text = json_items.stretches(spark, str(tmp_path))
    assert text.select("file", "split").distinct().count() > 6
    found = json_items.read_items(spark, str(tmp_path))
    assert found.faults.count() == 0 and not found.wide
    read = {}
    for row in found.items.collect():
        read.setdefault(row.path.rsplit("/", 1)[1], {})[row.number] = json.loads(row.value)
    assert read.pop("d.json") == {0: wanted.pop("d.json")}
    assert "c.json" not in read and not wanted.pop("c.json")
    assert read == {name: dict(enumerate(data)) for name, data in wanted.items()}


FAULTY = ["[1, 2", "[1,]", "[,1]", "[1,,2]", "[1] x", "[1][2]", "[1],[2]", "[1]]", '["a\nb"]', '["a]', "[{]}", "[1 2]", '{"a":', "1 2"]


def test_faulty_documents(spark, tmp_path):
    for i, text in enumerate(FAULTY):
        (tmp_path / f"{i}.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"a":1},{"a":2}]')
    for i in (0, 10, 13):
        with pytest.raises(DataError) as raised:
            json_docs.read_json_document(spark, str(tmp_path / f"{i}.json"))
        assert raised.value.code == "INVALID_JSON"
    issues = tables.validate_json_document(spark, str(tmp_path)).filter("code = 'PARSE_ERROR'").collect()
    assert [(i.row, i.occurrences) for i in issues] == [(None, len(FAULTY))]


def test_read_document(spark, tmp_path, small_splits):
    rows = [{"id": i, "text": "[,]" * (i % 20), "more": {"a": [i, i + 1]}} for i in range(100)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    table = json_docs.read_json_document(spark, str(tmp_path))
    assert table.columns == ["id", "more", "text"]
    assert sorted((r.id, r.text, list(r.more.a)) for r in table.collect()) == [
        (r["id"], r["text"], r["more"]["a"]) for r in rows
    ]
    numbered = json_items.read_items(spark, str(tmp_path)).items
    assert sorted((r.number, json.loads(r.value)["id"]) for r in numbered.collect()) == [(i, i) for i in range(100)]


def test_wide_and_mixed_documents(spark, tmp_path):
    (tmp_path / "w.json").write_text('[{"id":1},{"id":2}]', encoding="utf-16")
    assert sorted(r.id for r in json_docs.read_json_document(spark, str(tmp_path / "w.json")).collect()) == [1, 2]
    (tmp_path / "m.json").write_text('[{"id":1}, 5, "x"]')
    mixed = json_docs.read_json_document(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r.id or 0, r.value or "") for r in mixed) == [(0, "5"), (0, "x"), (1, "")]
    (tmp_path / "e.json").write_text(" [ ] ")
    assert json_docs.read_json_document(spark, str(tmp_path / "e.json")).count() == 0
