"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from workload import files, paths, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def shown(value):
    if isinstance(value, float):
        return f"{value:.9g}" if math.isfinite(value) else str(value)
    return str(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert normalized(frame.columns, rows) == normalized(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(registry.ORACLE) == set(registry.QUERIES)


def test_xml_files_grow_with_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch", lambda spark: str(tmp_path / "x"))
    suppliers = spark.read.parquet(f"{FOLDER}/supplier.parquet").count()
    assert 1 < suppliers == registry.QUERIES["xml_native_rows"](spark, FOLDER).count()
    assert len(list((tmp_path / "x").rglob("part-*.txt"))) == 1


@pytest.mark.parametrize(
    "name, part, least",
    [
        ("json_array_splits", 40_000, 9),
        ("csv_multiline_splits", 20_000, 3),
        ("csv_multiline_roundtrip", 20_000, 4),
        ("csv_multiline_validate", 20_000, 4),
        ("open_ndjson_large", 20_000, 4),
        ("json_parse_errors", 20_000, 4),
        ("ndjson_validate", 2_000, 5),
    ],
)
def test_a_larger_table_is_written_to_more_files(spark, duck, tmp_path, monkeypatch, name, part, least):
    monkeypatch.setattr(paths, "PART_BYTES", part)
    monkeypatch.setattr(paths, "SPLIT_BYTES", (8_000, 8_000))
    monkeypatch.setattr(paths, "scratch", lambda spark: str(tmp_path / "x"))
    test_query(spark, duck, name)
    assert len(list((tmp_path / "x").rglob("part-*"))) >= least


def test_texts_stay_out_of_the_archives_tasks(spark):
    plan = files.document_archives(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas build(doc_id" in plan and ", text#" not in plan.split("Relation")[0].split("Project")[0]
