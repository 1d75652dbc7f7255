"""Validation on small fixtures, on skewed data and against brute force."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.operators import inference, ordering, quality


def issue_set(frame):
    columns = ["code", "row", "field", "occurrences"]
    return {tuple(r) for r in frame.select(*columns).collect()}


def test_dates_and_formulas_per_cell(spark):
    rows = [(1, "2026-01-01", "=2+2"), (2, "2026-99-99", "+cmd"), (3, "2026-01-03", "-1"), (4, "2026-01-04", "@S")]
    frame = spark.createDataFrame(rows, "k int, date string, value string")
    found = issue_set(quality.validate(frame, ["k"], per_cell=True))
    assert ("INVALID_DATE", 3, "date", 1) in found
    assert {f for f in found if f[0] == "FORMULA_LIKE_VALUE"} == {
        ("FORMULA_LIKE_VALUE", row, "value", 1) for row in (2, 3, 4, 5)
    }


def test_repeated_issue_is_grouped(spark):
    frame = spark.range(100).select("id", F.lit("=x").alias("value"), F.lit("2026-99-99").alias("date"))
    found = issue_set(quality.validate(frame, ["id"], columns=["id", "value", "date"]))
    assert ("FORMULA_LIKE_VALUE", 2, "value", 100) in found
    assert ("INVALID_DATE", 2, "date", 100) in found


def test_defects_late_in_a_large_table(spark):
    late = F.when(F.col("id") == 1000, "2026-02-31").otherwise("2026-02-01")
    sparse = F.when(F.col("id") % 3 == 0, "x")
    frame = spark.range(1101).select("id", late.alias("date"), sparse.alias("mostly"))
    found = issue_set(quality.validate(frame, ["id"]))
    assert found == {
        ("INVALID_DATE", 1002, "date", 1),
        ("MIXED_TYPES", None, "date", 1),
        ("NULL_HEAVY_COLUMN", None, "mostly", 1),
    }


def test_integer_beside_double_is_not_mixed(spark):
    frame = spark.createDataFrame([("1",), ("1.5",), ("",), (None,)], "a string")
    stats = quality.column_stats(frame).first()
    assert (stats.rows, stats.non_null, stats.types, stats.mixed, stats.null_heavy) == (
        4,
        2,
        "double,integer",
        False,
        True,
    )


def test_empty_table(spark):
    frame = spark.createDataFrame([], "a string, b int")
    assert quality.validate(frame, ["b"]).count() == 0
    stats = {r.field: r.rows for r in quality.column_stats(frame).collect()}
    assert stats == {"a": 0, "b": 0}


def test_null_and_empty_text_are_different_rows(spark):
    frame = spark.createDataFrame([("a", None), ("a", ""), ("", "a"), ("a", None)], "x string, y string")
    groups = quality.duplicate_rows(frame, ["x", "y"]).collect()
    assert [g.copies for g in groups] == [2]


def test_fingerprint_has_no_accidental_equals(spark):
    rows = [("1:a", "b"), ("1", "a1:b"), ("a", "1:b"), ("n", None), (None, "n"), ("", "nn")]
    frame = spark.createDataFrame(rows, "x string, y string")
    assert frame.select(quality.fingerprint(frame).alias("f")).distinct().count() == len(rows)


@pytest.mark.parametrize("by_position", [False, True])
def test_duplicates_match_brute_force_with_a_hot_row(spark, by_position):
    # A third of all rows are one row; the rest repeat up to four times.
    value = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 997)
    frame = spark.range(6000).select(value.alias("v"), (F.col("id") + 2).alias("row"))
    rows = frame.collect()
    if by_position:
        found = quality.duplicate_rows(frame, position="row")
        places = {r.row: r.v for r in rows}
    else:
        found = quality.duplicate_rows(frame.select("v"), ["v"])
        places = dict(enumerate(sorted(r.v for r in rows), start=2))
    groups = defaultdict(list)
    for place, v in places.items():
        groups[v].append(place)
    expected = {
        (sorted(p)[0], sorted(p)[1], len(p)) for p in groups.values() if len(p) > 1
    }
    assert {(r.first_row, r.second_row, r.copies) for r in found.collect()} == expected


def test_table_twice_has_every_row_repeated(spark):
    frame = spark.range(50).select("id", (F.col("id") % 7).cast("string").alias("s"))
    twice = frame.union(frame)
    found = quality.validate(twice, ["id"], per_duplicate=True)
    assert found.filter("code = 'DUPLICATE_ROW'").count() == 50


def test_large_group_is_expanded_in_pieces(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 7), ("c", 25)], "g string, n int")
    found = ordering.expand_counts(groups, "n", chunk=10)
    assert {(r.g, r.copy) for r in found.collect()} == {
        *{("a", i) for i in range(1)},
        *{("b", i) for i in range(7)},
        *{("c", i) for i in range(25)},
    }


@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_row_numbers_over_ranges(spark, ranges):
    key = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") * 7919 % 5003)
    frame = spark.range(3000).select(key.alias("k"), F.concat(F.lit("s"), "id").alias("s"))
    numbered = ordering.with_row_numbers(frame, ["k", "s"], start=0, ranges=ranges)
    found = [(r.k, r.s) for r in numbered.orderBy("row").collect()]
    assert [r.row for r in numbered.orderBy("row").collect()] == list(range(3000))
    assert found == sorted(found)


def test_row_numbers_with_nulls_and_text_beyond_ascii(spark):
    texts = [None, "", "a", "Z", "é", "中", "\U0001f600", None, "b"] * 40
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    numbered = ordering.with_row_numbers(frame, ["t", "i"], start=0, ranges=7)
    expected = [r.i for r in frame.orderBy("t", "i").collect()]
    assert [r.i for r in numbered.orderBy("row").collect()] == expected


def test_previous_crosses_chunks(spark):
    frame = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    linked = ordering.with_previous(frame, "id", ["v"], chunk=7).orderBy("id").collect()
    assert [r.previous_v for r in linked] == [None, *[i * 2 for i in range(99)]]


def test_limits(spark):
    frame = spark.range(10).select("id", F.lit("x").alias("s"))
    for limits, code in (
        (quality.ValidationLimits(max_columns=1), "VALIDATION_COLUMN_LIMIT"),
        (quality.ValidationLimits(max_records=9), "VALIDATION_RECORD_LIMIT"),
        (quality.ValidationLimits(max_record_bytes=5), "VALIDATION_RECORD_TOO_LARGE"),
        (quality.ValidationLimits(max_total_bytes=20), "VALIDATION_TOTAL_BYTES_LIMIT"),
    ):
        with pytest.raises(DataError) as caught:
            quality.validate(frame, ["id"], limits=limits)
        assert caught.value.code == code


def test_schema_report(spark):
    rows = [
        (1, "true", "1", "1.5", "2026-01-01", "2026-01-01T10:00:00Z", "a"),
        (2, "false", "2", "2", "2026-01-02", "2026-01-02T10:00:00Z", ""),
        (3, "TRUE", "2", ".5", "2026-01-03", "2026-01-03T10:00:00Z", "b"),
    ]
    names = "k int, active string, count string, ratio string, date string, at string, note string"
    frame = spark.createDataFrame(rows, names)
    found = {r.name: (r.type, r.nullable, r.evidence) for r in inference.infer_schema(frame, ["k"]).collect()}
    assert found["active"] == ("boolean", False, ["true", "false", "TRUE"])
    assert found["count"] == ("integer", False, ["1", "2"])
    assert found["ratio"] == ("double", False, ["1.5", "2", ".5"])
    assert found["date"][0] == "date" and found["at"][0] == "timestamp"
    assert found["note"] == ("string", True, ["a", "b"])


def test_null_beyond_the_sample_makes_fields_nullable(spark):
    late = F.when(F.col("id") == 524, F.lit(None)).otherwise(F.lit("x"))
    frame = spark.range(550).select("id", late.alias("late"))
    sampled = {r.name: r.nullable for r in inference.infer_schema(frame, ["id"], sample_rows=inference.SAMPLE_ROWS).collect()}
    whole = {r.name: r.nullable for r in inference.infer_schema(frame, ["id"]).collect()}
    assert sampled == {"id": True, "late": True}
    assert whole == {"id": False, "late": True}


def test_late_evidence_and_code_columns(spark):
    flag = F.when(F.col("id") < 900, "a").otherwise(F.concat(F.lit("z"), (F.col("id") % 2).cast("string")))
    frame = spark.range(1000).select("id", flag.alias("flag"), F.lit("001").alias("code"))
    found = {
        r.name: (r.type, r.evidence)
        for r in inference.infer_schema(frame, ["id"], sample_rows=None, code_columns=["code"]).collect()
    }
    assert found["flag"] == ("string", ["a", "z0", "z1"])
    assert found["code"] == ("string", ["001"])
