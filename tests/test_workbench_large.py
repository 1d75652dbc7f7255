"""Gaps, quantiles, changes and offsets in the forms that large tables take."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sievetable.operators import ordering, presentation, workbench
from sievetable.sources import positions
from workload import tables


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_missing_periods(spark, monkeypatch, by, chunk):
    plain = ordering.expand_counts
    monkeypatch.setattr(workbench, "expand_counts", lambda df, count, index: plain(df, count, index=index, chunk=chunk))
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(60), rng.randrange(300), None])) for _ in range(90)]
    df = spark.createDataFrame([*rows, ("z", 5)], "g string, p int")
    got = {tuple(r) for r in workbench.missing_periods(df, F.col("p"), by=by).collect()}
    expected = set()
    for group in {r[0] for r in rows} if by else [None]:
        seen = {p for g, p in [*rows, ("z", 5)] if p is not None and (not by or g == group)}
        expected |= {(group, p) if by else (p,) for p in range(min(seen), max(seen)) if p not in seen}
    assert got == expected


def test_a_long_gap_is_expanded_by_many_tasks(spark):
    df = spark.createDataFrame([(0,), (3_000_000,)], "p long")
    absent = workbench.missing_periods(df, F.col("p"))
    tasks = absent.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("ordinal")).collect()
    assert len(tasks) > 1 and sum(t[1] for t in tasks) == 2_999_999
    assert sum(t[2] for t in tasks) == 3_000_000 * 2_999_999 // 2


@pytest.mark.parametrize("rows, ranges", [(200_000, 1), (40, 6), (5, 2)])
def test_quantiles_by_counting(spark, monkeypatch, rows, ranges):
    monkeypatch.setattr(workbench, "SELECTION_ROWS", rows)
    monkeypatch.setattr(workbench, "range_count", lambda df, n: ranges)
    rng = random.Random(2)
    values = [rng.choice([rng.random() * 100, 7.5, 7.5, -3.0, math.nan, None]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.5001, 0.9, 1.0]
    got = {r.share: r.quantile for r in workbench.quantile_table(df, "v", shares).collect()}
    there = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    expected = {s: there[max(1, math.ceil(s * len(there))) - 1] for s in shares}
    assert str(sorted(got.items())) == str(sorted(expected.items()))


def test_quantiles_of_equal_values_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(workbench, "SELECTION_ROWS", 3)
    same = spark.createDataFrame([("x",)] * 50, "v string")
    assert [tuple(r) for r in workbench.quantile_table(same, "v", [0.5]).collect()] == [(0.5, "x")]
    assert workbench.quantile_table(same.filter("v = 'y'"), "v", [0.5]).count() == 0


def test_change_without_groups(spark):
    df = spark.createDataFrame([(p, n) for p in range(50) for n in range(p % 7 + 1)], "p int, n int")
    moved = workbench.period_change(df, F.col("p"), F.count("*"))
    assert "SinglePartition" not in moved._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, moved.select("period", "amount", "previous", "change").collect()))
    amounts = [p % 7 + 1 for p in range(50)]
    assert got == [
        (p, a, amounts[p - 1] if p else None, a - amounts[p - 1] if p else None) for p, a in enumerate(amounts)
    ]


def test_offsets_of_many_pieces(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3000).repartition(60).selectExpr("cast(id AS string) AS value").write.text(path)
    plain = {r.value: r.row for r in positions.number_text_rows(spark.read.text(path)).collect()}
    monkeypatch.setattr(positions, "WINDOW_PIECES", 2)
    levels = {r.value: r.row for r in positions.number_text_rows(spark.read.text(path)).collect()}
    assert plain == levels and sorted(levels.values()) == list(range(2, 3002))


@pytest.mark.parametrize("kind", ["double", "string", "bigint"])
def test_quantiles_need_no_ranges_of_every_row(spark, monkeypatch, kind):
    monkeypatch.setattr(workbench, "SELECTION_ROWS", 50)
    monkeypatch.setattr(workbench, "SELECTION_SAMPLE", 100)
    monkeypatch.setattr(workbench, "range_count", lambda df, n: 1)
    scans = []
    plain = workbench._counted_edges
    monkeypatch.setattr(workbench, "_counted_edges", lambda *a: scans.append(a[1]) or plain(*a))
    df = spark.range(40_000, numPartitions=5).select((F.xxhash64("id") % 9_000).cast(kind).alias("v"))
    df = df.withColumn("v", F.when(F.rand(3) < 0.3, F.lit(77).cast(kind)).otherwise(F.col("v"))).cache()
    shares = [0.0, 0.3, 0.5, 0.51, 0.97, 1.0]
    table = workbench.quantile_table(df, "v", shares)
    there = sorted(r.v for r in df.collect())
    expected = {s: there[max(1, math.ceil(s * len(there))) - 1] for s in shares}
    assert {r.share: r.quantile for r in table.collect()} == expected
    assert 1 < len(scans) <= workbench.SELECTION_ROUNDS
    # compared with a few values in the plan, not with a range for each row
    assert "lambda" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_chain_is_looked_at_once(spark):
    steps = [("a", 0, "f", 9, 5), ("a", 1, "f", 4, 4), ("b", 0, " ", 7, 3), ("c", 0, "f", 5, 2), ("c", 1, "f", 2, 1)]
    reductions = spark.createDataFrame(steps, "presentation string, step int, method string, original_rows long, presented_rows long")
    totals = spark.createDataFrame(
        [("a", 8, 4), ("b", 7, 3), ("c", 5, 1), ("d", 5, 4), ("e", 5, 5)],
        "presentation string, original_rows long, presented_rows long",
    )
    found = presentation.chain_problems(reductions, totals)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(
        map(str, [("a", 1, "CHAIN_BROKEN"), ("a", 1, "NOT_A_REDUCTION"), ("b", 0, "NOT_A_REDUCTION"),
                  ("a", None, "TOTALS_DISAGREE"), ("d", None, "REDUCTION_UNDISCLOSED")])
    )
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_chain_has_as_many_tasks_as_its_lines_need(spark, tmp_path, monkeypatch):
    lines = spark.range(4_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"))
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(tables, "LINES_PER_TASK", 100)
    found = tables.present_chain(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("l_orderkey" in x and ", 40), REPARTITION_BY_NUM" in x for x in exchanges)
    broken = sorted(r.presentation for r in found.where("problem = 'CHAIN_BROKEN'").collect())
    assert broken == [i for i in range(1_000) if i % 7 == 0 or i % 11 == 0]
