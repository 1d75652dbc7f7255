"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetable.llm.shared import written


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    large = (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        .distinct()
    )
    lower = large.groupBy("a").agg(F.min("b").alias("least"))
    below = large.join(lower, "a").where(F.col("b") != F.col("least"))
    return below.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
        lower.select("a", F.col("least").alias("b"))
    ).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): the smallest node it reaches.

    Loops and repeated edges change nothing. Each round is a written table, so a lost
    executor costs one round; a node's many edges are counted down before they are
    shuffled, and the joins are left to adaptive execution.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = written(ordered.distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        now = written(star_round(now), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
