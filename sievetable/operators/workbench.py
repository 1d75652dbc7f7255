"""Ready-made analysis queries: coverage, latest, top, change, gaps, shape."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievetable.functions import cells
from sievetable.operators.ordering import (
    EDGE_CHARACTERS,
    expand_counts,
    range_count,
    running_total,
    with_previous,
    with_row_numbers,
)
from sievetable.plans.staged import kept

# So many values are sorted at last when ranks are looked for.
SELECTION_ROWS = 200_000
SELECTION_ROUNDS = 6
SELECTION_SAMPLE = 10_000


def completeness(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Filled share of each column, over the table or per group.

    One aggregate; the list of columns is turned into rows afterwards.
    """
    counts = [F.count(F.col(cells.quoted(c))).alias(f"n{i}") for i, c in enumerate(columns)]
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *counts)
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("filled"))
            for i, c in enumerate(columns)
        ]
    )
    listed = totals.select(*by, "rows", F.inline(entries))
    share = F.when(F.col("rows") > 0, F.round(F.col("filled") / F.col("rows"), 6))
    return listed.withColumn("share", share)


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of each key's latest row, as an aggregate."""
    position = F.struct(*[F.col(c) for c in at])
    chosen = F.max_by(F.struct(*[F.col(c) for c in [*at, *values]]), position)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*")


def top_categories(df: DataFrame, category: str, k: int, measure: Column | None = None) -> DataFrame:
    """The ``k`` largest categories; ties go to the smaller name."""
    amount = F.count(F.lit(1)) if measure is None else F.sum(measure)
    sized = df.groupBy(category).agg(amount.alias("amount"))
    return sized.orderBy(F.col("amount").desc(), F.col(category).asc()).limit(k)


def period_change(
    df: DataFrame, period: Column, measure: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Total per period, with the change from the period before it in the data.

    Rows are reduced to one per group and period first. Without groups the periods are
    numbered in ranges, so that no task holds all of them.
    """
    totals = df.groupBy(*by, period.alias("period")).agg(measure.alias("amount"))
    if by:
        previous = F.lag("amount").over(Window.partitionBy(*by).orderBy("period"))
        moved = totals.withColumn("previous", previous)
    else:
        numbered = with_row_numbers(kept(totals, "totals"), ["period"], row="place")
        moved = with_previous(numbered, "place", ["amount"]).drop("place")
        moved = moved.withColumnRenamed("previous_amount", "previous")
    return moved.withColumn("change", F.col("amount") - F.col("previous"))


def missing_periods(df: DataFrame, ordinal: Column, by: Sequence[str] = ()) -> DataFrame:
    """Period ordinals absent between a group's first and last.

    Each period looks at the one before it, in ranges of periods whose last row is carried
    over to the next range. A gap is an interval, and is cut into pieces that are spread
    over the tasks before it is expanded.
    """
    gaps = period_gaps(df, ordinal, by)
    return expand_counts(gaps, "periods", index="step").select(
        *by, (F.col("first") + F.col("step")).alias("ordinal")
    )


def period_gaps(df: DataFrame, ordinal: Column, by: Sequence[str] = ()) -> DataFrame:
    """Intervals of absent periods between a group's first and last: first, periods."""
    seen = kept(df.select(*by, ordinal.cast("bigint").alias("ordinal")).filter("ordinal IS NOT NULL").distinct(), "periods")
    numbered = with_row_numbers(seen, [*by, "ordinal"], row="place")
    behind = with_previous(numbered, "place", ["ordinal"], within=by)
    return behind.select(
        *by,
        (F.col("previous_ordinal") + 1).alias("first"),
        (F.col("ordinal") - F.col("previous_ordinal") - 1).alias("periods"),
    ).filter("periods > 0")


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; bin 0 takes values below ``low``, the last one those past its edge."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(bins), F.floor((F.col(value) - low) / width) + 1))
    binned = df.filter(F.col(value).isNotNull()).select(bin_of.cast("int").alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))


class Edge(NamedTuple):
    """A value that rows were compared with: how many are smaller, and how many are not larger."""

    value: object
    below: int
    up_to: int


def quantile_table(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """Exact quantiles (the smallest value at or above each share of the rows).

    Sampled values near each wanted rank are edges. One aggregate counts the rows below and
    up to each edge, so a rank is at an edge or between two of them, and only rows between
    these are sampled next, until few are left to sort. The driver gets the sample and two
    counts for each edge.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    data_type = rows.schema["v"].dataType
    total = rows.count()
    ranks = {share: max(1, math.ceil(share * total)) for share in shares}
    edges: list[Edge] = []
    left = None
    for _ in range(SELECTION_ROUNDS):
        spans = _spans(edges, ranks.values(), total)
        open_rows = sum(n for (_, equal), (_, n) in spans.items() if not equal)
        if open_rows <= SELECTION_ROWS or open_rows == left:
            break
        left = open_rows
        found = _counted_edges(rows, _sampled_edges(rows, edges, spans, ranks.values(), left, data_type), data_type)
        edges = sorted({*edges, *found}, key=lambda e: (e.below, e.up_to))
    spans = _spans(edges, ranks.values(), total)
    held = _in_span(edges, spans, data_type).cast("bigint")
    counted = rows.withColumn("before", held).filter("before IS NOT NULL")
    counted = counted.groupBy("before", "v").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("before").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    up_to = F.col("before") + F.coalesce(F.sum("copies").over(order), F.lit(0))
    listed = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(r).cast("bigint").alias("rank")) for s, r in ranks.items()])
    placed = counted.withColumn("low", up_to).withColumn("share", F.explode(listed))
    wanted = (F.col("share.rank") > F.col("low")) & (F.col("share.rank") <= F.col("low") + F.col("copies"))
    return placed.filter(wanted).select("share.share", F.col("v").alias("quantile"))


def _spans(edges: list[Edge], ranks: Iterable[int], total: int) -> dict[tuple[int, bool], tuple[int, int]]:
    """Where ranks are: (place of the edge behind, whether the rank is at that edge) to (rows before, rows)."""
    spans = {}
    for rank in ranks:
        place = next((i for i, e in enumerate(edges) if rank <= e.up_to), len(edges))
        before = edges[place - 1].up_to if place else 0
        if place < len(edges) and rank > edges[place].below:
            spans[place, True] = edges[place].below, edges[place].up_to - edges[place].below
        else:
            after = edges[place].below if place < len(edges) else total
            spans[place, False] = before, after - before
    return spans


def _in_span(edges: list[Edge], spans: dict[tuple[int, bool], tuple[int, int]], data_type: T.DataType) -> Column:
    """The rows before a value's span; null for values of no span."""
    found = F.lit(None)
    for (place, equal), (before, _) in spans.items():
        inside = F.lit(True)
        if equal:
            inside = F.col("v") == F.lit(edges[place].value).cast(data_type)
        else:
            if place:
                inside = inside & (F.col("v") > F.lit(edges[place - 1].value).cast(data_type))
            if place < len(edges):
                inside = inside & (F.col("v") < F.lit(edges[place].value).cast(data_type))
        found = F.when(inside, F.lit(before)).otherwise(found)
    return found


def _sampled_edges(
    rows: DataFrame,
    edges: list[Edge],
    spans: dict[tuple[int, bool], tuple[int, int]],
    ranks: Iterable[int],
    left: int,
    data_type: T.DataType,
) -> list:
    """Two sampled values about each rank that is still between edges, four deviations apart at either side."""
    wanted = SELECTION_SAMPLE + 32 * range_count(rows, left)
    open_spans = {key: span for key, span in spans.items() if not key[1]}
    inside = rows.withColumn("before", _in_span(edges, open_spans, data_type).cast("bigint")).filter("before IS NOT NULL")
    if left > wanted:
        inside = inside.sample(fraction=wanted / left, seed=17)
    cut = F.col("v")
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        cut = F.substring("v", 1, EDGE_CHARACTERS)
    sampled = inside.groupBy("before").agg(F.array_sort(F.collect_list(cut)).alias("v"))
    sizes = {before: n for before, n in open_spans.values()}
    found = []
    for before, values in sampled.collect():
        places = set()
        for rank in ranks:
            if not before < rank <= before + sizes[before]:
                continue
            share = (rank - before) / sizes[before]
            spread = 4 * math.sqrt(len(values) * share * (1 - share)) + 2
            low, high = math.floor(share * len(values) - spread), math.ceil(share * len(values) + spread)
            places |= {p for p in (low, high) if 0 <= p < len(values)}
        found += [values[p] for p in sorted(places or {0})]
    return found


def _counted_edges(rows: DataFrame, values: list, data_type: T.DataType) -> list[Edge]:
    """Rows below and up to each value, in one pass."""
    if not values:
        return []
    counts = []
    for value in values:
        edge = F.lit(value).cast(data_type)
        counts += [F.count_if(F.col("v") < edge), F.count_if(F.col("v") <= edge)]
    row = rows.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first()
    return [Edge(value, row[2 * i], row[2 * i + 1]) for i, value in enumerate(values)]


def heat_map(df: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of two categories as a table with the given columns."""
    counts = [F.count(F.when(F.col(column) == c, True)).alias(c) for c in columns]
    return df.groupBy(row).agg(*counts)


def paired_values(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both values are present."""
    return df.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def ranked(df: DataFrame, category: str, amount: str) -> DataFrame:
    """Every category with its rank by amount, without a single-task window."""
    placed = running_total(df, [-F.col(amount), F.col(category)], before="rank")
    return placed.withColumn("rank", F.col("rank") + 1)
