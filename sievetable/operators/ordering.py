"""Global row order without a single-task window.

Spark tables have no row order, and one un-partitioned window would put every
row in one task. Here the order is cut into ranges whose edges are literals in
the plan (so a lost task is recomputed with the same edges), each range is
ranked on its own, and the only un-partitioned step runs over one small row
per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RANGES = 4096
ROWS_PER_RANGE = 50_000
_SAMPLES_PER_RANGE = 16
EDGE_CHARACTERS = 64


def range_count(df: DataFrame, rows: int) -> int:
    """Ranges of about 50,000 rows, at most four per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MAX_RANGES, 4 * partitions, rows // ROWS_PER_RANGE))


def sampled_edges(df: DataFrame, key: Column, ranges: int | None = None) -> list:
    """Range edges from about 16 sampled rows per range.

    The key is computed for sampled rows only. The driver receives a number of
    rows set by the number of ranges, whatever the size of the table, and of
    texts their first characters: an edge need not be the key of a row.
    """
    key_type = df.select(key.alias("k")).schema["k"].dataType
    key = F.struct(*[_edge_part(key[f.name], f.dataType).alias(f.name) for f in key_type.fields])
    total = df.count()
    ranges = ranges or range_count(df, total)
    if ranges == 1:
        return []
    wanted = ranges * _SAMPLES_PER_RANGE
    if total > wanted:
        df = df.sample(fraction=wanted / total, seed=17)
    found = df.agg(F.array_sort(F.collect_set(key)).alias("keys")).first()["keys"]
    if len(found) <= ranges:
        return found
    return [found[i * len(found) // ranges] for i in range(1, ranges)]


def _edge_part(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.substring(value, 1, EDGE_CHARACTERS)
    return value


def _key(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])


def range_of(key: Column, edges: list, key_type: T.DataType) -> Column:
    """Number of edges at or below ``key``, by binary search in the plan."""
    if not edges:
        return F.lit(0)
    width = 1
    while width * 2 <= len(edges):
        width *= 2
    steps = []
    while width:
        steps.append(width)
        width //= 2
    literal = F.array(*[_literal(edge, key_type) for edge in edges])

    def step(found: Column, width: Column) -> Column:
        ahead = found + width
        probe = F.element_at(literal, F.least(ahead, F.lit(len(edges))))
        return F.when((ahead <= len(edges)) & (probe <= key), ahead).otherwise(found)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
    # Non-null by form: the join on the range then adds no filter of its own.
    return F.coalesce(found, F.lit(0))


def _literal(value: object, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StructType):
        return F.struct(
            *[_literal(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        )
    return F.lit(value).cast(data_type)


def running_total(
    df: DataFrame,
    order_by: Sequence[Column | str],
    weight: Column | int = 1,
    *,
    before: str = "before",
    ranges: int | None = None,
    sample: tuple[DataFrame, Sequence[Column]] | None = None,
) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over all rows earlier in the order.

    ``order_by`` must be a total order up to rows that are interchangeable.
    Rows move once, by range; every range is sorted on its own. The edges may
    be sampled from a cheaper frame, given with its order columns.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    weight = F.lit(weight) if isinstance(weight, int) else weight
    key = _key(order)
    keyed = df.withColumn("_key", key).withColumn("_weight", weight.cast("bigint"))
    key_type = keyed.schema["_key"].dataType
    source, source_order = sample or (df, order)
    edges = sampled_edges(source, _key(source_order), ranges)
    ranged = keyed.withColumn("_range", range_of(F.col("_key"), edges, key_type))

    # At most len(edges) + 1 rows reach this un-partitioned window.
    sizes = ranged.groupBy("_range").agg(F.sum("_weight").alias("_size"))
    up_to = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_range"), F.coalesce(F.sum("_size").over(up_to), F.lit(0)).alias("_offset")
    )
    within = (
        Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn(before, F.col("_offset") + F.col("_inside"))
        .drop("_key", "_weight", "_range", "_offset", "_inside")
    )


def with_row_numbers(
    df: DataFrame,
    order_by: Sequence[Column | str],
    *,
    row: str = "row",
    start: int = 2,
    ranges: int | None = None,
) -> DataFrame:
    """Dense row numbers; the default start counts a header as row 1."""
    numbered = running_total(df, order_by, before=row, ranges=ranges)
    return numbered.withColumn(row, F.col(row) + F.lit(start))


def with_previous(
    df: DataFrame,
    position: str,
    columns: Sequence[str],
    *,
    within: Sequence[str] = (),
    prefix: str = "previous_",
    chunk: int = 1 << 20,
) -> DataFrame:
    """``lag`` over dense positions, in bounded chunks.

    The last row of each chunk is also sent to the next chunk, so no task sees
    more than ``chunk`` + 1 rows even when ``within`` names one huge group.
    """
    pos = F.col(position)
    home = F.floor(pos / chunk).cast("bigint")
    last = (pos + 1) % chunk == 0
    homes = F.when(last, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(homes))
    order = Window.partitionBy(*within, "_chunk").orderBy(position)
    for name in columns:
        spread = spread.withColumn(prefix + name, F.lag(name).over(order))
    return spread.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def expand_counts(
    df: DataFrame, count: str, *, index: str = "copy", chunk: int = 100_000
) -> DataFrame:
    """One row per copy, ``index`` running from 0 to ``count`` - 1.

    A count above ``chunk`` is first cut into pieces that are spread over the
    tasks, so one huge group is never expanded by one task. Their number is given,
    as adaptive execution would join the tasks by the few bytes of the pieces.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.col(count)
    small = df.filter(size <= chunk).withColumn(
        index, F.explode(F.sequence(F.lit(0).cast("bigint"), size.cast("bigint") - 1))
    )
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / chunk).cast("bigint"))
    low = F.col("_piece") * chunk
    large = (
        df.filter(size > chunk)
        .withColumn("_piece", F.explode(pieces))
        .repartition(partitions, F.col("_piece"), size)
        .withColumn(index, F.explode(F.sequence(low, F.least(low + chunk, size.cast("bigint")) - 1)))
        .drop("_piece")
    )
    return small.unionByName(large)
