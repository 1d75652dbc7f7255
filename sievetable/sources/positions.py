"""Row numbers that follow the order of the files, found without sorting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetable.operators.ordering import running_total
from sievetable.plans.staged import kept

MAX_BROADCAST_PIECES = 200_000
# So many rows may stand in one window; more are summed in two levels.
WINDOW_PIECES = 1000
SMALLEST_SPLIT_BYTES = 4 * 1024 * 1024


def pieces_bound(df: DataFrame, *, splits: bool) -> int:
    """Upper bound of the pieces of a scan, from file listing facts only."""
    files = len(df.inputFiles())
    if not splits:
        return files
    scanned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files + scanned // SMALLEST_SPLIT_BYTES


def number_file_rows(
    df: DataFrame,
    piece: list[Column],
    place: Column,
    *,
    pieces: int,
    row: str = "row",
    start: int = 2,
) -> DataFrame:
    """Add row numbers: rows of earlier pieces, plus the place within the piece.

    A piece is a file or a split of one. Only one small record per piece is
    summed in order, beyond a thousand pieces within ranges of them and then over
    the ranges. Up to 200,000 pieces those records are broadcast and the rows stay
    where they were read; beyond that the join shuffles.
    """
    names = [f"_p{i}" for i in range(len(piece))]
    tagged = df.withColumns(dict(zip(names, piece, strict=True))).withColumn("_at", place)
    sizes = tagged.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_least")
    )
    if pieces <= WINDOW_PIECES:
        earlier = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    else:
        offsets = running_total(kept(sizes, "pieces"), names, F.col("_size"), before="_before")
    offsets = offsets.select(*names, "_least", "_before")
    if pieces <= MAX_BROADCAST_PIECES:
        offsets = F.broadcast(offsets)
    numbered = tagged.join(offsets, names)
    number = F.col("_before") + F.col("_at") - F.col("_least") + start
    return numbered.withColumn(row, number).drop(*names, "_at", "_least", "_before")


def number_parquet_rows(df: DataFrame, *, row: str = "row", start: int = 2) -> DataFrame:
    """Row numbers of a Parquet scan, from the row index inside each file."""
    return number_file_rows(
        df,
        [F.col("_metadata.file_path")],
        F.col("_metadata.row_index"),
        pieces=pieces_bound(df, splits=False),
        row=row,
        start=start,
    )


def number_text_rows(df: DataFrame, *, row: str = "row", start: int = 2) -> DataFrame:
    """Row numbers of a text-like scan, from each split's place in its file.

    A split is read in order by one task, so the task-local counter gives the
    place within it.
    """
    pieces = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    bound = pieces_bound(df, splits=True)
    return number_file_rows(
        df, pieces, F.monotonically_increasing_id(), pieces=bound, row=row, start=start
    )
