"""Validation of a table that keeps growing.

Each micro-batch adds its partial results to tables; the issues so far are an
aggregate over those partials, so nothing is validated twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sievetable.functions import cells
from sievetable.operators.quality import column_stats, fingerprint, row_positions


def batch_partials(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column statistics and cell-issue counts of one batch."""
    stats = column_stats(batch).select("field", "rows", "non_null", "type_mask")
    located = row_positions(batch.withColumn("_row", F.lit(0)), "_row")
    names = F.array(*[F.lit(c) for c in batch.columns])
    found = located.filter(F.col("cells").isNotNull()).select(F.inline("cells"))
    counts = found.groupBy("code", F.element_at(names, F.col("column")).alias("field")).agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    return stats, counts


def write_partials(batch: DataFrame, batch_id: int, root: str) -> None:
    """One folder per batch, overwritten on a retry: exactly-once in effect."""
    stats, counts = batch_partials(batch)
    stats.write.mode("overwrite").parquet(f"{root}/stats/batch={batch_id}")
    counts.write.mode("overwrite").parquet(f"{root}/cells/batch={batch_id}")
    rows = batch.select(fingerprint(batch).alias("fingerprint"))
    hashes = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    hashes.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")


def validate_stream(stream: DataFrame, root: str) -> DataStreamWriter:
    """A writer that validates every micro-batch into ``root``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        cached = batch.persist()
        try:
            write_partials(cached, batch_id, root)
        finally:
            cached.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint")


def issues_so_far(spark: SparkSession, root: str) -> DataFrame:
    """Grouped issues over all batches: code, field, occurrences."""
    stats = spark.read.parquet(f"{root}/stats").groupBy("field").agg(
        F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.bit_or("type_mask").alias("type_mask"),
    )
    one = F.lit(1).cast("bigint").alias("occurrences")
    mixed = stats.filter(cells.is_mixed(F.col("type_mask"))).select(
        F.lit("MIXED_TYPES").alias("code"), "field", one
    )
    heavy = stats.filter((F.col("rows") > 0) & (F.col("non_null") * 2 <= F.col("rows"))).select(
        F.lit("NULL_HEAVY_COLUMN").alias("code"), "field", one
    )
    found = spark.read.parquet(f"{root}/cells").groupBy("code", "field").agg(
        F.sum("occurrences").alias("occurrences")
    )
    copies = spark.read.parquet(f"{root}/rows").groupBy("fingerprint").agg(
        F.sum("copies").alias("copies")
    )
    repeated = copies.filter(F.col("copies") > 1).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("occurrences")
    )
    duplicates = repeated.filter(F.col("occurrences") > 0).select(
        F.lit("DUPLICATE_ROW").alias("code"), F.lit(None).cast("string").alias("field"), "occurrences"
    )
    return mixed.unionByName(heavy).unionByName(found).unionByName(duplicates)


def first_occurrences(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Rows not seen before within the watermark, by fingerprint."""
    marked = stream.withColumn("fingerprint", fingerprint(stream))
    return marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])
