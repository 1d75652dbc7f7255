"""Which stored artefacts to drop: expired, least recently used, unreferenced.

The plan is computed over an inventory table; deleting is left to the caller.

``entries``: key, sha256, bytes, expires_at, last_used_at, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.operators.ordering import running_total


def storage_totals(entries: DataFrame) -> DataFrame:
    """One row: objects and bytes, each shared object counted once."""
    objects = entries.groupBy("sha256").agg(F.max("bytes").alias("bytes"))
    return objects.agg(
        F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )


def retention_plan(entries: DataFrame, now: Column, max_bytes: int) -> DataFrame:
    """Each entry with its outcome: expired, evicted or kept.

    Entries leave in order of last use until the objects that are still
    referenced fit. An object frees its bytes with its last reference, so the
    bytes freed before an entry are a running total over last references only.
    """
    expired = F.col("expires_at") <= now
    live = entries.filter(~expired)
    order = ["last_used_at", "created_at", "key"]
    last = live.groupBy("sha256").agg(
        F.max(F.struct(*order)).alias("last"), F.max("bytes").alias("object_bytes")
    )
    # One reference per object carries its bytes; key is unique, so no skew.
    carrying = last.select(F.col("last.key").alias("key"), "object_bytes")
    weighted = live.join(carrying, "key", "left").withColumn(
        "freed", F.coalesce("object_bytes", F.lit(0))
    )
    placed = running_total(
        weighted, order, F.col("freed"), before="freed_before", sample=(live, [F.col(c) for c in order])
    )
    total = storage_totals(live).select("bytes").scalar()
    outcome = F.when(total - F.col("freed_before") > max_bytes, F.lit("evicted")).otherwise("kept")
    columns = entries.columns
    gone = entries.filter(expired).select(*columns, F.lit("expired").alias("outcome"))
    return placed.withColumn("outcome", outcome).select(*columns, "outcome").unionByName(gone)


def removable_objects(plan: DataFrame) -> DataFrame:
    """Objects whose every reference leaves."""
    kept = F.count(F.when(F.col("outcome") == "kept", True))
    per = plan.groupBy("sha256").agg(kept.alias("kept"), F.max("bytes").alias("bytes"))
    return per.filter(F.col("kept") == 0).select("sha256", "bytes")


def unreferenced(objects: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Stored objects that no live entry refers to."""
    live = entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    # An object that very many entries share is one row before the join.
    return objects.join(live.select("sha256").distinct(), "sha256", "left_anti")
