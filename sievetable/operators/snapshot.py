"""Checks of catalogue snapshots, pages, manifests and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetable.operators.ordering import with_previous, with_row_numbers

# Ages, counts and shapes.
MAX_AGE_SECONDS = 24 * 60 * 60
FUTURE_TOLERANCE_SECONDS = 5 * 60
RETENTION_SECONDS = 48 * 60 * 60
MAX_SNAPSHOT_BYTES = 10 * 1024 * 1024
LEAST_SHARE_OF_PREVIOUS = 0.9
SNAPSHOT_PATH = r"\Av1/snapshots/[A-Za-z0-9._-]+\.json\z"
SHA256_TEXT = r"\A[a-f0-9]{64}\z"
UTC_TEXT = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z\z"


def utc(text: Column) -> Column:
    """UTC timestamp text as a timestamp, else null."""
    return F.when(text.rlike(UTC_TEXT), F.try_to_timestamp(text))


def snapshot_items(datasets: DataFrame) -> DataFrame:
    """(position, id, title, name) in catalogue order: name, then id."""
    rows = datasets.select("id", "title", "name")
    return with_row_numbers(rows, ["name", "id", "title"], row="position", start=0)


def order_violations(items: DataFrame) -> DataFrame:
    """Items that sort before the item at the position ahead of them."""
    linked = with_previous(items, "position", ["name", "id"])
    previous = F.struct(F.col("previous_name").alias("name"), F.col("previous_id").alias("id"))
    here = F.struct("name", "id")
    return linked.filter(F.col("previous_id").isNotNull() & (previous > here)).select(
        "position", "id", "name", "previous_id", "previous_name"
    )


def duplicate_ids(items: DataFrame) -> DataFrame:
    counted = items.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter(F.col("copies") > 1)


def snapshot_verdict(items: DataFrame, declared_count: int | None = None) -> DataFrame:
    """One row: items, blank fields, duplicate ids, order violations, validity."""
    blank = (F.col("id") == "") | (F.col("title") == "") | (F.col("name") == "")
    missing = F.col("id").isNull() | F.col("title").isNull() | F.col("name").isNull()
    counts = items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count(F.when(F.coalesce(blank, F.lit(False)) | missing, True)).alias("blank"),
    )
    n = F.count(F.lit(1)).alias("n")
    checked = counts.select(
        "items",
        "blank",
        duplicate_ids(items).agg(n).scalar().alias("duplicate_ids"),
        order_violations(items).agg(n).scalar().alias("order_violations"),
    )
    expected = F.col("items") if declared_count is None else F.lit(declared_count)
    valid = (
        (F.col("items") == expected)
        & (F.col("blank") == 0)
        & (F.col("duplicate_ids") == 0)
        & (F.col("order_violations") == 0)
    )
    return checked.withColumn("valid", valid)


def page_problems(pages: DataFrame) -> DataFrame:
    """Broken paging runs: total changes, offsets that do not advance, sum ≠ total.

    ``pages``: run, page (dense from 0), total, items, page_offset, next_offset.
    """
    run = pages.groupBy("run").agg(
        F.min("total").alias("least"), F.max("total").alias("most"), F.sum("items").alias("items")
    )
    totals = run.filter((F.col("least") != F.col("most")) | (F.col("items") != F.col("least")))
    stuck = pages.filter(F.col("next_offset") <= F.col("page_offset"))
    linked = with_previous(pages, "page", ["next_offset"], within=["run"], chunk=100_000)
    jumped = linked.filter(F.col("previous_next_offset") != F.col("page_offset"))
    moving = stuck.select("run").unionByName(jumped.select("run")).distinct()
    return totals.select("run", F.lit("total").alias("field")).unionByName(
        moving.select("run", F.lit("nextOffset").alias("field"))
    )


def freshness(generated_at: Column, now: Column) -> Column:
    """fresh, stale, or invalid (no UTC time, or too far ahead)."""
    made = utc(generated_at)
    age = now.cast("timestamp").cast("double") - made.cast("double")
    return (
        F.when(made.isNull() | (age < -FUTURE_TOLERANCE_SECONDS), F.lit("invalid"))
        .when(age > MAX_AGE_SECONDS, F.lit("stale"))
        .otherwise(F.lit("fresh"))
    )


def count_reductions(runs: DataFrame) -> DataFrame:
    """Runs that lost more than a tenth of the run before them.

    ``runs``: catalogue, run, count, allow_reduction - one row per publication.
    """
    previous = F.lag("count").over(Window.partitionBy("catalogue").orderBy("run"))
    with_last = runs.withColumn("previous", previous)
    low = F.col("count") < F.col("previous") * LEAST_SHARE_OF_PREVIOUS
    return with_last.filter(low & ~F.coalesce("allow_reduction", F.lit(False)))


def manifest_valid() -> Column:
    """A manifest row has the fixed shape."""
    return F.coalesce(
        F.col("generated_at").rlike(UTC_TEXT)
        & F.col("snapshot_path").rlike(SNAPSHOT_PATH)
        & ~F.col("snapshot_path").endswith("/.json")
        & ~F.col("snapshot_path").endswith("/..json")
        & (F.col("count") >= 0)
        & F.col("bytes").between(1, MAX_SNAPSHOT_BYTES)
        & F.col("sha256").rlike(SHA256_TEXT),
        F.lit(False),
    )


def manifests(files: DataFrame) -> DataFrame:
    """Manifest rows for snapshot files: (generated_at, count, content)."""
    stamp = F.regexp_replace("generated_at", ":", "-")
    content = F.col("content")
    return files.select(
        F.lit("1").alias("schema_version"),
        "generated_at",
        F.concat(F.lit("v1/snapshots/"), stamp, F.lit(".json")).alias("snapshot_path"),
        "count",
        F.octet_length(content).cast("bigint").alias("bytes"),
        F.sha2(content.cast("binary"), 256).alias("sha256"),
    )


def manifest_mismatches(snapshots: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """(snapshot_path, field) where a snapshot file differs from its manifest.

    ``snapshots``: snapshot_path and content (JSON with ``count`` and
    ``generatedAt``). A snapshot without a manifest, or the reverse, differs in
    ``manifest`` or ``snapshot``.
    """
    text = F.col("content").cast("string")
    facts = snapshots.select(
        "snapshot_path",
        F.octet_length("content").cast("bigint").alias("_bytes"),
        F.sha2(F.col("content").cast("binary"), 256).alias("_sha256"),
        F.get_json_object(text, "$.count").try_cast("bigint").alias("_count"),
        F.get_json_object(text, "$.generatedAt").alias("_generated_at"),
        F.lit(True).alias("_there"),
    )
    listed = manifest_rows.select("snapshot_path", "bytes", "sha256", "count", "generated_at", F.lit(True).alias("_listed"))
    both = facts.join(listed, "snapshot_path", "full")
    pairs = {"bytes": "bytes", "sha256": "sha256", "count": "count", "generatedAt": "generated_at"}
    present = F.col("_there").isNotNull() & F.col("_listed").isNotNull()
    wrong = [
        F.when(present & ~F.col(f"_{column}").eqNullSafe(F.col(column)), F.lit(name)) for name, column in pairs.items()
    ]
    one_sided = [
        F.when(F.col("_listed").isNull(), F.lit("manifest")),
        F.when(F.col("_there").isNull(), F.lit("snapshot")),
    ]
    return both.select("snapshot_path", F.explode(F.array_compact(F.array(*wrong, *one_sided))).alias("field"))


def retained(manifest_rows: DataFrame, now: Column) -> DataFrame:
    """Manifests of the last 48 hours, newest first, then by path."""
    made = utc(F.col("generated_at"))
    age = now.cast("timestamp").cast("double") - made.cast("double")
    kept = manifest_rows.filter(age <= RETENTION_SECONDS)
    return kept.orderBy(made.desc(), F.col("snapshot_path").asc())


def repeated_paths(manifest_rows: DataFrame) -> DataFrame:
    counted = manifest_rows.groupBy("snapshot_path").agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter(F.col("copies") > 1)


