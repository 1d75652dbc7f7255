"""Disclosed, size-limited data for charts and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.functions.geo import valid_geometry, valid_lat_lon
from sievetable.operators.ordering import with_previous

# Presentation limits.
MAX_ROWS = 10_000
MAX_BYTES = 5 * 1024 * 1024
VIEW_COUNTS = {"static": (2, 6), "interactive": (2, 4)}


def reduction(
    before: DataFrame,
    after: DataFrame,
    method: str,
    *,
    grouping: Sequence[str] = (),
    exclusions: Sequence[str] = (),
    sample_basis: str | None = None,
) -> DataFrame:
    """The record that discloses a step which left rows out."""
    count = F.count(F.lit(1)).alias("n")
    text_list = "array<string>"
    return after.agg(count).select(
        F.lit(method).alias("method"),
        before.agg(count).scalar().alias("original_rows"),
        F.col("n").alias("presented_rows"),
        F.array(*[F.lit(g) for g in grouping]).cast(text_list).alias("grouping_fields"),
        F.array(*[F.lit(e) for e in exclusions]).cast(text_list).alias("exclusions"),
        F.lit(sample_basis).cast("string").alias("sample_basis"),
    )


def chain_problems(reductions: DataFrame, totals: DataFrame) -> DataFrame:
    """Breaks in the chain of reductions of each presentation.

    ``reductions``: presentation, step (dense from 0), method, original_rows,
    presented_rows. ``totals``: presentation, original_rows, presented_rows.
    """
    narrow = reductions.select(
        "presentation",
        "step",
        "original_rows",
        "presented_rows",
        (F.trim(F.coalesce("method", F.lit(""))) == "").alias("unnamed"),
    )
    # Each row and each presentation is looked at once; its problems are listed.
    linked = with_previous(narrow, "step", ["presented_rows"], within=["presentation"], chunk=100_000)
    growing = (F.col("original_rows") <= F.col("presented_rows")) | F.col("unnamed")
    of_steps = [
        F.when(F.col("previous_presented_rows") != F.col("original_rows"), F.lit("CHAIN_BROKEN")),
        F.when(growing, F.lit("NOT_A_REDUCTION")),
    ]
    ends = reductions.groupBy("presentation").agg(
        F.min_by("original_rows", "step").alias("first_rows"),
        F.max_by("presented_rows", "step").alias("last_rows"),
    )
    tied = totals.join(ends, "presentation", "left")
    loose = F.col("first_rows").isNotNull() & (
        (F.col("first_rows") != F.col("original_rows")) | (F.col("last_rows") != F.col("presented_rows"))
    )
    hidden = F.col("first_rows").isNull() & (F.col("original_rows") > F.col("presented_rows"))
    of_totals = [F.when(loose, F.lit("TOTALS_DISAGREE")), F.when(hidden, F.lit("REDUCTION_UNDISCLOSED"))]

    def problems(frame: DataFrame, step: Column, codes: list[Column]) -> DataFrame:
        listed = F.explode(F.array_compact(F.array(*codes))).alias("problem")
        return frame.select("presentation", step.cast("bigint").alias("step"), listed)

    return problems(linked, F.col("step"), of_steps).unionByName(problems(tied, F.lit(None), of_totals))


def size_check(df: DataFrame, *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row: rows, JSON bytes, and whether each limit holds."""
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return (
        df.select(size.alias("size"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("json_bytes"),
        )
        .select(
            "rows",
            "json_bytes",
            (F.col("rows") <= max_rows).alias("rows_ok"),
            (F.col("json_bytes") <= max_bytes).alias("bytes_ok"),
        )
    )


def spatial_split(df: DataFrame, latitude: str, longitude: str) -> tuple[DataFrame, DataFrame]:
    """Rows that can be mapped, and the others."""
    ok = valid_lat_lon(F.col(latitude), F.col(longitude))
    return df.filter(ok), df.filter(~ok)


def spatial_check(
    df: DataFrame,
    *,
    latitude: str | None = None,
    longitude: str | None = None,
    geometry: str | None = None,
    crs: str = "EPSG:4326",
) -> DataFrame:
    """One row: valid and invalid spatial records."""
    if geometry is not None:
        ok = valid_geometry(F.col(geometry), crs)
    else:
        ok = valid_lat_lon(F.col(latitude), F.col(longitude))
    return df.select(ok.alias("ok")).agg(
        F.count(F.when(F.col("ok"), True)).alias("valid_records"),
        F.count(F.when(~F.col("ok"), True)).alias("excluded_records"),
    )


def exclusions_disclosed(reductions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Whether rows left off the map equal the rows disclosed as exclusions.

    ``excluded``: presentation, excluded_records.
    """
    disclosed = (
        reductions.filter(F.size("exclusions") > 0)
        .groupBy("presentation")
        .agg(F.sum(F.col("original_rows") - F.col("presented_rows")).alias("disclosed"))
    )
    joined = excluded.join(disclosed, "presentation", "left")
    disclosed_rows = F.coalesce("disclosed", F.lit(0))
    agrees = (F.col("excluded_records") == 0) | (disclosed_rows == F.col("excluded_records"))
    return joined.select("presentation", "excluded_records", disclosed_rows.alias("disclosed"), agrees.alias("agrees"))


def view_problems(views: DataFrame, totals: DataFrame, mode: str) -> DataFrame:
    """Presentations whose views break the count, text or population rules.

    ``views``: presentation, id, question, population, unit, record_count,
    takeaway. ``totals``: presentation, original_rows, presented_rows.
    """
    least, most = VIEW_COUNTS[mode]
    ceiling = "presented_rows" if mode == "interactive" else "original_rows"
    filled = F.lit(True)
    for name in ("id", "question", "population", "unit", "takeaway"):
        filled = filled & (F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    per = views.groupBy("presentation").agg(
        F.count(F.lit(1)).alias("views"),
        F.count(F.when(~filled, True)).alias("unfilled"),
        F.max("record_count").alias("largest"),
        F.min("record_count").alias("smallest"),
    )
    checked = totals.join(per, "presentation", "left")
    bad_count = ~F.coalesce(F.col("views"), F.lit(0)).between(least, most)
    bad_records = (F.col("largest") > F.col(ceiling)) | (F.col("smallest") < 0)
    bad = bad_count | F.coalesce(bad_records, F.lit(False)) | (F.coalesce("unfilled", F.lit(0)) > 0)
    return checked.filter(bad).select(
        "presentation",
        F.coalesce("views", F.lit(0)).alias("views"),
        F.lit("VIEW_METADATA_INVALID").alias("problem"),
    )
