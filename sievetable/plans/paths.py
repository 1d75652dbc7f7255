"""Preview, schema and SQL over a path, with staging and provenance."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetable.operators.export import FORMATS
from sievetable.operators.inference import infer_schema
from sievetable.operators.lineage import RECORD_SCHEMA, file_digests, provenance_records, table_digest
from sievetable.operators.quality import own_order
from sievetable.operators.selection import PREVIEW_ROWS, Page, preview
from sievetable.plans import bounded
from sievetable.plans.staged import Staged, stage_key, staged_table
from sievetable.sources import tables


class PathQuery(NamedTuple):
    """A lazy result, how its table was obtained, and what it was made from."""

    frame: DataFrame
    status: str
    source_sha256: str
    format: str


def preview_path(spark: SparkSession, path: str, rows: int = PREVIEW_ROWS, *, record_path: str | None = None) -> Page:
    """The first rows of a path, and whether there are more."""
    return preview(tables.open_table(spark, path, record_path=record_path).table, rows)


def schema_path(
    spark: SparkSession, path: str, *, sample_rows: int | None = None, text_columns: Sequence[str] = ()
) -> DataFrame:
    """The inferred schema of a path, over all its rows unless a sample is asked for."""
    opened = tables.open_table(spark, path, text_columns=text_columns)
    order = own_order(opened.table)
    return infer_schema(opened.table, order, sample_rows=sample_rows, code_columns=opened.code_columns)


def staged_path(
    spark: SparkSession, path: str, root: str, *, record_path: str | None = None
) -> tuple[Staged, str, str]:
    """The table of a path, written once per content of its files; its digest and format."""
    source = table_digest(file_digests(spark, path)).first().sha256
    form = tables.detect_path(spark, path).format
    key = stage_key(source, form, record_path, spark.version)

    def build() -> DataFrame:
        return tables.open_table(spark, path, format=form, record_path=record_path).table

    return staged_table(spark, root, key, build), source, form


def query_path(
    spark: SparkSession,
    path: str,
    sql: str,
    *,
    root: str,
    limits: bounded.QueryLimits | None = None,
    record_path: str | None = None,
) -> PathQuery:
    """One checked statement over the staged table of a path."""
    staged, source, form = staged_path(spark, path, root, record_path=record_path)
    return PathQuery(bounded.select(staged.table, sql, limits), staged.status, source, form)


def export_query(
    spark: SparkSession,
    path: str,
    sql: str,
    output: str,
    target: str,
    *,
    root: str,
    limits: bounded.QueryLimits | None = None,
    force: bool = False,
) -> DataFrame:
    """Write a statement's rows and a provenance record of each file; returns the records.

    The records tell the statement, the digest of what was queried, and whether
    rows were left out.
    """
    staged, source, _ = staged_path(spark, path, root)
    truncated = bounded.export(staged.table, sql, output, target, limits=limits, force=force)
    records = provenance_records(
        file_digests(spark, output, "part-*"),
        "query",
        timestamp=F.current_timestamp(),
        input_sha256=F.lit(source),
        media_type=FORMATS[target][0],
        details={"sql": F.lit(sql), "truncated": F.lit(truncated)},
    )
    sidecar = output.rstrip("/") + ".provenance"
    records.write.mode("overwrite" if force else "errorifexists").json(sidecar)
    return spark.read.schema(RECORD_SCHEMA).json(sidecar)
