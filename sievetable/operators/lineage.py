"""Digests and provenance records of written artefacts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievetable.operators.export import FORMATS, spreadsheet_risks, write_table
from sievetable.sources import ranges

SHA256_TEXT = r"\A[a-f\d]{64}\z"
_TRANSFORMATION = T.StructType(
    [
        T.StructField("operation", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("inputSha256", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("schemaVersion", T.StringType()),
        T.StructField("retrievedAt", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("mediaType", T.StringType()),
        T.StructField("localPath", T.StringType()),
        T.StructField("transformations", T.ArrayType(_TRANSFORMATION)),
    ]
)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, read in pieces."""
    return ranges.read_digests(ranges.listed(spark, path, pattern))


def table_digest(files: DataFrame) -> DataFrame:
    """One digest and size for a folder of files.

    The digest is over the sorted list of (digest, size) pairs, folded in two
    levels so that one task never lists more than the groups of the first.
    """
    entry = F.concat_ws(":", "sha256", F.col("bytes").cast("string"))
    groups = files.groupBy(F.substring("sha256", 1, 3).alias("g")).agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(entry))), 256).alias("d"),
        F.sum("bytes").alias("bytes"),
    )
    pair = F.concat_ws(":", "g", "d")
    return groups.agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(pair))), 256).alias("sha256"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def provenance_records(
    files: DataFrame,
    operation: str,
    *,
    timestamp: Column,
    input_sha256: Column,
    media_type: str,
    details: Mapping[str, Column],
) -> DataFrame:
    """One record per file."""
    pairs = [p for k, v in details.items() for p in (F.lit(k), v.cast("string"))]
    stamp = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    step = F.struct(
        F.lit(operation).alias("operation"),
        stamp.alias("timestamp"),
        input_sha256.alias("inputSha256"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("details"),
    )
    return files.select(
        F.lit("1").alias("schemaVersion"),
        stamp.alias("retrievedAt"),
        "sha256",
        "bytes",
        F.lit(media_type).alias("mediaType"),
        F.col("path").alias("localPath"),
        F.array(step).alias("transformations"),
    )


def record_violations(records: DataFrame) -> DataFrame:
    """Records that break a rule, with the rule."""
    step_ok = F.forall(
        "transformations",
        lambda t: (t["operation"] != "")
        & t["timestamp"].isNotNull()
        & (t["inputSha256"].isNull() | t["inputSha256"].rlike(SHA256_TEXT)),
    )
    rules = [
        (F.coalesce(F.col("schemaVersion") == "1", F.lit(False)), "schemaVersion"),
        (F.coalesce(F.col("sha256").rlike(SHA256_TEXT), F.lit(False)), "sha256"),
        (F.coalesce(F.col("bytes") >= 0, F.lit(False)), "bytes"),
        (F.coalesce(F.col("localPath") != "", F.lit(False)), "localPath"),
        (F.coalesce(F.size("transformations") >= 1, F.lit(False)), "transformations"),
        (F.coalesce(step_ok, F.lit(False)), "transformation"),
    ]
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for ok, name in rules]))
    return records.select("localPath", F.explode(broken).alias("rule"))


def verify(files: DataFrame, records: DataFrame) -> DataFrame:
    """Each file and record, matched by path: verified, changed, or one-sided."""
    recorded = records.select(
        F.col("localPath").alias("path"),
        F.col("sha256").alias("recorded_sha256"),
        F.col("bytes").alias("recorded_bytes"),
    )
    same = (F.col("sha256") == F.col("recorded_sha256")) & (
        F.col("bytes") == F.col("recorded_bytes")
    )
    outcome = (
        F.when(F.col("recorded_sha256").isNull(), "unrecorded")
        .when(F.col("sha256").isNull(), "missing")
        .when(same, "verified")
        .otherwise("changed")
    )
    return files.join(recorded, "path", "full").select("path", outcome.alias("outcome"))


def convert(
    df: DataFrame,
    path: str,
    target: str,
    *,
    source_format: str,
    source_sha256: str,
    spreadsheet: bool = False,
    force: bool = False,
) -> DataFrame:
    """Write a table and its provenance records; returns the records."""
    spark = df.sparkSession
    risks = spreadsheet_risks(df).first().risks
    write_table(df, path, target, spreadsheet=spreadsheet, force=force)
    digests = file_digests(spark, path, "part-*")
    records = provenance_records(
        digests,
        "convert",
        timestamp=F.current_timestamp(),
        input_sha256=F.lit(source_sha256),
        media_type=FORMATS[target][0],
        details={
            "sourceFormat": F.lit(source_format),
            "targetFormat": F.lit(target),
            "spreadsheetSafe": F.lit(spreadsheet),
            "spreadsheetSafeChanges": F.lit(risks if spreadsheet else 0),
        },
    )
    mode = "overwrite" if force else "errorifexists"
    records.write.mode(mode).json(path.rstrip("/") + ".provenance")
    return spark.read.schema(RECORD_SCHEMA).json(path.rstrip("/") + ".provenance")
