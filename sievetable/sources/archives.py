"""ZIP inventories: entries of many archives, their safety, and the choice of one.

Only the central directory of an archive is opened, one archive per row; every
rule is a column expression or an aggregate over entry rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetable.sources.batches import in_frames

# Archive bounds, and extensions that are data or archives.
MAX_ENTRIES = 10_000
MAX_PATH_BYTES = 1_024
MAX_ENTRY_BYTES = 512 * 1024 * 1024
MAX_COMPRESSION_RATIO = 200
DATA_ENTRY = r"(?i)[^/]\.(?:csv|tsv|json|jsonl|ndjson|xlsx|parquet|px|xml)\z"
ARCHIVE_ENTRY = r"(?i)[^/]\.(?:zip|7z|rar|tar|gz|gzip)\z"

ENTRY_SCHEMA = (
    "archive string, entry string, compressed_bytes bigint, expanded_bytes bigint,"
    " encrypted boolean, mode int, directory boolean, error string"
)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, content) for the archives below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select(F.col("path").alias("archive"), "content")


def archive_entries(archives: DataFrame) -> DataFrame:
    """Entry rows of each archive; an unreadable archive is one row with ``error``."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for archive, content in zip(batch["archive"], batch["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as opened:
                    listed = opened.infolist()
            except (zipfile.BadZipFile, ValueError, EOFError) as error:
                yield (archive, *[None] * 6, str(error))
                continue
            for e in listed:
                encrypted, mode = bool(e.flag_bits & 1), e.external_attr >> 16
                sizes = e.compress_size, e.file_size
                yield archive, e.orig_filename, *sizes, encrypted, mode, e.is_dir(), None

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
        for batch in batches:
            yield from in_frames(rows(batch), names)

    return archives.select("archive", "content").mapInPandas(listing, ENTRY_SCHEMA)


def entry_problem() -> Column:
    """Why an entry must not be opened, or null."""
    name = F.replace(F.col("entry"), F.lit("\\"), F.lit("/"))
    parts = F.split(name, "/")
    bad_path = (
        name.startswith("/")
        | name.rlike(r"\A[A-Za-z]:/")
        | (F.instr(name, "\x00") > 0)
        | (F.octet_length(name) > MAX_PATH_BYTES)
        | F.exists(parts, lambda p: p.isin("", ".", ".."))
    )
    packed, size = F.col("compressed_bytes"), F.col("expanded_bytes")
    ratio_high = F.when(packed == 0, size > 0).otherwise(size > packed * MAX_COMPRESSION_RATIO)
    return (
        F.when(bad_path, "path")
        .when(F.col("encrypted"), "encrypted")
        .when(F.col("mode").bitwiseAND(F.lit(0o170000)) == 0o120000, "symlink")
        .when(name.rlike(ARCHIVE_ENTRY), "nested-archive")
        .when(size > MAX_ENTRY_BYTES, "size")
        .when(ratio_high, "ratio")
    )


def choose_entry(entries: DataFrame) -> DataFrame:
    """Per archive: entries, data entries, the first problem, and the entry to use."""
    files = entries.filter(F.col("error").isNotNull() | ~F.col("directory"))
    marked = files.withColumns(
        {"problem": entry_problem(), "supported": F.col("entry").rlike(DATA_ENTRY)}
    )
    per = marked.groupBy("archive").agg(
        F.count("entry").alias("entries"),
        F.count(F.when(F.col("supported"), True)).alias("candidates"),
        F.min(F.when(F.col("supported"), F.col("entry"))).alias("only"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("entry"))).alias("problem"),
        F.max("error").alias("error"),
    )
    outcome = (
        F.when(F.col("error").isNotNull(), "INVALID_ARCHIVE_DATA")
        .when(F.col("entries") > MAX_ENTRIES, "ARCHIVE_LIMIT_EXCEEDED")
        .when(F.col("problem").isin("size", "ratio"), "ARCHIVE_LIMIT_EXCEEDED")
        .when(F.col("problem").isNotNull(), "UNSAFE_ARCHIVE_ENTRY")
        .when(F.col("candidates") == 0, "ARCHIVE_NO_SUPPORTED_ENTRY")
        .when(F.col("candidates") > 1, "ARCHIVE_ENTRY_REQUIRED")
        .otherwise("selected")
    )
    return per.select(
        "archive",
        "entries",
        "candidates",
        "problem",
        outcome.alias("outcome"),
        F.when(outcome == "selected", F.col("only")).alias("entry"),
    )


def extract_entries(archives: DataFrame, choices: DataFrame) -> DataFrame:
    """(archive, entry, content) of the chosen entries, bounded in size."""
    chosen = choices.filter(F.col("entry").isNotNull()).select("archive", "entry")

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for archive, content, entry in zip(
            batch["archive"], batch["content"], batch["entry"], strict=True
        ):
            with zipfile.ZipFile(io.BytesIO(content)) as opened, opened.open(entry) as part:
                data = part.read(MAX_ENTRY_BYTES + 1)
            if len(data) > MAX_ENTRY_BYTES:
                raise ValueError(f"{archive}: entry {entry} is too large")
            yield archive, entry, data

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from in_frames(rows(batch), ["archive", "entry", "content"], most=32)

    joined = archives.join(chosen, "archive").select("archive", "content", "entry")
    return joined.mapInPandas(extract, "archive string, entry string, content binary")
