"""Reuse of a prepared table: written once as Parquet, read afterwards."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from sievetable.session import checkpoint_dir

STAGING_VERSION = "1"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back, for several uses."""
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Staged(NamedTuple):
    """A prepared table and how it was obtained: hit, miss or bypass."""

    table: DataFrame
    status: str
    path: str | None


def stage_key(source_sha256: str, source_format: str, part: str | None, engine: str) -> str:
    """Key of a staged table: the same source, reading rules and engine."""
    identity = json.dumps([source_sha256, source_format, part, STAGING_VERSION, engine])
    return hashlib.sha256(identity.encode()).hexdigest()


def staged_table(
    spark: SparkSession,
    root: str,
    key: str,
    build: Callable[[], DataFrame],
    *,
    warnings: int = 0,
) -> Staged:
    """Read the staged table of ``key``, or build and write it once.

    A table with reading warnings is not kept. ``_SUCCESS`` is written last, so
    a lost job leaves nothing that looks complete.
    """
    if warnings:
        return Staged(build(), "bypass", None)
    path = f"{root.rstrip('/')}/{key}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(jvm_path):
        return Staged(spark.read.parquet(path), "hit", path)
    build().write.mode("overwrite").parquet(path)
    return Staged(spark.read.parquet(path), "miss", path)
