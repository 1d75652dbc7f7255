"""Small helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sievetable.session import checkpoint_dir


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder, read back.

    Cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
