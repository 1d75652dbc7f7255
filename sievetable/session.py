"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "sievetable", **conf: str) -> SparkSession:
    """A session for local work; on a cluster pass the session the cluster gives."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder named by the cluster in ``spark.checkpoint.dir``.

    Only a session in one process without the setting gets a new folder for
    itself; a cluster session without it is an error, because a folder that one
    machine sees does not survive the loss of that machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path
