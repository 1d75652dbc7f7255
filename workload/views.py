"""Derived tables with known defects, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as text with injected defects and repeated rows."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    dirty = orders.select(
        key.cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("cents"),
        day.alias("o_orderdate"),
        "o_orderpriority",
        F.when(key % 97 == 0, "=SUM(A1)").when(key % 89 == 0, "+1").otherwise("ok").alias("note"),
        F.when(key % 83 == 0, "2026-99-99")
        .when(key % 79 == 0, "2026-02-30")
        .otherwise(day)
        .alias("due"),
        F.when(key % 2 == 0, F.lit(None)).when(key % 3 == 0, "").otherwise("x").alias("sparse"),
        F.when(key % 5 == 0, "12").when(key % 5 == 1, "abc").otherwise("1.5").alias("mixed"),
    )
    copies = F.when(key.cast("bigint") % 101 == 0, F.array(F.lit(0), F.lit(1)))
    return dirty.withColumn("_c", F.explode(copies.otherwise(F.array(F.lit(0))))).drop("_c")


ORDERS_DIRTY_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "cents",
    "o_orderdate",
    "o_orderpriority",
    "note",
    "due",
    "sparse",
    "mixed",
]

ORDERS_DIRTY_SQL = """
dirty_once AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
         CAST(o_custkey AS VARCHAR) AS o_custkey,
         o_orderstatus,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents,
         strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
         o_orderpriority,
         CASE WHEN o_orderkey % 97 = 0 THEN '=SUM(A1)'
              WHEN o_orderkey % 89 = 0 THEN '+1' ELSE 'ok' END AS note,
         CASE WHEN o_orderkey % 83 = 0 THEN '2026-99-99'
              WHEN o_orderkey % 79 = 0 THEN '2026-02-30'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due,
         CASE WHEN o_orderkey % 2 = 0 THEN NULL
              WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x' END AS sparse,
         CASE WHEN o_orderkey % 5 = 0 THEN '12'
              WHEN o_orderkey % 5 = 1 THEN 'abc' ELSE '1.5' END AS mixed
  FROM orders),
dirty AS (
  SELECT *, CAST(o_orderkey AS BIGINT) AS k,
         row_number() OVER (ORDER BY CAST(o_orderkey AS BIGINT)) + 1 AS rn
  FROM (SELECT * FROM dirty_once
        UNION ALL
        SELECT * FROM dirty_once WHERE CAST(o_orderkey AS BIGINT) % 101 = 0))
"""


def text_type_sql(column: str) -> str:
    """The cell classifier in DuckDB SQL, for text."""
    return f"""CASE
      WHEN {column} IS NULL OR {column} = '' THEN 'null'
      WHEN regexp_full_match(lower(trim({column})), 'true|false') THEN 'boolean'
      WHEN regexp_full_match(trim({column}), '[+-]?[0-9]+') THEN 'integer'
      WHEN regexp_full_match(trim({column}),
           '[+-]?([0-9]+\\.[0-9]*|[0-9]*\\.[0-9]+|[0-9]+[eE][+-]?[0-9]+)') THEN 'double'
      WHEN regexp_full_match(trim({column}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
           AND trim({column}) >= '0100' AND try_cast(trim({column}) AS DATE) IS NOT NULL THEN 'date'
      WHEN regexp_matches(trim({column}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T')
           AND try_cast(trim({column}) AS TIMESTAMP) IS NOT NULL THEN 'timestamp'
      ELSE 'string' END"""
