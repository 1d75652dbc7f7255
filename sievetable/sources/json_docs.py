"""JSON documents and newline-delimited JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievetable.errors import DataError
from sievetable.sources import json_items
from sievetable.sources.inventory import one_json_value


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """An array becomes its items, an object one row; a scalar item ``{value}``.

    Arrays are read in splits. Files in UTF-16 or UTF-32 are read whole by the JSON reader.
    """
    found = json_items.read_items(spark, path)
    if found.wide:
        return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    fault = found.faults.first()
    if fault is not None:
        raise DataError("INVALID_JSON", "The JSON document cannot be parsed.", path=fault.path)
    value = F.col("value")
    items = found.items.drop("file", "path", "number")
    folders = [c for c in items.columns if c != "value"]
    kinds = items.agg(
        F.bool_or(value.startswith("{")).alias("objects"), F.bool_and(one_json_value(value)).alias("valid")
    ).first()
    if kinds.valid is False:
        raise DataError("INVALID_JSON", "The JSON document cannot be parsed.", path=path)
    if kinds.objects is None:
        return spark.createDataFrame([], T.StructType([]))
    if not kinds.objects:
        listed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")
        return items.select(listed[0].alias("value"), *folders)
    record = as_record(value)
    schema = inferred_schema(items.select(record.alias("value")))
    parsed = F.from_json(record, schema, {"mode": "FAILFAST"})
    return items.select(F.inline(F.array(parsed)), *folders)


def inferred_schema(texts: DataFrame) -> T.StructType:
    """The schema that the JSON reader finds for a column of objects as text."""
    spark = texts.sparkSession
    reader = spark.read.option("columnNameOfCorruptRecord", "_broken")
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return reader._df(reader._jreader.json(strings)).drop("_broken").schema


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One object per non-blank line; a bad line fails. Columns are the union."""
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def scan_json_lines(
    spark: SparkSession, path: str, schema: str, *, max_record_bytes: int | None = None
) -> DataFrame:
    """Lines parsed with a schema, with ``problem`` for bad or oversized lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    size = F.octet_length("value")
    oversized = F.lit(False) if max_record_bytes is None else size > max_record_bytes
    valid = F.try_parse_json("value").isNotNull()
    problem = F.when(oversized, "RECORD_TOO_LARGE").when(~valid, "INVALID_NDJSON")
    parsed = F.when(problem.isNull(), F.from_json("value", schema))
    return lines.select(parsed.alias("record"), problem.alias("problem"), size.alias("bytes"))


def json_columns_to_variant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Decode the named text columns from JSON; other text stays as it is."""
    return df.withColumns({c: F.try_parse_json(F.col(c)) for c in columns})


def as_record(value: Column) -> Column:
    """JSON text as an object: other values go under ``value``."""
    is_object = F.trim(value).startswith("{")
    wrapped = F.concat(F.lit('{"value":'), value, F.lit("}"))
    return F.when(is_object, value).otherwise(wrapped)
