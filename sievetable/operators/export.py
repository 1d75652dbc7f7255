"""Spreadsheet-safe rewriting, text rendering and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievetable.errors import DataError
from sievetable.functions import cells
from sievetable.functions.text import escape_json

# Format -> (media type, delimiter for delimited text).
FORMATS = {
    "csv": ("text/csv", ","),
    "tsv": ("text/tab-separated-values", "\t"),
    "json": ("application/json", None),
    "ndjson": ("application/x-ndjson", None),
    "parquet": ("application/vnd.apache.parquet", None),
}
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if cells.is_text(f.dataType)]


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Prefix ``'`` to every text cell that a spreadsheet would run."""
    chosen = []
    for f in df.schema:
        name = cells.quoted(f.name)
        if cells.is_text(f.dataType):
            risky = cells.FORMULA_SQL.format(c=name)
            chosen.append(f"CASE WHEN {risky} THEN concat('\\'', {name}) ELSE {name} END AS {name}")
        else:
            chosen.append(name)
    return df.selectExpr(*chosen)


def spreadsheet_risks(df: DataFrame) -> DataFrame:
    """One row: number of text cells that a spreadsheet would run."""
    names = [cells.quoted(n) for n in _text_columns(df)]
    if not names:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("risks"))
    per_row = " + ".join(f"int(coalesce({cells.FORMULA_SQL.format(c=n)}, false))" for n in names)
    return df.agg(F.expr(f"CAST(coalesce(sum({per_row}), 0) AS BIGINT)").alias("risks"))


def flat_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which delimited files can hold."""
    return df.select(
        *[
            F.to_json(F.col(cells.quoted(f.name))).alias(f.name)
            if isinstance(f.dataType, _NESTED)
            else F.col(cells.quoted(f.name))
            for f in df.schema
        ]
    )


def delimited_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """One text line per row: quoted only where needed, null as empty."""
    special = rf"[{delimiter}\"\r\n]"
    rendered = []
    for name in df.columns:
        text = F.coalesce(F.col(cells.quoted(name)).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))
        rendered.append(F.when(text.rlike(special), quoted).otherwise(text))
    return flat_text(df).select(F.concat_ws(delimiter, *rendered).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, hidden characters escaped, nulls kept."""
    text = F.to_json(F.struct(*[F.col(cells.quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(escape_json(text).alias("line"))


def json_envelope(df: DataFrame, meta: Sequence[Column] = ()) -> DataFrame:
    """JSON rows with the same metadata struct on each, for line readers."""
    if not meta:
        return json_lines(df)
    body = F.struct(F.struct(*meta).alias("meta"), F.struct("*").alias("row"))
    return df.select(escape_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("line"))


def require_rows(df: DataFrame) -> DataFrame:
    """An input without columns or rows cannot be converted."""
    if not df.columns or df.isEmpty():
        raise DataError("EMPTY_INPUT", "The input has no columns or no rows.")
    return df


def write_table(
    df: DataFrame,
    path: str,
    target: str,
    *,
    spreadsheet: bool = False,
    force: bool = False,
    partition_by: Sequence[str] = (),
) -> None:
    """Write a folder of files in the target format; refuse to overwrite unless forced.

    JSON is written as one object per line: a single array would need one task
    to hold the whole table.
    """
    if target not in FORMATS:
        raise DataError("UNSUPPORTED_FORMAT", f"Cannot write '{target}'.", format=target)
    if spreadsheet:
        df = spreadsheet_safe(df)
    delimiter = FORMATS[target][1]
    if delimiter is not None:
        df = flat_text(df)
    writer = df.write.mode("overwrite" if force else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if delimiter is not None:
        # No escape character: a quote inside a value is doubled.
        writer.option("header", True).option("sep", delimiter).option("escape", '"').option(
            "emptyValue", '""'
        ).option("nullValue", "").csv(path)
    elif target == "parquet":
        writer.parquet(path)
    else:
        writer.option("ignoreNullFields", False).json(path)
