"""Delimited text: all-text reading, typed reading, and structural issues."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievetable.errors import DataError
from sievetable.functions.cells import quoted
from sievetable.messages import ISSUE_SCHEMA
from sievetable.operators.quality import issue, row_facts, validate_facts
from sievetable.plans.staged import kept
from sievetable.sources import records
from sievetable.sources.headers import plan_header
from sievetable.sources.positions import number_file_rows, pieces_bound

RAW_COLUMN = "_raw"
NO_NULL = "\x01"


def _options(delimiter: str, encoding: str, multi_line: bool) -> dict[str, object]:
    """Reader options: doubled quotes, nothing trimmed, UTF-16 read whole."""
    wide = encoding.lower().startswith("utf-16")
    return {
        "sep": delimiter,
        "encoding": "UTF-16" if wide else encoding,
        "multiLine": multi_line or wide,
        "escape": '"',
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "maxCharsPerColumn": -1,
    }


class LineFacts(NamedTuple):
    """Lines are valid UTF-8; a quote is left open at a line's end; a carriage return stands alone."""

    valid: bool
    open: bool
    bare: bool


def line_facts(spark: SparkSession, path: str) -> LineFacts:
    """What the lines of all files have in common."""
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    found = spark.read.option("lineSep", "\n").text(path).agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("valid"),
        F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("open"),
        F.coalesce(F.bool_or(F.col("value").rlike(r"\r(?!\z)")), F.lit(False)).alias("bare"),
    )
    return LineFacts(*found.first())


# How files are read: in splits of lines, in splits of records, or whole.
LINES, RECORDS, WHOLE = "lines", "records", "whole"


def layout(
    spark: SparkSession, path: str, encoding: str, multi_line: bool | None = None, facts: LineFacts | None = None
) -> str:
    """Files without quoted line breaks are read by lines, others by records.

    Only UTF-16, and line ends or breaks that are a carriage return alone, need whole files.
    """
    if encoding.lower().startswith("utf-16"):
        return WHOLE
    if multi_line is False:
        return LINES
    facts = facts or line_facts(spark, path)
    if not facts.open and not multi_line:
        return LINES
    return WHOLE if facts.bare else RECORDS


def parsed_records(
    found: DataFrame, schema: T.StructType, delimiter: str, mode: str, corrupt: str | None = None
) -> DataFrame:
    """The cells of record texts; a record of another width fails, is filled, or is told in ``corrupt``."""
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in _options(delimiter, "UTF-8", True).items()}
    options |= {"nullValue": NO_NULL, "mode": mode}
    if corrupt is not None:
        options["columnNameOfCorruptRecord"] = corrupt
    cells = F.from_csv("value", _ddl(schema), options).alias("_cells")
    others = [c for c in found.columns if c != "value"]
    return found.select(*others, cells).select(*others, "_cells.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def data_records(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame:
    """(file, number, value) of all records but the headers."""
    return records.read_records(spark, path, delimiter, encoding).filter("number > 0")


def read_header(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", multi_line: bool = False
) -> list[str]:
    """Cells of the first record, exactly as written."""
    reader = spark.read.options(**_options(delimiter, encoding, multi_line))
    first = reader.option("header", False).csv(path).limit(1).collect()
    if not first:
        raise DataError("EMPTY_INPUT", "The delimited file has no header.")
    cells = ["" if c is None else c for c in first[0]]
    if cells:
        cells[0] = cells[0].removeprefix("﻿")
    return cells


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    *,
    encoding: str = "UTF-8",
    relaxed: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """Every value as text. A record of another width fails unless ``relaxed``,
    which fills missing cells with null and drops the overflow.

    Unless ``multi_line`` says so, the lines are looked at first. Files with quoted
    line breaks are read in splits too, by records.
    """
    how = layout(spark, path, encoding, multi_line)
    names = plan_header(read_header(spark, path, delimiter, encoding, how != LINES)).names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    mode = "PERMISSIVE" if relaxed else "FAILFAST"
    if how == RECORDS:
        found = data_records(spark, path, delimiter, encoding).select("value")
        return parsed_records(found, schema, delimiter, mode)
    reader = spark.read.options(**_options(delimiter, encoding, how == WHOLE))
    return (
        reader.option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", NO_NULL)
        .option("mode", mode)
        .schema(schema)
        .csv(path)
    )


def read_typed(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    *,
    encoding: str = "UTF-8",
    text: Sequence[str] = (),
    multi_line: bool | None = None,
) -> DataFrame:
    """Types found over the whole file; an unquoted empty cell is null, ``""`` is not.

    Columns named in ``text`` (codes with leading zeros) stay text. ``multi_line``
    is found from the lines unless it is given.
    """
    how = layout(spark, path, encoding, multi_line)
    reader = (
        spark.read.options(**_options(delimiter, encoding, how != LINES))
        .option("nullValue", NO_NULL)
        .option("mode", "FAILFAST")
    )
    if how == RECORDS:
        found = kept(data_records(spark, path, delimiter, encoding).select("value"), "records")
        inferred = inferred_types(reader.option("header", False).option("inferSchema", True), found)
        names = read_header(spark, path, delimiter, encoding, True)
        given = reader.option("header", True).csv(path).columns  # names as the reader makes them unique
        types = inferred if len(inferred) == len(names) else [T.StringType()] * len(names)
    else:
        reader = reader.option("header", True)
        schema = reader.option("inferSchema", True).csv(path).schema
        given, types = schema.names, [f.dataType for f in schema]
    fields = [T.StructField(n, T.StringType() if n in text else t) for n, t in zip(given, types)]
    if how == RECORDS:
        return parsed_records(found, T.StructType(fields), delimiter, "FAILFAST")
    return reader.schema(T.StructType(fields)).csv(path)


def inferred_types(reader: DataFrameReader, found: DataFrame) -> list[T.DataType]:
    """Types of the columns of record texts, by the reader's own inference over all of them."""
    encoders = found.sparkSession._jvm.org.apache.spark.sql.Encoders
    texts = getattr(found.select("value")._jdf, "as")(encoders.STRING())
    schema = T._parse_datatype_json_string(reader._jreader.csv(texts).schema().json())
    return [f.dataType for f in schema.fields]


def record_width(raw: Column, delimiter: str) -> Column:
    """Number of cells in the text of one record, quotes respected."""
    d = "\\" + delimiter if delimiter in "|." else delimiter
    cell = rf'(?:\A|{d})(?:"(?:[^"]|"")*+"|[^{d}"]*+)'
    return F.size(F.regexp_extract_all(raw, F.lit(cell), F.lit(0)))


def header_issues(spark: SparkSession, header: Sequence[str]) -> DataFrame:
    """DUPLICATE_HEADER and EMPTY_HEADER, from the header cells."""
    plan = plan_header(header)
    base = spark.range(1)
    rows = base.select(*issue("EMPTY_HEADER")).filter(F.lit(False))
    for place in plan.blank:
        rows = rows.unionByName(
            base.select(*issue("EMPTY_HEADER", row=F.lit(1), column=F.lit(place)))
        )
    for place, name in plan.repeated:
        first = F.lit(list(header).index(name) + 1 if name in header else place)
        rows = rows.unionByName(
            base.select(
                *issue(
                    "DUPLICATE_HEADER",
                    arguments=[F.lit(name)],
                    row=F.lit(1),
                    column=F.lit(place),
                    field=F.lit(name),
                    context=F.create_map(F.lit("firstColumn"), first.cast("string")),
                )
            )
        )
    return rows


def validate_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    *,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
) -> DataFrame:
    """All issues of a delimited file: header, widths, then the cells.

    Cell issues are listed one by one, as delimited text has no types. The file
    is read three times: for its lines, for narrow facts of every record (which
    are written and then numbered), and for the types of its columns.
    """
    seen = line_facts(spark, path)
    if encoding.upper() == "UTF-8" and not seen.valid:
        return spark.range(1).select(*issue("INVALID_ENCODING"))
    how = layout(spark, path, encoding, multi_line, seen)
    header = read_header(spark, path, delimiter, encoding, how != LINES)
    names = plan_header(header).names
    fields = [T.StructField(n, T.StringType()) for n in [*names, RAW_COLUMN]]
    if how == RECORDS:
        found = data_records(spark, path, delimiter, encoding)
        rows = parsed_records(found, T.StructType(fields), delimiter, "PERMISSIVE", RAW_COLUMN)
        place, piece = F.col("number"), [F.col("file")]
        pieces = pieces_bound(spark.read.text(path), splits=False)
    else:
        rows, place, piece, pieces = _reader_rows(spark, path, delimiter, encoding, how == WHOLE, fields)
    raw = F.col(RAW_COLUMN)
    facts = rows.select(
        *[c.alias(f"piece_{i}") for i, c in enumerate(piece)],
        place.alias("place"),
        F.when(raw.isNotNull(), record_width(raw, delimiter)).alias("width"),
        *row_facts(rows, names),
    )
    stored = kept(facts, "records")
    keys = [f"piece_{i}" for i in range(len(piece))]
    numbered = number_file_rows(stored, [F.col(k) for k in keys], F.col("place"), pieces=pieces).drop(*keys, "place")
    return _delimited_issues(spark, header, names, numbered, rows.select(*names))


def _reader_rows(
    spark: SparkSession, path: str, delimiter: str, encoding: str, whole: bool, fields: list[T.StructField]
) -> tuple[DataFrame, Column, list[Column], int]:
    """The reader's rows, their place, the piece of a file they are from, and a bound of the pieces."""
    rows = (
        spark.read.options(**_options(delimiter, encoding, whole))
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", NO_NULL)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW_COLUMN)
        .option("columnPruning", False)
        .schema(T.StructType(fields))
        .csv(path)
    )
    piece = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    return rows, F.monotonically_increasing_id(), piece, pieces_bound(rows, splits=True)


def _delimited_issues(
    spark: SparkSession, header: Sequence[str], names: Sequence[str], numbered: DataFrame, rows: DataFrame
) -> DataFrame:
    """Issues of the header, the widths and the cells, from the facts of numbered records."""
    ragged = numbered.filter(F.col("width").isNotNull()).select("row", "width")
    uneven = ragged.filter(F.col("width") != len(names))
    widths = uneven.select(
        *issue(
            "INCONSISTENT_COLUMN_COUNT",
            arguments=[F.col("row"), F.col("width"), F.lit(len(names))],
            row=F.col("row"),
            context=F.create_map(
                F.lit("expected"),
                F.lit(str(len(names))),
                F.lit("actual"),
                F.col("width").cast("string"),
            ),
        )
    )
    malformed = ragged.filter(F.col("width") == len(names)).select(
        *issue("MALFORMED_DELIMITED_DATA", row=F.col("row"))
    )
    # Both name no field, so each shares one issue: its first row, and a count.
    structural = _first_with_count(widths.unionByName(malformed))
    cells = validate_facts(numbered.drop("width"), rows, names, per_cell=True)
    return header_issues(spark, header).unionByName(structural).unionByName(cells)


def _first_with_count(issues: DataFrame) -> DataFrame:
    whole = F.struct(*[F.col(f.name) for f in ISSUE_SCHEMA])
    grouped = issues.groupBy("code").agg(
        F.min_by(whole, "row").alias("first"), F.count(F.lit(1)).alias("n")
    )
    return grouped.select(
        *[
            F.col("n").alias(f.name) if f.name == "occurrences" else F.col(f"first.{f.name}")
            for f in ISSUE_SCHEMA
        ]
    )
