"""Cell classification shared by validation, inference and export.

A cell's type is an integer code with one bit per type, so the *set* of types
in a column is one ``bit_or`` aggregate: no unpivot, no collected set and no
shuffle beyond one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The seven cell types and the bit that stands for each.
NULL, BOOLEAN, INTEGER, DOUBLE, DATE, TIMESTAMP, STRING = 0, 1, 2, 4, 8, 16, 32
TYPE_NAMES = {
    BOOLEAN: "boolean",
    INTEGER: "integer",
    DOUBLE: "double",
    DATE: "date",
    TIMESTAMP: "timestamp",
    STRING: "string",
}

# Text patterns of the types. Surrounding whitespace is ignored.
_WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*"
_DAY = r"\d{4}-\d{2}-\d{2}"
BOOLEAN_TEXT = r"(?i:true|false)"
INTEGER_TEXT = r"[+-]?\d+"
DOUBLE_TEXT = r"[+-]?(?:\d+\.\d*|\d*\.\d+|\d+[eE][+-]?\d+)"
TIMESTAMP_TEXT = (
    r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T"
    r"(?:(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?|24:00(?::00(?:\.0+)?)?)"
    r"(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?"
)
EXACT_DATE_TEXT = rf"\A{_DAY}\z"

# Code points that a typed value can start with: + - . 0-9, and T t F f.
_NUMBER_STARTS = [43, 45, 46, *range(48, 58)]
_BOOLEAN_STARTS = [84, 116, 70, 102]

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _real_day(text: Column) -> Column:
    """Text of date shape names a real day from year 0100 on."""
    return (text >= F.lit("0100")) & text.try_cast("date").isNotNull()


def calendar_date(text: Column) -> Column:
    """The real calendar date in ``YYYY-MM-DD`` text, else null.

    Years before 0100 are refused, as are dates such as 30 February.
    """
    day = F.regexp_extract(text, rf"\A{_WS}({_DAY}){_WS}\z", 1)
    return F.when(_real_day(day), day.try_cast("date"))


def lead_trimmed(text: Column) -> Column:
    """Text without leading whitespace, unless it is nothing but whitespace."""
    bare = F.nullif(F.regexp_replace(text, rf"\A{_WS}", ""), F.lit(""))
    return F.when(F.ascii(text).between(33, 126), text).otherwise(F.coalesce(bare, text))


def _is_bare_date(text: Column) -> Column:
    dashed = (F.octet_length(text) == 10) & (F.substring(text, 5, 1) == "-")
    return dashed & text.rlike(EXACT_DATE_TEXT) & _real_day(text)


def trimmed_text_type(text: Column) -> Column:
    """Type bit of text that ``lead_trimmed`` gave.

    The first code point settles most text without a pattern.
    """
    number = F.ascii(text).isin(*_NUMBER_STARTS)
    padded = (F.octet_length(text) > 10) & calendar_date(text).isNotNull()
    timed = (F.octet_length(text) > 15) & text.rlike(rf"\A{TIMESTAMP_TEXT}{_WS}\z")
    return (
        F.when(text.isNull() | (text == ""), F.lit(NULL))
        .when(F.ascii(text).isin(*_BOOLEAN_STARTS) & text.rlike(rf"\A{BOOLEAN_TEXT}{_WS}\z"), F.lit(BOOLEAN))
        .when(~number, F.lit(STRING))
        .when(_is_bare_date(text), F.lit(DATE))
        .when(text.rlike(rf"\A{INTEGER_TEXT}{_WS}\z"), F.lit(INTEGER))
        .when(text.rlike(rf"\A{DOUBLE_TEXT}{_WS}\z"), F.lit(DOUBLE))
        .when(padded, F.lit(DATE))
        .when(timed, F.lit(TIMESTAMP))
        .otherwise(F.lit(STRING))
    )


def text_type(text: Column) -> Column:
    """Type bit of one text cell (0 for null and for exactly empty text)."""
    return trimmed_text_type(lead_trimmed(text))


def with_text_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Add the type bit of a text column, trimming each cell once.

    Two steps keep the generated code short enough for the JVM to compile.
    """
    trimmed = df.withColumn("_trimmed", lead_trimmed(F.col(column)))
    return trimmed.withColumn(kind, trimmed_text_type(F.col("_trimmed"))).drop("_trimmed")


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType))


def is_whole(column: Column, data_type: T.DataType) -> Column:
    """Fractional-typed cell that holds a whole number."""
    whole = column == F.floor(column)
    if isinstance(data_type, T.DecimalType):
        return whole
    magnitude = F.abs(column)
    finite = ~F.isnan(column) & (magnitude != F.lit(float("inf")))
    return finite & ((magnitude >= F.lit(2.0**53)) | whole)


def typed_kind(data_type: T.DataType) -> int:
    """Type bit that every non-null cell of a typed, non-fractional column has."""
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, _INTEGRAL):
        return INTEGER
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    return STRING


def cell_type(column: Column, data_type: T.DataType) -> Column:
    """Type bit of a cell of any Spark type.

    Typed columns need no text test: only whether the cell is null and, for
    fractional numbers, whether the value is whole.
    """
    if is_text(data_type):
        return text_type(column)
    if is_fractional(data_type):
        found = F.when(is_whole(column, data_type), F.lit(INTEGER)).otherwise(F.lit(DOUBLE))
    else:
        found = F.lit(typed_kind(data_type))
    return F.when(column.isNotNull(), found).otherwise(F.lit(NULL))


# The two cell checks as SQL text, so that a check over many columns is one
# expression string rather than many small objects.
FORMULA_SQL = "substring({c}, 1, 1) IN ('=', '+', '-', '@')"
IMPOSSIBLE_DATE_SQL = (
    rf"(octet_length({{c}}) = 10 AND {{c}} RLIKE r'\A\d{{{{4}}}}-\d{{{{2}}}}-\d{{{{2}}}}\z'"
    " AND NOT ({c} >= '0100' AND try_cast({c} AS DATE) IS NOT NULL))"
)


def quoted(name: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def is_formula_like(name: str) -> Column:
    """The named text column holds what a spreadsheet would run as a formula."""
    return F.expr(FORMULA_SQL.format(c=quoted(name)))


def is_impossible_date(name: str) -> Column:
    """The named text column is shaped like a date that the calendar does not have."""
    return F.expr(IMPOSSIBLE_DATE_SQL.format(c=quoted(name)))


def type_names(mask: Column) -> Column:
    """Sorted, comma-joined names of the types in a bit mask."""
    names = [
        F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name))
        for bit, name in sorted(TYPE_NAMES.items(), key=lambda item: item[1])
    ]
    return F.concat_ws(",", *names)


def is_mixed(mask: Column) -> Column:
    """More than one type, other than whole numbers beside fractional ones."""
    return (F.bit_count(mask) > 1) & (mask != F.lit(INTEGER | DOUBLE))


def merged_type(mask: Column) -> Column:
    """The one type a column is reported as."""
    merged = F.when(mask == F.lit(INTEGER | DOUBLE), F.lit("double"))
    for bit, name in TYPE_NAMES.items():
        merged = merged.when(mask == F.lit(bit), F.lit(name))
    return merged.otherwise(F.lit("string"))


def typed_literal(text: str) -> bool | int | float | str:
    """A filter value written as text: boolean, then number, then text."""
    import re

    if re.fullmatch(r"(?i)true|false", text):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?\d*\.\d+", text):
        return float(text)
    return text


def typed_literal_kind(text: Column) -> Column:
    """Kind of literal each text cell would be read as."""
    return (
        F.when(text.rlike(r"(?i)\A(?:true|false)\z"), F.lit("boolean"))
        .when(text.rlike(r"\A[+-]?(?:\d+|\d*\.\d+)\z"), F.lit("number"))
        .when(text.isNotNull(), F.lit("string"))
    )


def is_canonical_timestamp(text: Column) -> Column:
    """UTC timestamp with exactly three fraction digits that round-trips."""
    shaped = text.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z")
    parsed = F.try_to_timestamp(
        F.regexp_replace(text, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")
    )
    echoed = F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(shaped & (echoed == text), F.lit(False))
