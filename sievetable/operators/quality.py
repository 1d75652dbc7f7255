"""Data-quality validation of a table.

``validate`` reads the table twice: once for column statistics (one aggregate,
one row per task shuffled) and once for row facts. A row fact is narrow - order
key, row fingerprint, list of cell issues - so the wide columns never move.
Equal rows are counted before the shuffle, which makes a group of copies of any
size one record, and everything about duplicates follows from its count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievetable.errors import DataError
from sievetable.functions import cells
from sievetable.messages import DATA_ISSUES, ISSUE_SCHEMA
from sievetable.operators.ordering import expand_counts, running_total
from sievetable.operators.skew import salted_join

_CELLS = "array<struct<code:string,column:int,value:string>>"
FIRST_DATA_ROW = 2  # a header counts as row 1, for every format


@dataclass(frozen=True)
class ValidationLimits:
    """Optional bounds; ``None`` means unbounded, the default on a cluster."""

    max_records: int | None = None
    max_record_bytes: int | None = None
    max_total_bytes: int | None = None
    max_columns: int | None = None


def issue(
    code: str,
    *,
    arguments: Sequence[Column] = (),
    row: Column | None = None,
    column: Column | None = None,
    field: Column | None = None,
    occurrences: Column | None = None,
    context: Column | None = None,
) -> list[Column]:
    """The columns of one issue row, in schema order."""
    severity, message, recommendation = DATA_ISSUES[code]
    text = F.format_string(message, *arguments) if arguments else F.lit(message)
    values = {
        "code": F.lit(code),
        "severity": F.lit(severity),
        "message": text,
        "recommendation": F.lit(recommendation),
        "row": row,
        "column": column,
        "field": field,
        "occurrences": F.lit(1) if occurrences is None else occurrences,
        "context": context,
    }
    return [
        (F.lit(None) if values[f.name] is None else values[f.name]).cast(f.dataType).alias(f.name)
        for f in ISSUE_SCHEMA
    ]


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row, each value prefixed by its length.

    Null and empty text differ, and no value can imitate two others.
    """
    parts = []
    for name in columns or df.columns:
        data_type, value = df.schema[name].dataType, cells.quoted(name)
        if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            text = f"to_json({value}, map('ignoreNullFields', 'false'))"
        elif isinstance(data_type, (T.FloatType, T.DoubleType)):
            text = f"CAST({value} + 0D AS STRING)"
        elif isinstance(data_type, T.BinaryType):
            text = f"hex({value})"
        else:
            text = f"CAST({value} AS STRING)"
        parts.append(f"coalesce(concat(octet_length({text}), ':', {text}), 'n')")
    # Non-null by form: a join on it then does not hash the row a second time.
    return F.expr(f"coalesce(unhex(sha2(concat({', '.join(parts)}), 256)), X'')")


def _ref(name: str) -> Column:
    return F.col(cells.quoted(name))


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, non-null cells, set of types, and both flags.

    Typed columns are counted in place. Text cells are listed per row and
    classified one at a time, so the plan is as small for a thousand columns as
    for one. The two parts read different columns of the table.
    """
    names = list(columns or df.columns)
    fields = [(i + 1, df.schema[name]) for i, name in enumerate(names)]
    text = [(i, f) for i, f in fields if cells.is_text(f.dataType)]
    typed = [(i, f) for i, f in fields if not cells.is_text(f.dataType)]
    parts = []
    if typed:
        parts.append(_typed_stats(df, typed))
    if text:
        parts.append(_text_stats(df, text))
    stats = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    field = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("column"))
    return stats.select(
        field.alias("field"),
        "column",
        "rows",
        "non_null",
        "type_mask",
        cells.type_names(F.col("type_mask")).alias("types"),
        cells.is_mixed(F.col("type_mask")).alias("mixed"),
        ((F.col("rows") > 0) & (F.col("non_null") * 2 <= F.col("rows"))).alias("null_heavy"),
    )


def _typed_stats(df: DataFrame, fields: Sequence[tuple[int, T.StructField]]) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("rows")]
    entries = []
    for i, f in fields:
        value = _ref(f.name)
        aggregates.append(F.count(value).alias(f"n{i}"))
        count = F.col(f"n{i}")
        if cells.is_fractional(f.dataType):
            whole = F.count(F.when(cells.is_whole(value, f.dataType), True))
            aggregates.append(whole.alias(f"w{i}"))
            mask = F.when(F.col(f"w{i}") > 0, F.lit(cells.INTEGER)).otherwise(F.lit(0)) + F.when(
                count > F.col(f"w{i}"), F.lit(cells.DOUBLE)
            ).otherwise(F.lit(0))
        else:
            mask = F.when(count > 0, F.lit(cells.typed_kind(f.dataType))).otherwise(F.lit(0))
        entries.append(
            F.struct(
                F.lit(i).alias("column"),
                F.col("rows").alias("rows"),
                count.alias("non_null"),
                mask.alias("type_mask"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def _text_stats(df: DataFrame, fields: Sequence[tuple[int, T.StructField]]) -> DataFrame:
    listed = F.array(*[_ref(f.name).cast("string") for _, f in fields])
    places = F.array(*[F.lit(i) for i, _ in fields])
    cell = df.select(F.posexplode(listed).alias("at", "text"))
    kinds = cells.with_text_type(cell, "text", "kind").select("at", "kind")
    counted = kinds.groupBy("at").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("kind") != cells.NULL, True)).alias("non_null"),
        F.bit_or("kind").alias("type_mask"),
    )
    counted = _with_empty_table(counted, len(fields))
    return counted.select(
        F.element_at(places, F.col("at") + 1).alias("column"), "rows", "non_null", "type_mask"
    )


def _with_empty_table(counted: DataFrame, width: int) -> DataFrame:
    """Keep a row of zeros per column when the table has no rows."""
    zeros = counted.sparkSession.range(width).select(
        F.col("id").cast("int").alias("at"),
        F.lit(0).cast("bigint").alias("rows"),
        F.lit(0).cast("bigint").alias("non_null"),
        F.lit(0).alias("type_mask"),
    )
    return (
        counted.unionByName(zeros)
        .groupBy("at")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("non_null").alias("non_null"),
            F.bit_or("type_mask").alias("type_mask"),
        )
    )


def _cell_issues(df: DataFrame) -> Column:
    """List of (code, column, value) for the text cells of a row, mostly null."""
    text = [(i + 1, f.name) for i, f in enumerate(df.schema) if cells.is_text(f.dataType)]
    if not text:
        return F.lit(None).cast(_CELLS)
    formula, date = cells.FORMULA_SQL, cells.IMPOSSIBLE_DATE_SQL
    names = [(i, cells.quoted(n)) for i, n in text]
    rare = " OR ".join(f"{formula.format(c=n)} OR {date.format(c=n)}" for _, n in names)
    listed = ", ".join(f"struct({i} AS at, CAST({n} AS STRING) AS text)" for i, n in names)
    # No cell is both: a date starts with a digit.
    found = f"""
        transform(
          filter(array({listed}),
                 x -> coalesce({formula.format(c="x.text")} OR {date.format(c="x.text")}, false)),
          x -> struct(
            if({formula.format(c="x.text")}, 'FORMULA_LIKE_VALUE', 'INVALID_DATE') AS code,
            x.at AS column,
            if({formula.format(c="x.text")}, NULL, x.text) AS value))"""
    return F.expr(f"CASE WHEN {rare} THEN {found} END").cast(_CELLS)


def row_groups(
    df: DataFrame, order_by: Sequence[Column | str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Groups of equal rows with ``first_row``, ``copies`` and cell issues.

    ``order_by`` uses the table's own columns, so equal rows are neighbours in
    the order and share one record whatever their number.
    """
    checked = df.select(*[_ref(c) for c in columns or df.columns])
    order = [_ref(c) if isinstance(c, str) else c for c in order_by]
    names = [f"_o{i}" for i in range(len(order))]
    facts = df.select(
        *[c.alias(n) for c, n in zip(order, names, strict=True)],
        fingerprint(checked).alias("fingerprint"),
        _cell_issues(checked).alias("cells"),
    )
    groups = facts.groupBy(*names, "fingerprint", "cells").agg(F.count(F.lit(1)).alias("copies"))
    placed = running_total(
        groups,
        [*names, "fingerprint"],
        F.col("copies"),
        before="first_row",
        sample=(df, [*order, fingerprint(checked)]),
    )
    return placed.withColumn("first_row", F.col("first_row") + FIRST_DATA_ROW).drop(*names)


def own_order(df: DataFrame) -> list[str | Column]:
    """An order by all columns; by the row's fingerprint where a value has no order."""

    def ordered(data_type: T.DataType) -> bool:
        if isinstance(data_type, T.StructType):
            return all(ordered(f.dataType) for f in data_type)
        if isinstance(data_type, T.ArrayType):
            return ordered(data_type.elementType)
        return not isinstance(data_type, (T.MapType, T.VariantType))

    simple = [f.name for f in df.schema if ordered(f.dataType)]
    return simple if len(simple) == len(df.columns) else [*simple, fingerprint(df)]


def row_positions(
    df: DataFrame, position: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Row facts for a table that already knows each row's number."""
    checked = df.select(*[_ref(c) for c in columns or df.columns if c != position])
    return df.select(
        _ref(position).cast("bigint").alias("row"),
        fingerprint(checked).alias("fingerprint"),
        _cell_issues(checked).alias("cells"),
    )


def _shape(entries: DataFrame, names: Sequence[str]) -> DataFrame:
    """Issue rows from (code, column, value, row, first_row, copies)."""
    field = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("column"))
    place = {"row": F.col("row"), "occurrences": F.col("copies")}
    cell = {**place, "column": F.col("column"), "field": field}
    shapes = {
        "DUPLICATE_ROW": issue(
            "DUPLICATE_ROW",
            arguments=[F.col("row"), F.col("first_row")],
            context=F.create_map(F.lit("duplicateOf"), F.col("first_row").cast("string")),
            **place,
        ),
        "FORMULA_LIKE_VALUE": issue("FORMULA_LIKE_VALUE", **cell),
        "INVALID_DATE": issue("INVALID_DATE", arguments=[F.col("value")], **cell),
    }
    choices = [F.when(F.col("code") == code, F.struct(*shape)) for code, shape in shapes.items()]
    return entries.select(F.coalesce(*choices).alias("issue")).select("issue.*")


def _grouped_entries(entries: DataFrame) -> DataFrame:
    """First row and number of occurrences per kind of issue.

    Cell issues share a group per field; a duplicate keeps a group per set of
    equal rows, named by its first row.
    """
    own = F.when(F.col("code") == "DUPLICATE_ROW", F.col("first_row"))
    return (
        entries.withColumn("own", own)
        .groupBy("code", "column", "own")
        .agg(
            F.min_by("value", "row").alias("value"),
            F.min("row").alias("row"),
            F.min("first_row").alias("first_row"),
            F.sum("copies").alias("copies"),
        )
    )


def _entries_of_groups(groups: DataFrame) -> DataFrame:
    """All issue entries of groups of equal rows, in one pass over them."""
    again = F.array(
        F.struct(
            F.lit("DUPLICATE_ROW").alias("code"),
            F.lit(None).cast("int").alias("column"),
            F.lit(None).cast("string").alias("value"),
        )
    )
    nothing = F.array().cast(_CELLS)
    found = F.concat(
        F.when(F.col("copies") > 1, again.cast(_CELLS)).otherwise(nothing),
        F.coalesce("cells", nothing),
    )
    flagged = groups.filter((F.col("copies") > 1) | F.col("cells").isNotNull())
    exploded = flagged.select("first_row", "copies", F.inline(found))
    duplicate = F.col("code") == "DUPLICATE_ROW"
    return exploded.withColumn(
        "row", F.when(duplicate, F.col("first_row") + 1).otherwise(F.col("first_row"))
    ).withColumn("copies", F.when(duplicate, F.col("copies") - 1).otherwise(F.col("copies")))


def column_issues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """MIXED_TYPES and NULL_HEAVY_COLUMN."""
    stats = column_stats(df, columns)
    counts = F.create_map(
        F.lit("nullCount"),
        (F.col("rows") - F.col("non_null")).cast("string"),
        F.lit("rowCount"),
        F.col("rows").cast("string"),
    )
    mixed = stats.filter("mixed").select(
        *issue(
            "MIXED_TYPES",
            arguments=[F.col("field")],
            field=F.col("field"),
            column=F.col("column"),
            context=F.create_map(F.lit("types"), F.col("types")),
        )
    )
    heavy = stats.filter("null_heavy").select(
        *issue(
            "NULL_HEAVY_COLUMN",
            arguments=[F.col("field")],
            field=F.col("field"),
            column=F.col("column"),
            context=counts,
        )
    )
    return mixed.unionByName(heavy)


def duplicate_rows(
    df: DataFrame,
    order_by: Sequence[Column | str] | None = None,
    *,
    position: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per group of equal rows: first row, second row, copies."""
    if position is None:
        return _duplicate_groups(row_groups(df, order_by or own_order(df), columns))
    return _duplicate_groups_by_position(row_positions(df, position, columns))


def _duplicate_groups(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("copies") > 1).select(
        "first_row", (F.col("first_row") + 1).alias("second_row"), "copies"
    )


def _repeats_by_position(facts: DataFrame) -> DataFrame:
    """Every row that has an equal earlier row, with that first row."""
    rows = facts.select("fingerprint", "row")
    groups = (
        rows.groupBy("fingerprint")
        .agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )
    joined = salted_join(rows, groups, ["fingerprint"], "copies", spread_by=["row"])
    return joined.filter(F.col("row") > F.col("first_row"))


def _duplicate_groups_by_position(facts: DataFrame) -> DataFrame:
    return (
        _repeats_by_position(facts)
        .groupBy("fingerprint")
        .agg(
            F.min("first_row").alias("first_row"),
            F.min("row").alias("second_row"),
            F.max("copies").alias("copies"),
        )
        .drop("fingerprint")
    )


def validate(
    df: DataFrame,
    order_by: Sequence[Column | str] | None = None,
    *,
    position: str | None = None,
    columns: Sequence[str] | None = None,
    per_cell: bool = False,
    per_duplicate: bool = False,
    limits: ValidationLimits | None = None,
) -> DataFrame:
    """All data issues of a table.

    Rows are numbered by ``order_by`` (columns of the table) or taken from a
    unique ``position`` column. Cell issues are grouped per field with a count
    unless ``per_cell``; duplicates are grouped per set of equal rows unless
    ``per_duplicate``.
    """
    if limits is not None:
        check_limits(df, limits)
    if position is not None:
        columns = [c for c in columns or df.columns if c != position]
        facts = row_positions(df, position, columns)
        return validate_facts(facts, df, columns, per_cell=per_cell, per_duplicate=per_duplicate)
    else:
        entries = _entries_of_groups(row_groups(df, order_by or own_order(df), columns))
        if not per_cell and not per_duplicate:
            entries = _grouped_entries(entries)
        else:
            entries = _spread_entries(entries, per_cell, per_duplicate)
    shaped = _shape(entries, list(columns or df.columns))
    return shaped.unionByName(column_issues(df, columns))


def row_facts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """``fingerprint`` and ``cells`` of a row, from its columns to be checked."""
    checked = df.select(*[_ref(c) for c in columns])
    return [fingerprint(checked).alias("fingerprint"), _cell_issues(checked).alias("cells")]


def validate_facts(
    facts: DataFrame,
    df: DataFrame,
    columns: Sequence[str],
    *,
    per_cell: bool = False,
    per_duplicate: bool = False,
) -> DataFrame:
    """All data issues from numbered row facts, and of the columns from the table."""
    entries = _entries_by_position(facts, per_duplicate)
    if not per_cell and not per_duplicate:
        entries = _grouped_entries(entries)
    elif not per_cell:
        entries = _group_only(entries, cells_only=True)
    return _shape(entries, list(columns)).unionByName(column_issues(df, columns))


def _entries_by_position(facts: DataFrame, per_duplicate: bool) -> DataFrame:
    if per_duplicate:
        repeats = _repeats_by_position(facts).select("row", "first_row", F.lit(1).alias("copies"))
    else:
        repeats = _duplicate_groups_by_position(facts).select(
            F.col("second_row").alias("row"), "first_row", (F.col("copies") - 1).alias("copies")
        )
    repeats = repeats.withColumns(
        {
            "code": F.lit("DUPLICATE_ROW"),
            "column": F.lit(None).cast("int"),
            "value": F.lit(None).cast("string"),
        }
    )
    flagged = facts.filter(F.col("cells").isNotNull()).select(
        "row", F.col("row").alias("first_row"), F.lit(1).alias("copies"), F.inline("cells")
    )
    return repeats.unionByName(flagged)


def _group_only(entries: DataFrame, *, cells_only: bool) -> DataFrame:
    """Group the cell issues (or the duplicates) and keep the others as they are."""
    duplicate = F.col("code") == "DUPLICATE_ROW"
    chosen = ~duplicate if cells_only else duplicate
    kept = ["code", "column", "value", "row", "first_row", "copies"]
    grouped = _grouped_entries(entries.filter(chosen)).select(*kept)
    return grouped.unionByName(entries.filter(~chosen).select(*kept))


def _spread_entries(entries: DataFrame, per_cell: bool, per_duplicate: bool) -> DataFrame:
    """One entry per occurrence for the chosen kinds of issue."""
    duplicate = F.col("code") == "DUPLICATE_ROW"
    chosen = (duplicate & F.lit(per_duplicate)) | (~duplicate & F.lit(per_cell))
    kept = ["code", "column", "value", "row", "first_row", "copies"]
    single = (
        expand_counts(entries.filter(chosen), "copies")
        .withColumn("row", F.col("row") + F.col("copy"))
        .withColumn("copies", F.lit(1).cast("bigint"))
        .select(*kept)
    )
    whole = entries.filter(~chosen)
    if not per_cell:
        whole = _grouped_entries(whole)
    return single.unionByName(whole.select(*kept))


def check_limits(df: DataFrame, limits: ValidationLimits) -> None:
    """Raise the matching ``VALIDATION_*`` error when a bound is exceeded."""
    if limits.max_columns is not None and len(df.columns) > limits.max_columns:
        raise DataError(
            "VALIDATION_COLUMN_LIMIT", "Validation column limit exceeded.", limit=limits.max_columns
        )
    if limits.max_records is None and limits.max_record_bytes is None:
        if limits.max_total_bytes is None:
            return
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    seen = df.select(size.alias("size")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("size").alias("widest"), F.sum("size").alias("bytes")
    )
    found = seen.first()
    checks = (
        ("VALIDATION_RECORD_LIMIT", found.rows, limits.max_records),
        ("VALIDATION_RECORD_TOO_LARGE", found.widest or 0, limits.max_record_bytes),
        ("VALIDATION_TOTAL_BYTES_LIMIT", found.bytes or 0, limits.max_total_bytes),
    )
    for code, actual, bound in checks:
        if bound is not None and actual > bound:
            raise DataError(code, "A validation bound is exceeded.", limit=bound, actual=actual)


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues and occurrences per severity."""
    return issues.groupBy("severity").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("occurrences").alias("occurrences")
    )


def verdict(issues: DataFrame) -> DataFrame:
    """One row: counts per severity, and valid when there is no error."""
    counts = [
        F.count_if(F.col("severity") == s).alias(name)
        for s, name in (
            ("error", "errors"),
            ("warning", "warnings"),
            ("recommendation", "recommendations"),
        )
    ]
    return issues.agg(*counts).select((F.col("errors") == 0).alias("valid"), "*")
