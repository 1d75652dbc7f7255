"""Conservative schema inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetable.functions import cells
from sievetable.operators.quality import column_stats

SAMPLE_ROWS = 500
EVIDENCE = 3
HEAD_ROWS = 200


def infer_schema(
    df: DataFrame,
    order_by: Sequence[Column | str],
    *,
    sample_rows: int | None = None,
    code_columns: Sequence[str] = (),
) -> DataFrame:
    """One row per column: name, type, nullable, first distinct values, rows seen.

    The whole table is read unless ``sample_rows`` asks for the first rows only
    (``SAMPLE_ROWS`` for a preview). A sample that leaves rows out makes every
    column nullable, since the rest may hold nulls.
    """
    order = [F.col(cells.quoted(c)) if isinstance(c, str) else c for c in order_by]
    if sample_rows is None:
        seen, truncated = df, F.lit(False)
    else:
        # Top-k by the order: at most sample_rows + 1 rows leave the scan.
        head = df.orderBy(*order).limit(sample_rows + 1)
        rank = F.row_number().over(Window.orderBy(*order))
        seen = head.withColumn("_rank", rank).filter(F.col("_rank") <= sample_rows).drop("_rank")
        truncated = head.agg((F.count(F.lit(1)) > sample_rows).alias("t")).scalar()
    stats = column_stats(seen, df.columns)
    evidence = first_values(seen, order, df.columns)
    shown = F.lit(None).cast("array<string>")
    for name, values in evidence.items():
        listed = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        shown = F.when(F.col("field") == name, listed).otherwise(shown)
    merged = cells.merged_type(F.col("type_mask"))
    declared = F.col("field").isin(*code_columns) if code_columns else F.lit(False)
    return stats.select(
        F.col("column"),
        F.col("field").alias("name"),
        F.when(declared, F.lit("string")).otherwise(merged).alias("type"),
        (truncated | (F.col("non_null") < F.col("rows"))).alias("nullable"),
        shown.alias("evidence"),
        F.col("rows").alias("sampled_rows"),
    )


def first_values(
    df: DataFrame, order: Sequence[Column], columns: Sequence[str]
) -> dict[str, list[str]]:
    """The first three distinct non-empty values of each column, in row order.

    The first rows settle most columns. For the others the search goes on over
    the whole table with the values known so far, one aggregate per value: no
    set of distinct values is built, and the driver sees three per column.
    """
    texts = [F.col(cells.quoted(c)).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in df.orderBy(*order).limit(HEAD_ROWS).select(*texts).collect():
        for i, name in enumerate(columns):
            value, known = row[i], found[name]
            if value and value not in known and len(known) < EVIDENCE:
                known.append(value)
    position = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    open_columns = [c for c in columns if len(found[c]) < EVIDENCE]
    while open_columns:
        aggregates = []
        for i, name in enumerate(open_columns):
            value = F.col(cells.quoted(name)).cast("string")
            wanted = value.isNotNull() & ~value.isin("", *found[name])
            aggregates.append(F.min_by(value, F.when(wanted, position)).alias(f"v{i}"))
        row = df.agg(*aggregates).first()
        added = [(name, row[i]) for i, name in enumerate(open_columns) if row[i] is not None]
        for name, value in added:
            found[name].append(value)
        open_columns = [name for name, _ in added if len(found[name]) < EVIDENCE]
    return found


def layer_schema(df: DataFrame) -> DataFrame:
    """The declared schema as rows: name, type, nullable."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")
