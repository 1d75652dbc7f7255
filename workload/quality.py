"""Validation and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievetable.operators import inference, quality
from workload.registry import query
from workload.views import ORDERS_DIRTY_COLUMNS, ORDERS_DIRTY_SQL, orders_dirty, table, text_type_sql


def _order():
    return [F.col("o_orderkey").cast("bigint")]


def _stats_sql(relation: str, columns: list[str]) -> str:
    """Column statistics of text columns in DuckDB SQL."""
    kinds = ", ".join(f"{text_type_sql(c)} AS {c}" for c in columns)
    return f"""
kinds AS (SELECT {kinds} FROM {relation}),
cell AS (UNPIVOT kinds ON {", ".join(columns)} INTO NAME field VALUE kind),
stats AS (
  SELECT field, count(*) AS rows, count(*) FILTER (kind <> 'null') AS non_null,
         coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (kind <> 'null'), '') AS types,
         count(DISTINCT kind) FILTER (kind <> 'null') > 1
           AND NOT (count(DISTINCT kind) FILTER (kind <> 'null') = 2
                    AND count(*) FILTER (kind NOT IN ('null', 'integer', 'double')) = 0) AS mixed,
         count(*) FILTER (kind <> 'null') * 2 <= count(*) AS null_heavy
  FROM cell GROUP BY field)"""


_DIRTY = f"WITH {ORDERS_DIRTY_SQL}"
_DIRTY_STATS = f"{_DIRTY}, {_stats_sql('dirty', ORDERS_DIRTY_COLUMNS)}"


@query("dq_column_stats", f"{_DIRTY_STATS} SELECT * FROM stats")
def dq_column_stats(spark, sf_dir):
    stats = quality.column_stats(orders_dirty(spark, sf_dir))
    return stats.drop("column", "type_mask")


@query(
    "dq_column_stats_typed",
    """
SELECT 'l_orderkey' AS field, count(*) AS rows, count(l_orderkey) AS non_null, 'integer' AS types FROM lineitem
UNION ALL SELECT 'l_partkey', count(*), count(l_partkey), 'integer' FROM lineitem
UNION ALL SELECT 'l_suppkey', count(*), count(l_suppkey), 'integer' FROM lineitem
UNION ALL SELECT 'l_linenumber', count(*), count(l_linenumber), 'integer' FROM lineitem
UNION ALL SELECT 'l_quantity', count(*), count(l_quantity),
  CASE WHEN bool_and(l_quantity = floor(l_quantity)) THEN 'integer'
       WHEN bool_or(l_quantity = floor(l_quantity)) THEN 'double,integer' ELSE 'double' END FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(*), count(l_extendedprice),
  CASE WHEN bool_and(l_extendedprice = floor(l_extendedprice)) THEN 'integer'
       WHEN bool_or(l_extendedprice = floor(l_extendedprice)) THEN 'double,integer' ELSE 'double' END FROM lineitem
UNION ALL SELECT 'l_discount', count(*), count(l_discount),
  CASE WHEN bool_and(l_discount = floor(l_discount)) THEN 'integer'
       WHEN bool_or(l_discount = floor(l_discount)) THEN 'double,integer' ELSE 'double' END FROM lineitem
UNION ALL SELECT 'l_tax', count(*), count(l_tax),
  CASE WHEN bool_and(l_tax = floor(l_tax)) THEN 'integer'
       WHEN bool_or(l_tax = floor(l_tax)) THEN 'double,integer' ELSE 'double' END FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), count(l_returnflag), 'string' FROM lineitem
UNION ALL SELECT 'l_linestatus', count(*), count(l_linestatus), 'string' FROM lineitem
UNION ALL SELECT 'l_shipdate', count(*), count(l_shipdate), 'timestamp' FROM lineitem
""",
)
def dq_column_stats_typed(spark, sf_dir):
    stats = quality.column_stats(table(spark, sf_dir, "lineitem"))
    return stats.select("field", "rows", "non_null", "types")


@query(
    "dq_duplicate_rows",
    f"""{_DIRTY}
SELECT min(rn) AS first_row, min(rn) + 1 AS second_row, count(*) AS copies
FROM dirty GROUP BY k HAVING count(*) > 1""",
)
def dq_duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(orders_dirty(spark, sf_dir), _order())


@query(
    "dq_doc_duplicates",
    """
SELECT min(doc_id) + 2 AS first_row, list_sort(list(doc_id))[2] + 2 AS second_row, count(*) AS copies
FROM documents GROUP BY text HAVING count(*) > 1""",
)
def dq_doc_duplicates(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("text", (F.col("doc_id") + 2).alias("row"))
    return quality.duplicate_rows(documents, position="row")


@query(
    "dq_events_repeats",
    """
SELECT min(event_id) + 2 AS first_row, list_sort(list(event_id))[2] + 2 AS second_row,
       count(*) AS copies
FROM events GROUP BY event_type, user_id % 3 HAVING count(*) > 1""",
)
def dq_events_repeats(spark, sf_dir):
    """Fifteen groups hold every row: the skewed case."""
    events = table(spark, sf_dir, "events").select(
        "event_type", (F.col("user_id") % 3).alias("third"), (F.col("event_id") + 2).alias("row")
    )
    return quality.duplicate_rows(events, position="row")


def _issues_sql() -> str:
    formula = "regexp_matches({c}, '^[=+@-]')"
    bad_date = (
        "regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
        " AND NOT ({c} >= '0100' AND try_cast({c} AS DATE) IS NOT NULL)"
    )
    cells = []
    for c in ORDERS_DIRTY_COLUMNS:
        cells.append(
            f"SELECT 'FORMULA_LIKE_VALUE' AS code, '{c}' AS field, rn, {c} AS value FROM dirty"
            f" WHERE {formula.format(c=c)}"
        )
        cells.append(
            f"SELECT 'INVALID_DATE', '{c}', rn, {c} FROM dirty WHERE {bad_date.format(c=c)}"
        )
    return f"{_DIRTY_STATS}, cell_issue AS ({' UNION ALL '.join(cells)})"


_TEXTS = """
CASE code WHEN 'FORMULA_LIKE_VALUE' THEN 'A value begins with a spreadsheet formula trigger.'
     ELSE 'Value ''' || value || ''' looks like an invalid calendar date.' END AS message,
CASE code WHEN 'FORMULA_LIKE_VALUE' THEN 'Treat the value as untrusted text.'
     ELSE 'Use a real YYYY-MM-DD date.' END AS recommendation"""

_COLUMN_ISSUES = """
SELECT 'MIXED_TYPES' AS code, 'warning' AS severity,
       'Column ''' || field || ''' contains mixed value types.' AS message,
       'Normalize the column to one type.' AS recommendation,
       NULL::BIGINT AS row, field, 1::BIGINT AS occurrences FROM stats WHERE mixed
UNION ALL
SELECT 'NULL_HEAVY_COLUMN', 'warning', 'Column ''' || field || ''' is at least 50% empty.',
       'Document missing values.', NULL, field, 1 FROM stats WHERE null_heavy"""

_GROUPED = f"""{_issues_sql()}, first_cell AS (
  SELECT code, field, min(rn) AS row, arg_min(value, rn) AS value, count(*) AS occurrences
  FROM cell_issue GROUP BY code, field),
all_issues AS (
  SELECT 'DUPLICATE_ROW' AS code, 'warning' AS severity,
         'Row ' || (min(rn) + 1) || ' duplicates row ' || min(rn) || '.' AS message,
         'Confirm the duplicate is intentional or remove it.' AS recommendation,
         min(rn) + 1 AS row, NULL AS field, count(*) - 1 AS occurrences
  FROM dirty GROUP BY k HAVING count(*) > 1
  UNION ALL
  SELECT code, 'warning', {_TEXTS}, row, field, occurrences FROM first_cell
  UNION ALL {_COLUMN_ISSUES})"""

ISSUE_COLUMNS = ["code", "severity", "message", "recommendation", "row", "field", "occurrences"]


@query("dq_issues_grouped", f"{_GROUPED} SELECT * FROM all_issues")
def dq_issues_grouped(spark, sf_dir):
    return quality.validate(orders_dirty(spark, sf_dir), _order()).select(*ISSUE_COLUMNS)


_PER_CELL = f"""{_issues_sql()}, firsts AS (
  SELECT k, min(rn) AS first_row FROM dirty GROUP BY k),
all_issues AS (
  SELECT 'DUPLICATE_ROW' AS code, 'warning' AS severity,
         'Row ' || rn || ' duplicates row ' || first_row || '.' AS message,
         'Confirm the duplicate is intentional or remove it.' AS recommendation,
         rn AS row, NULL AS field, 1::BIGINT AS occurrences
  FROM dirty JOIN firsts USING (k) WHERE rn > first_row
  UNION ALL
  SELECT code, 'warning', {_TEXTS}, rn, field, 1 FROM cell_issue
  UNION ALL {_COLUMN_ISSUES})"""


@query("dq_issues_per_cell", f"{_PER_CELL} SELECT * FROM all_issues")
def dq_issues_per_cell(spark, sf_dir):
    issues = quality.validate(
        orders_dirty(spark, sf_dir), _order(), per_cell=True, per_duplicate=True
    )
    return issues.select(*ISSUE_COLUMNS)


@query(
    "dq_formula_cells",
    f"""{_issues_sql()} SELECT field, rn AS row FROM cell_issue WHERE code = 'FORMULA_LIKE_VALUE'""",
)
def dq_formula_cells(spark, sf_dir):
    issues = quality.validate(orders_dirty(spark, sf_dir), _order(), per_cell=True)
    return issues.filter("code = 'FORMULA_LIKE_VALUE'").select("field", "row")


@query(
    "dq_invalid_dates",
    f"""{_issues_sql()} SELECT field, rn AS row,
 'Value ''' || value || ''' looks like an invalid calendar date.' AS message
 FROM cell_issue WHERE code = 'INVALID_DATE'""",
)
def dq_invalid_dates(spark, sf_dir):
    issues = quality.validate(orders_dirty(spark, sf_dir), _order(), per_cell=True)
    return issues.filter("code = 'INVALID_DATE'").select("field", "row", "message")


@query("dq_mixed_types", f"{_DIRTY_STATS} SELECT field, types FROM stats WHERE mixed")
def dq_mixed_types(spark, sf_dir):
    issues = quality.column_issues(orders_dirty(spark, sf_dir)).filter("code = 'MIXED_TYPES'")
    return issues.select("field", F.col("context")["types"].alias("types"))


@query(
    "dq_null_heavy",
    f"""{_DIRTY_STATS} SELECT field, CAST(rows - non_null AS VARCHAR) AS empty_cells,
 CAST(rows AS VARCHAR) AS rows FROM stats WHERE null_heavy""",
)
def dq_null_heavy(spark, sf_dir):
    issues = quality.column_issues(orders_dirty(spark, sf_dir)).filter("code = 'NULL_HEAVY_COLUMN'")
    context = F.col("context")
    return issues.select(
        "field", context["nullCount"].alias("empty_cells"), context["rowCount"].alias("rows")
    )


@query(
    "dq_severity_rollup",
    f"""{_GROUPED} SELECT severity, count(*) AS issues, CAST(sum(occurrences) AS BIGINT) AS occurrences
 FROM all_issues GROUP BY severity""",
)
def dq_severity_rollup(spark, sf_dir):
    return quality.severity_counts(quality.validate(orders_dirty(spark, sf_dir), _order()))


@query(
    "dq_verdict",
    f"""{_GROUPED} SELECT count(*) FILTER (severity = 'error') = 0 AS valid,
 count(*) FILTER (severity = 'error') AS errors,
 count(*) FILTER (severity = 'warning') AS warnings,
 count(*) FILTER (severity = 'recommendation') AS recommendations FROM all_issues""",
)
def dq_verdict(spark, sf_dir):
    return quality.verdict(quality.validate(orders_dirty(spark, sf_dir), _order()))


def _evidence_sql(relation: str, columns: list[str], order: str) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS name, coalesce(string_agg(v, '|' ORDER BY o), '') AS evidence FROM (
  SELECT CAST({c} AS VARCHAR) AS v, min({order}) AS o FROM {relation}
  WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' GROUP BY {c}
  ORDER BY o LIMIT 3)"""
        )
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


_MERGED = """CASE WHEN types = '' THEN 'string' WHEN types = 'double,integer' THEN 'double'
 WHEN position(',' IN types) > 0 THEN 'string' ELSE types END"""


@query(
    "infer_schema_dirty",
    f"""{_DIRTY_STATS}, ev AS ({_evidence_sql("dirty", ORDERS_DIRTY_COLUMNS, "rn")})
SELECT name, CASE WHEN name = 'o_custkey' THEN 'string' ELSE {_MERGED} END AS type,
       non_null < rows AS nullable, evidence, rows AS sampled_rows
FROM stats JOIN ev ON field = name""",
)
def infer_schema_dirty(spark, sf_dir):
    dirty = orders_dirty(spark, sf_dir)
    found = inference.infer_schema(
        dirty, _order(), sample_rows=None, code_columns=["o_custkey"]
    )
    return found.select(
        "name", "type", "nullable", F.array_join("evidence", "|").alias("evidence"), "sampled_rows"
    )


_SAMPLE = _DIRTY + ", head AS (SELECT * FROM dirty ORDER BY rn LIMIT 500)"


@query(
    "infer_schema_sample",
    f"""{_SAMPLE}, {_stats_sql("head", ORDERS_DIRTY_COLUMNS)},
ev AS ({_evidence_sql("head", ORDERS_DIRTY_COLUMNS, "rn")})
SELECT name, {_MERGED} AS type, true AS nullable, evidence, rows AS sampled_rows
FROM stats JOIN ev ON field = name""",
)
def infer_schema_sample(spark, sf_dir):
    found = inference.infer_schema(
        orders_dirty(spark, sf_dir), _order(), sample_rows=inference.SAMPLE_ROWS
    )
    return found.select(
        "name", "type", "nullable", F.array_join("evidence", "|").alias("evidence"), "sampled_rows"
    )


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query(
    "infer_schema_lineitem",
    f"""WITH ranked AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS rn FROM lineitem),
ev AS ({_evidence_sql("ranked", _LINE_COLUMNS, "rn")})
SELECT name, CASE WHEN name IN ('l_returnflag', 'l_linestatus') THEN 'string' ELSE 'integer' END AS type,
       false AS nullable, evidence, (SELECT count(*) FROM lineitem) AS sampled_rows FROM ev""",
)
def infer_schema_lineitem(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    order = [
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
    ]
    found = inference.infer_schema(lineitem, order, sample_rows=None)
    return found.filter(F.col("name").isin(*_LINE_COLUMNS)).select(
        "name", "type", "nullable", F.array_join("evidence", "|").alias("evidence"), "sampled_rows"
    )


@query(
    "cell_types_documents",
    f"""SELECT {text_type_sql("line")} AS kind, count(*) AS cells
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""",
)
def cell_types_documents(spark, sf_dir):
    """Type of every line of every document."""
    from sievetable.functions import cells

    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    typed = cells.with_text_type(lines, "line", "kind")
    counted = typed.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"))
    named = F.when(F.col("kind") == 0, "null").otherwise(cells.type_names(F.col("kind")))
    return counted.select(named.alias("kind"), "cells")
