"""Export, selection, bounded SQL, workbench and presentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievetable.functions import cells, geo, text
from sievetable.operators import export, presentation, selection, workbench
from sievetable.operators.ordering import with_row_numbers
from sievetable.plans import bounded
from workload.registry import query
from workload.views import ORDERS_DIRTY_COLUMNS, ORDERS_DIRTY_SQL, orders_dirty, table

_DIRTY = f"WITH {ORDERS_DIRTY_SQL}"

LINES_PER_TASK = 250_000


@query(
    "spreadsheet_safe",
    f"""{_DIRTY} SELECT o_orderkey, CASE WHEN regexp_matches(note, '^[=+@-]') THEN '''' || note
 ELSE note END AS note, due, sparse, mixed FROM dirty""",
)
def spreadsheet_safe(spark, sf_dir):
    safe = export.spreadsheet_safe(orders_dirty(spark, sf_dir))
    return safe.select("o_orderkey", "note", "due", "sparse", "mixed")


@query(
    "spreadsheet_risk_count",
    f"""{_DIRTY} SELECT CAST({
        " + ".join(
            f"count(*) FILTER (regexp_matches({c}, '^[=+@-]'))" for c in ORDERS_DIRTY_COLUMNS
        )
    } AS BIGINT) AS risks FROM dirty""",
)
def spreadsheet_risk_count(spark, sf_dir):
    return export.spreadsheet_risks(orders_dirty(spark, sf_dir))


@query(
    "delimited_lines",
    """SELECT CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ',' || role || ',' ||
 CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS line
 FROM conversations""",
)
def delimited_lines(spark, sf_dir):
    return export.delimited_lines(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query(
    "json_lines",
    """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","gap":null}' AS line
 FROM customer""",
)
def json_lines(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return export.json_lines(customers.select("c_custkey", "c_name", F.lit(None).cast("string").alias("gap")))


# SQL: one checked statement over ``data``, with its whole result.
_WIDE = bounded.QueryLimits(rows=None)

SQL_CTE = """
WITH monthly AS (
  SELECT "l_returnflag" AS flag, "l_linestatus" AS status, count(*) AS n,
         round(sum("l_extendedprice" * (1 - "l_discount")), 2) AS revenue
  FROM data WHERE "l_quantity" > 5 GROUP BY ALL)
SELECT flag, status, n, revenue FROM monthly ORDER BY flag, status"""


@query("sql_cte_rollup", SQL_CTE.replace("data", "lineitem"))
def sql_cte_rollup(spark, sf_dir):
    return bounded.select(table(spark, sf_dir, "lineitem"), SQL_CTE, _WIDE)


SQL_WINDOW = """
SELECT "user_id", "event_type", n, rank() OVER (PARTITION BY "event_type" ORDER BY n DESC) AS place
FROM (SELECT "user_id", "event_type", count(*) AS n FROM data GROUP BY 1, 2) AS t"""


@query("sql_window_rank", SQL_WINDOW.replace("data", "events").replace("rank() OVER", "rank() OVER"))
def sql_window_rank(spark, sf_dir):
    return bounded.select(table(spark, sf_dir, "events"), SQL_WINDOW, _WIDE).select(
        "user_id", "event_type", "n", F.col("place").cast("bigint").alias("place")
    )


SQL_JOIN = """
SELECT a."o_orderstatus" AS status, count(*) AS customers, max(b.last) AS last_order
FROM data a JOIN (SELECT "o_custkey" AS k, max("o_orderkey") AS last FROM data GROUP BY 1) b
  ON a."o_custkey" = b.k AND a."o_orderkey" = b.last
WHERE EXISTS (SELECT 1 FROM data c WHERE c."o_orderkey" = a."o_orderkey")
GROUP BY 1"""


@query("sql_self_join", SQL_JOIN.replace("FROM data", "FROM orders"))
def sql_self_join(spark, sf_dir):
    return bounded.select(table(spark, sf_dir, "orders"), SQL_JOIN, _WIDE)


SQL_SETS = """
SELECT "c_nationkey" AS nation FROM data WHERE "c_acctbal" < 0
INTERSECT SELECT "c_nationkey" FROM data WHERE "c_mktsegment" = 'BUILDING'
EXCEPT SELECT "c_nationkey" FROM data WHERE "c_acctbal" > 9990"""


@query("sql_set_operations", SQL_SETS.replace("data", "customer"))
def sql_set_operations(spark, sf_dir):
    return bounded.select(table(spark, sf_dir, "customer"), SQL_SETS, _WIDE)


SQL_CASE = """
SELECT coalesce("sparse", 'none') AS sparse,
       CASE WHEN "note" LIKE '=%' THEN 'formula' WHEN "note" IS NULL THEN 'gap' ELSE 'text' END AS kind,
       count(*) AS n, sum(CAST("cents" AS BIGINT)) AS cents
FROM data WHERE "due" IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""


@query(
    "sql_case_filter",
    f"{_DIRTY} SELECT sparse, kind, n, CAST(cents AS BIGINT) AS cents FROM ({SQL_CASE.replace('FROM data', 'FROM dirty')})",
)
def sql_case_filter(spark, sf_dir):
    return bounded.select(orders_dirty(spark, sf_dir), SQL_CASE, _WIDE)


SQL_GROUPING = """
SELECT "o_orderstatus" AS status, "o_orderpriority" AS priority, count(*) AS n
FROM data GROUP BY ROLLUP ("o_orderstatus", "o_orderpriority")"""


@query("sql_grouping_sets", SQL_GROUPING.replace("FROM data", "FROM orders"))
def sql_grouping_sets(spark, sf_dir):
    return bounded.select(table(spark, sf_dir, "orders"), SQL_GROUPING, _WIDE)


# Features: customers placed by balance and key.


def features(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        F.col("c_acctbal").alias("x"),
        (key % 180 - 90).cast("double").alias("y"),
    )


_FEATURES = """WITH features AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal AS x,
 CAST(c_custkey % 180 - 90 AS DOUBLE) AS y FROM customer)"""


@query(
    "feature_select",
    f"""{_FEATURES} SELECT c_custkey, x, y FROM features
 WHERE c_mktsegment = 'BUILDING' AND x BETWEEN 0 AND 5000 AND y BETWEEN -45 AND 45""",
)
def feature_select(spark, sf_dir):
    filters = selection.parse_equality(["c_mktsegment=BUILDING"])
    return selection.select_features(
        features(spark, sf_dir),
        properties=["c_custkey", "x", "y"],
        filters=filters,
        box=(0, -45, 5000, 45),
    )


@query(
    "feature_count",
    f"{_FEATURES} SELECT count(*) AS hits FROM features WHERE c_nationkey = 7 AND c_mktsegment = 'MACHINERY'",
)
def feature_count(spark, sf_dir):
    filters = selection.parse_equality(["c_nationkey=7", "c_mktsegment=MACHINERY"])
    return selection.feature_count(features(spark, sf_dir), filters=filters)


@query(
    "feature_page",
    f"""{_FEATURES} SELECT c_custkey, x FROM features WHERE y BETWEEN 0 AND 90 AND x BETWEEN -10000 AND 10000
 ORDER BY c_custkey LIMIT 100 OFFSET 200""",
)
def feature_page(spark, sf_dir):
    """Paging is the operator: 100 features from the 200th on."""
    found = selection.select_features(features(spark, sf_dir), box=(-10000, 0, 10000, 90))
    return selection.page(found, ["c_custkey"], 100, 200).rows.select("c_custkey", "x")


@query("missing_fields", "SELECT DISTINCT o_orderpriority AS name FROM orders")
def missing_fields(spark, sf_dir):
    """Requested property names that the layer lacks: here, values are no columns."""
    from sievetable.operators.inference import layer_schema

    orders = table(spark, sf_dir, "orders")
    requested = orders.select(F.col("o_orderpriority").alias("name")).distinct()
    known = layer_schema(orders).select("name")
    return selection.missing_fields(requested.union(known), layer_schema(orders))


@query(
    "project_unknown",
    "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS phone FROM supplier",
)
def project_unknown(spark, sf_dir):
    return selection.project(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_name", "phone"])


@query(
    "union_columns",
    """SELECT n_nationkey AS key, n_name AS name, n_regionkey, CAST(NULL AS DOUBLE) AS balance FROM nation
 UNION ALL SELECT CAST(s_suppkey AS INTEGER), s_name, NULL, s_acctbal FROM supplier""",
)
def union_columns(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey"
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("key"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
    )
    return selection.union_columns(nations, suppliers)


@query(
    "keep_first",
    """SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value
 FROM events GROUP BY user_id, event_type""",
)
def keep_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return selection.keep_first(events, ["user_id", "event_type"], ["event_id"])


@query(
    "natural_order",
    """SELECT row_number() OVER (ORDER BY CAST(split_part(p_brand, '#', 2) AS INTEGER)) AS place, p_brand
 FROM (SELECT DISTINCT p_brand FROM part)""",
)
def natural_order(spark, sf_dir):
    """Brand#2 sorts before Brand#11."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    key = text.natural_key(F.col("p_brand"))
    return with_row_numbers(brands, [F.array_join(key, "\x00")], row="place", start=1).select("place", "p_brand")


# Workbench.


@query(
    "wb_completeness",
    f"""{_DIRTY}, long AS (
 SELECT o_orderstatus, count(*) AS rows, count(sparse) AS sparse, count(note) AS note, count(due) AS due
 FROM dirty GROUP BY 1)
SELECT o_orderstatus, rows, 'sparse' AS field, sparse AS filled, round(sparse / rows, 6) AS share FROM long
UNION ALL SELECT o_orderstatus, rows, 'note', note, round(note / rows, 6) FROM long
UNION ALL SELECT o_orderstatus, rows, 'due', due, round(due / rows, 6) FROM long""",
)
def wb_completeness(spark, sf_dir):
    return workbench.completeness(
        orders_dirty(spark, sf_dir), ["sparse", "note", "due"], by=["o_orderstatus"]
    )


@query(
    "wb_latest",
    """SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
 arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""",
)
def wb_latest(spark, sf_dir):
    return workbench.latest(
        table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value"]
    )


@query(
    "wb_top_categories",
    "SELECT user_id, count(*) AS amount FROM events GROUP BY 1 ORDER BY amount DESC, user_id LIMIT 10",
)
def wb_top_categories(spark, sf_dir):
    """The top-k report."""
    return workbench.top_categories(table(spark, sf_dir, "events"), "user_id", 10)


@query(
    "wb_period_change",
    """WITH t AS (SELECT o_orderpriority, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS period,
 count(*) AS amount FROM orders GROUP BY ALL)
SELECT *, lag(amount) OVER w AS previous, amount - lag(amount) OVER w AS change
FROM t WINDOW w AS (PARTITION BY o_orderpriority ORDER BY period)""",
)
def wb_period_change(spark, sf_dir):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("bigint")
    return workbench.period_change(
        table(spark, sf_dir, "orders"), month, F.count(F.lit(1)), by=["o_orderpriority"]
    )


@query(
    "wb_missing_periods",
    """WITH seen AS (SELECT DISTINCT c_nationkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS ordinal
 FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT c_nationkey, min(ordinal) AS lo, max(ordinal) AS hi FROM seen GROUP BY 1),
e AS (SELECT c_nationkey, unnest(range(lo, hi + 1)) AS ordinal FROM b)
SELECT * FROM e ANTI JOIN seen USING (c_nationkey, ordinal)""",
)
def wb_missing_periods(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    day = F.unix_date(F.to_date("o_orderdate"))
    return workbench.missing_periods(joined, day, by=["c_nationkey"])


_SPARSE = """SELECT o_orderpriority, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)
 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 10000000 END AS ordinal FROM orders"""


@query(
    "wb_missing_periods_sparse",
    f"""WITH seen AS (SELECT DISTINCT * FROM ({_SPARSE})),
b AS (SELECT o_orderpriority, min(ordinal)::HUGEINT AS lo, max(ordinal)::HUGEINT AS hi, count(*) AS n, sum(ordinal) AS s FROM seen GROUP BY 1)
SELECT o_orderpriority, (hi - lo + 1 - n)::BIGINT AS missing, ((lo + hi) * (hi - lo + 1) // 2 - s)::BIGINT AS total FROM b""",
)
def wb_missing_periods_sparse(spark, sf_dir):
    """Days of orders, half of them ten million days later: the gap is expanded in pieces."""
    orders = table(spark, sf_dir, "orders")
    day = F.unix_date(F.to_date("o_orderdate")) + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(10_000_000)
    absent = workbench.missing_periods(orders, day, by=["o_orderpriority"])
    return absent.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("missing"), F.sum("ordinal").alias("total"))


@query(
    "wb_period_change_all",
    """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS period, count(*) AS amount FROM orders GROUP BY ALL)
SELECT *, lag(amount) OVER w AS previous, amount - lag(amount) OVER w AS change FROM t WINDOW w AS (ORDER BY period)""",
)
def wb_period_change_all(spark, sf_dir):
    """Change from day to day over all orders, in ranges of days."""
    orders = table(spark, sf_dir, "orders")
    return workbench.period_change(orders, F.to_date("o_orderdate"), F.count(F.lit(1)))


@query(
    "wb_histogram",
    """SELECT CAST(greatest(0, least(20, floor((l_extendedprice - 20000) / 5000) + 1)) AS INTEGER) AS bin, count(*) AS rows
 FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1""",
)
def wb_histogram(spark, sf_dir):
    """Values below the range go to bin 0."""
    return workbench.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20_000, 5000, 20)


@query(
    "wb_heatmap",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F",
 count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
 FROM orders GROUP BY 1""",
)
def wb_heatmap(spark, sf_dir):
    return workbench.heat_map(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]
    )


@query(
    "wb_quantiles",
    """SELECT 0.0::DOUBLE AS share, quantile_disc(l_extendedprice, 0.0) AS quantile FROM lineitem
UNION ALL SELECT 0.25, quantile_disc(l_extendedprice, 0.25) FROM lineitem
UNION ALL SELECT 0.5, quantile_disc(l_extendedprice, 0.5) FROM lineitem
UNION ALL SELECT 0.75, quantile_disc(l_extendedprice, 0.75) FROM lineitem
UNION ALL SELECT 1.0, quantile_disc(l_extendedprice, 1.0) FROM lineitem""",
)
def wb_quantiles(spark, sf_dir):
    return workbench.quantile_table(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.0, 0.25, 0.5, 0.75, 1.0]
    )


@query(
    "wb_ranked",
    """SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS rank
 FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""",
)
def wb_ranked(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return workbench.ranked(counted, "user_id", "n")


@query(
    "wb_paired_values",
    f"{_DIRTY} SELECT mixed AS x, sparse AS y FROM dirty WHERE mixed IS NOT NULL AND sparse IS NOT NULL",
)
def wb_paired_values(spark, sf_dir):
    return workbench.paired_values(orders_dirty(spark, sf_dir), "mixed", "sparse").toDF("x", "y")


# Presentation.


@query(
    "present_reduction",
    """SELECT 'filter' AS method, (SELECT count(*) FROM customer) AS original_rows, count(*) AS presented_rows,
 '' AS grouping_fields, 'outside the map' AS exclusions
 FROM customer WHERE c_acctbal BETWEEN -180 AND 180 AND c_custkey % 180 - 90 BETWEEN -90 AND 90""",
)
def present_reduction(spark, sf_dir):
    points = features(spark, sf_dir)
    kept, _ = presentation.spatial_split(points, "y", "x")
    record = presentation.reduction(points, kept, "filter", exclusions=["outside the map"])
    return record.select(
        "method",
        "original_rows",
        "presented_rows",
        F.array_join("grouping_fields", ",").alias("grouping_fields"),
        F.array_join("exclusions", ",").alias("exclusions"),
    )


@query(
    "present_spatial_check",
    """SELECT count(*) FILTER (ok) AS valid_records, count(*) FILTER (NOT ok) AS excluded_records
 FROM (SELECT c_acctbal BETWEEN -180 AND 180 AND c_custkey % 180 - 90 BETWEEN -90 AND 90 AS ok FROM customer)""",
)
def present_spatial_check(spark, sf_dir):
    return presentation.spatial_check(features(spark, sf_dir), latitude="y", longitude="x")


@query(
    "present_geometry",
    """WITH k AS (SELECT c_custkey, c_custkey % 9 AS shape, c_acctbal BETWEEN -180 AND 180 AS inside,
   abs(c_acctbal) <= 180 AND abs(c_acctbal + 1) <= 180 AS pair FROM customer)
SELECT c_custkey, CASE shape WHEN 0 THEN inside WHEN 1 THEN pair WHEN 2 THEN pair WHEN 3 THEN false
 WHEN 4 THEN pair WHEN 5 THEN inside WHEN 6 THEN false WHEN 7 THEN false ELSE pair END AS valid FROM k""",
)
def present_geometry(spark, sf_dir):
    """GeoJSON written from every customer: points, lines, rings, collections, broken ones."""
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    x1 = (F.col("x") + 1).cast("string")
    a = F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    b = F.concat(F.lit("["), x1, F.lit(","), y, F.lit("]"))

    def shape(kind, *parts):
        return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), *parts, F.lit("}"))

    def s(t):
        return F.lit(t)

    point = shape("Point", a)
    cases = [
        point,
        shape("LineString", s("["), a, s(","), b, s("]")),
        shape("Polygon", s("[["), a, s(","), b, s(","), b, s(","), a, s("]]")),
        shape("Polygon", s("[["), a, s(","), b, s(","), b, s(","), b, s("]]")),
        shape("MultiPoint", s("["), a, s(","), b, s("]")),
        F.concat(s('{"type":"GeometryCollection","geometries":['), point, s("]}")),
        F.concat(s('{"type":"Point","coordinates":'), a, s(',"extra":1}')),
        shape("Point", s('["'), x, s('",0]')),
        shape("MultiPolygon", s("[[["), a, s(","), b, s(","), b, s(","), a, s("]]]")),
    ]
    points = features(spark, sf_dir).withColumn("c_acctbal", F.col("x"))
    geometry = F.lit(None).cast("string")
    for i, case in enumerate(cases):
        geometry = F.when(F.col("c_custkey") % 9 == i, case).otherwise(geometry)
    valid = geo.valid_geometry(geometry, "EPSG:4326")
    return points.select("c_custkey", valid.alias("valid"))


@query(
    "present_geometry_nested",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN false ELSE c_acctbal BETWEEN -180 AND 180 END AS valid FROM customer""",
)
def present_geometry_nested(spark, sf_dir):
    """Points inside collections that nest one, four and nine deep; a fourth have a broken member."""
    x, y, kind = F.col("x").cast("string"), F.col("y").cast("string"), F.col("c_custkey") % 4
    point = F.concat(F.lit('{"type":"Point","coordinates":['), x, F.lit(","), y, F.lit("]}"))
    member = F.when(kind == 3, F.lit('{"type":"Point","coordinates":["1",2]}')).otherwise(point)
    depth = F.when(kind == 0, 1).when(kind == 1, 4).otherwise(9)
    start = F.repeat(F.lit('{"type":"GeometryCollection","geometries":['), depth)
    nested = F.concat(start, member, F.repeat(F.lit("]}"), depth))
    return features(spark, sf_dir).select(
        "c_custkey", geo.valid_geometry(nested, "EPSG:4326").alias("valid")
    )


@query(
    "present_filter",
    """SELECT count(*) FILTER (lower(p_name) LIKE '%red%' AND lower(p_type) LIKE '%eco%') AS matching,
 count(*) AS total FROM part""",
)
def present_filter(spark, sf_dir):
    filters = {"p_name": "RED", "p_type": "eco", "p_brand": ""}
    return selection.filtered_share(table(spark, sf_dir, "part"), filters)


@query(
    "present_filter_rows",
    "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%' AND CAST(p_size AS VARCHAR) LIKE '%1%'",
)
def present_filter_rows(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    test = selection.contains_text({"p_name": "Widget", "p_size": "1"})
    return parts.filter(test).select("p_partkey", "p_name")


@query(
    "present_size",
    """SELECT count(*) AS rows, CAST(sum(strlen('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}')) AS BIGINT)
 AS json_bytes, count(*) <= 10000 AS rows_ok, true AS bytes_ok FROM supplier""",
)
def present_size(spark, sf_dir):
    return presentation.size_check(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


def _reductions(spark, sf_dir):
    """A chain per order: each line is a step; some steps are broken on purpose.

    Steps are made, sorted and summed up where the lines of their order are, so the tasks
    are as many as the lines need, whatever the number of shuffle partitions.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    tasks = max(1, -(-lines.count() // LINES_PER_TASK))
    sizes = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    steps = sizes.select(
        F.col("l_orderkey").alias("presentation"),
        "lines",
        F.explode(F.sequence(F.lit(0), (F.col("lines") - 1).cast("int"))).alias("step"),
    )
    start = F.col("lines") * 10 + 10
    broken = (F.col("presentation") % 7 == 0) & (F.col("step") == 1)
    flat = (F.col("presentation") % 11 == 0) & (F.col("step") == 0)
    reductions = steps.select(
        "presentation",
        "step",
        F.lit("filter").alias("method"),
        (start - F.col("step") * 10 + F.when(broken, 1).otherwise(0)).alias("original_rows"),
        (start - F.col("step") * 10 - F.when(flat, 0).otherwise(10)).alias("presented_rows"),
    )
    totals = sizes.select(
        F.col("l_orderkey").alias("presentation"),
        (start + F.when(F.col("l_orderkey") % 13 == 0, 5).otherwise(0)).alias("original_rows"),
        F.lit(10).cast("bigint").alias("presented_rows"),
    )
    return reductions, totals


@query(
    "present_chain",
    """WITH sizes AS (SELECT l_orderkey AS presentation, count(*) AS lines FROM lineitem GROUP BY 1),
r AS (SELECT presentation, lines, unnest(range(lines)) AS step FROM sizes),
steps AS (SELECT presentation, step, lines,
  lines * 10 + 10 - step * 10 + CASE WHEN presentation % 7 = 0 AND step = 1 THEN 1 ELSE 0 END AS o,
  lines * 10 + 10 - step * 10 - CASE WHEN presentation % 11 = 0 AND step = 0 THEN 0 ELSE 10 END AS p FROM r),
linked AS (SELECT *, lag(p) OVER (PARTITION BY presentation ORDER BY step) AS pp FROM steps),
ends AS (SELECT presentation, arg_min(o, step) AS fo, arg_max(p, step) AS lp, any_value(lines) AS lines FROM steps GROUP BY 1)
SELECT presentation, step, 'CHAIN_BROKEN' AS problem FROM linked WHERE pp <> o
UNION ALL SELECT presentation, step, 'NOT_A_REDUCTION' FROM steps WHERE o <= p
UNION ALL SELECT presentation, NULL, 'TOTALS_DISAGREE' FROM ends
WHERE fo <> lines * 10 + 10 + CASE WHEN presentation % 13 = 0 THEN 5 ELSE 0 END OR lp <> 10""",
)
def present_chain(spark, sf_dir):
    return presentation.chain_problems(*_reductions(spark, sf_dir))


@query(
    "present_views",
    """WITH v AS (SELECT c_nationkey AS presentation, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
t AS (SELECT c_nationkey AS presentation, count(*) AS n FROM customer GROUP BY 1)
SELECT t.presentation, count(v.n) AS views, 'VIEW_METADATA_INVALID' AS problem
FROM t LEFT JOIN v USING (presentation) GROUP BY t.presentation
HAVING count(v.n) NOT BETWEEN 2 AND 4 OR max(v.n) > any_value(t.n)""",
)
def present_views(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    views = customers.groupBy(F.col("c_nationkey").alias("presentation"), "c_mktsegment").agg(
        F.count(F.lit(1)).alias("record_count")
    )
    views = views.withColumn("id", F.col("c_mktsegment"))
    for name in ("question", "population", "unit", "takeaway"):
        views = views.withColumn(name, F.lit(name))
    totals = customers.groupBy(F.col("c_nationkey").alias("presentation")).agg(
        F.count(F.lit(1)).alias("original_rows"), F.count(F.lit(1)).alias("presented_rows")
    )
    return presentation.view_problems(views, totals, "interactive")


# Scalar expressions.


@query(
    "text_escape",
    """SELECT doc_id, replace(replace(replace(text, chr(10), '\\u000a'), chr(9), '\\u0009'), chr(13), '\\u000d') AS safe
 FROM documents""",
)
def text_escape(spark, sf_dir):
    """Line breaks and tabs are the only hidden characters in the documents."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.escape_text(F.col("text")).alias("safe"))


@query(
    "text_fold_lines",
    r"""SELECT doc_id, regexp_replace(text, '[ \t]*(\r\n|\r|\n)[ \t]*', ' ', 'g') AS folded FROM documents""",
)
def text_fold_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.fold_line_wraps(F.col("text")).alias("folded")
    )


@query(
    "canonical_timestamps",
    """WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  CASE event_id % 4 WHEN 0 THEN '.' || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z'
       WHEN 1 THEN 'Z' WHEN 2 THEN '.000+00:00' ELSE '.9Z' END AS t FROM events)
SELECT event_id, event_id % 4 = 0 AS canonical FROM t""",
)
def canonical_timestamps(spark, sf_dir):
    kind = F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ending = (
        F.when(kind == 0, F.concat(F.lit("."), F.date_format("ts", "SSS"), F.lit("Z")))
        .when(kind == 1, "Z")
        .when(kind == 2, ".000+00:00")
        .otherwise(".9Z")
    )
    events = table(spark, sf_dir, "events").select("event_id", F.concat(stamp, ending).alias("t"))
    return events.select("event_id", cells.is_canonical_timestamp(F.col("t")).alias("canonical"))


@query(
    "typed_literals",
    f"""{_DIRTY} SELECT kind, count(*) AS cells FROM (
 SELECT CASE WHEN regexp_full_match(lower(v), 'true|false') THEN 'boolean'
  WHEN regexp_full_match(v, '[+-]?([0-9]+|[0-9]*\\.[0-9]+)') THEN 'number' ELSE 'string' END AS kind
 FROM (SELECT note AS v FROM dirty UNION ALL SELECT mixed FROM dirty UNION ALL SELECT due FROM dirty)) GROUP BY 1""",
)
def typed_literals(spark, sf_dir):
    values = orders_dirty(spark, sf_dir).select(F.explode(F.array("note", "mixed", "due")).alias("v"))
    kind = cells.typed_literal_kind(F.col("v"))
    return values.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("cells"))
