"""Cube and period queries over dense cubes made from ``orders``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievetable.functions.periods import any_period_ordinal, iso_weeks_in_year, period_ordinal
from sievetable.operators import cube
from sievetable.operators.ordering import with_row_numbers
from sievetable.plans.staged import kept
from sievetable.sources import cube_files
from workload.registry import query
from workload.views import table

CHUNK = 256


def _cells(spark, sf_dir):
    """One row per observed (segment, status, priority, month): orders and cents."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    month = F.date_format("o_orderdate", "yyyy'M'MM")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy(
        F.col("c_mktsegment").alias("cube"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        month.alias("month"),
    ).agg(F.count(F.lit(1)).alias("n"))


def orders_cube(spark, sf_dir):
    """(dimensions, chunks): a cube per market segment, in the decoder's form.

    Every cube has the same labels per dimension; a cell without orders holds
    a quoted symbol. What is used several times is written once: the counted
    cells, the labels, and the result.
    """
    cells = kept(_cells(spark, sf_dir), "cube-cells")
    axes = F.array(
        *[
            F.struct(F.lit(i).alias("dimension"), F.lit(n).alias("name"), F.col(n).alias("label"))
            for i, n in enumerate(("status", "priority", "month"), start=1)
        ]
    )
    labels = cells.select(F.inline(axes)).distinct()
    place = F.row_number().over(Window.partitionBy("dimension").orderBy("label")) - 1
    code = F.when(
        F.col("dimension") < 3, F.lpad((F.col("position") + 1).cast("string"), 3, "0")
    )
    values = kept(labels.withColumn("position", place).withColumn("code", code), "cube-labels")
    sizes = {r.dimension: r.size for r in values.groupBy("dimension").agg(F.count(F.lit(1)).alias("size")).collect()}
    s1, s2, s3 = (sizes.get(i, 0) for i in (1, 2, 3))

    def positions(dimension: int, name: str):
        at = values.filter(F.col("dimension") == dimension)
        return at.select(F.col("label").alias(name), F.col("position").alias(f"p{dimension}"))

    placed = cells
    for dimension, name in enumerate(("status", "priority", "month"), start=1):
        placed = placed.join(positions(dimension, name), name)
    index = (F.col("p1") * s2 + F.col("p2")) * s3 + F.col("p3")
    indexed = placed.select("cube", index.cast("bigint").alias("index"), "n")
    filled = indexed.groupBy("cube", F.floor(F.col("index") / CHUNK).alias("chunk")).agg(
        F.map_from_entries(F.collect_list(F.struct("index", "n"))).alias("known")
    )
    cubes = cells.select("cube").distinct()
    total = s1 * s2 * s3
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, total - 1) // CHUNK).cast("bigint"))
    grid = cubes.select("cube", F.explode(places).alias("chunk"))
    joined = grid.join(filled, ["cube", "chunk"], "left").select(
        "cube", (F.col("chunk") * CHUNK).alias("base"), F.lit(total).cast("bigint").alias("total"), "known"
    )
    token = F.transform(
        F.sequence("base", F.least(F.col("base") + CHUNK, F.col("total")) - 1),
        lambda i: F.coalesce(F.col("known")[i].cast("string"), F.lit('"."')),
    )
    chunks = joined.select("cube", "base", token.alias("cells"))
    # Every cube has every label: this is the size of the result, not a search.
    shared = cubes.crossJoin(values).select("cube", "dimension", "name", "position", "label", "code")
    return kept(shared, "cube-dimensions"), kept(chunks, "cube-chunks")


_CUBE_SQL = """
WITH observed AS (
  SELECT c_mktsegment AS cube, o_orderstatus AS status, o_orderpriority AS priority,
         strftime(o_orderdate, '%YM%m') AS month, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS p1 FROM (SELECT DISTINCT status FROM observed)),
p AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS p2 FROM (SELECT DISTINCT priority FROM observed)),
m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS p3 FROM (SELECT DISTINCT month FROM observed)),
grid AS (
  SELECT cube, status, priority, month, p1, p2,
         ((p1 * (SELECT count(*) FROM p)) + p2) * (SELECT count(*) FROM m) + p3 AS index
  FROM (SELECT DISTINCT cube FROM observed), s, p, m),
long AS (
  SELECT cube, index, status, lpad(CAST(p1 + 1 AS VARCHAR), 3, '0') AS status__code,
         priority, lpad(CAST(p2 + 1 AS VARCHAR), 3, '0') AS priority__code, month,
         CAST(n AS DOUBLE) AS value, CASE WHEN n IS NULL THEN '.' END AS value__symbol
  FROM grid LEFT JOIN observed USING (cube, status, priority, month))
"""


@query("cube_long", _CUBE_SQL + "SELECT * FROM long")
def cube_long(spark, sf_dir):
    dimensions, chunks = orders_cube(spark, sf_dir)
    bindings = cube.column_bindings([("status", True), ("priority", True), ("month", False)])
    cells = cube.decode(chunks, dimensions)
    return cube.to_columns(cells, bindings, keep=["cube"])


@query(
    "cube_wide_dimension",
    """WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS p2 FROM customer),
s AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS p1 FROM (SELECT DISTINCT o_orderstatus AS status FROM orders)),
n AS (SELECT o_orderstatus AS status, o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY ALL)
SELECT p1 * (SELECT count(*) FROM c) + p2 AS index, status, c_name AS customer,
 CAST(c.c_custkey AS VARCHAR) AS customer__code, CAST(n AS DOUBLE) AS value
FROM s CROSS JOIN c LEFT JOIN n USING (status, c_custkey)""",
)
def cube_wide_dimension(spark, sf_dir):
    """Orders by status and customer: every customer is a label, and labels come in pages."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    placed = kept(with_row_numbers(customers, ["c_custkey"], row="position", start=0), "cube-wide")
    width = placed.count()
    statuses = orders.select(F.col("o_orderstatus").alias("label")).distinct()
    place = F.row_number().over(Window.orderBy("label")) - 1
    statuses = kept(statuses.withColumn("position", place.cast("bigint")), "cube-status")
    one = F.lit("orders").alias("cube")
    dimensions = statuses.select(
        one, F.lit(1).alias("dimension"), F.lit("status").alias("name"), "position", "label", F.lit(None).cast("string").alias("code")
    ).unionByName(
        placed.select(
            one,
            F.lit(2).alias("dimension"),
            F.lit("customer").alias("name"),
            "position",
            F.col("c_name").alias("label"),
            F.col("c_custkey").cast("string").alias("code"),
        )
    )
    counted = orders.groupBy("o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    first = statuses.select(F.col("label").alias("o_orderstatus"), F.col("position").alias("p1"))
    second = placed.select(F.col("c_custkey").alias("o_custkey"), F.col("position").alias("p2"))
    index = (F.col("p1") * width + F.col("p2")).alias("index")
    known = counted.join(first, "o_orderstatus").join(second, "o_custkey").select(index, "n")
    filled = known.groupBy(F.floor(F.col("index") / CHUNK).alias("chunk")).agg(
        F.map_from_entries(F.collect_list(F.struct("index", "n"))).alias("known")
    )
    total = statuses.count() * width
    grid = spark.range((total + CHUNK - 1) // CHUNK).withColumnRenamed("id", "chunk")
    base = F.col("chunk") * CHUNK
    token = F.transform(
        F.sequence(base, F.least(base + CHUNK, F.lit(total)) - 1),
        lambda i: F.coalesce(F.col("known")[i].cast("string"), F.lit('"."')),
    )
    chunks = grid.join(filled, "chunk", "left").select(one, base.alias("base"), token.alias("cells"))
    cells = cube.decode(kept(chunks, "cube-wide-chunks"), dimensions, labels_in_row=0)
    return cube.to_columns(cells, cube.column_bindings([("status", False), ("customer", True)])).drop("value__symbol")


@query(
    "cube_symbols",
    _CUBE_SQL
    + """SELECT cube, '.' AS symbol, count(*) AS occurrences,
 'The source DATA contains the PC-Axis symbol ".", emitted as null.' AS message
 FROM long WHERE value IS NULL GROUP BY cube""",
)
def cube_symbols(spark, sf_dir):
    dimensions, chunks = orders_cube(spark, sf_dir)
    issues = cube.symbol_issues(cube.decode(chunks, dimensions))
    return issues.select("cube", F.col("context")["symbol"].alias("symbol"), "occurrences", "message")


@query(
    "cube_cell_count",
    _CUBE_SQL
    + "SELECT cube, count(*) AS expected, count(*) AS actual, true AS complete FROM long GROUP BY cube",
)
def cube_cell_count(spark, sf_dir):
    dimensions, chunks = orders_cube(spark, sf_dir)
    return cube.cell_counts(chunks, dimensions)


@query("cube_prefix", _CUBE_SQL + "SELECT cube, index, status, month, value FROM long WHERE index < 300")
def cube_prefix(spark, sf_dir):
    """Preview of each cube: the row cap is the operator."""
    dimensions, chunks = orders_cube(spark, sf_dir)
    cells = cube.decode(cube.prefix(chunks, 300), dimensions)
    labels = F.col("labels")
    return cells.select(
        "cube", "index", labels[0].alias("status"), labels[2].alias("month"), "value"
    )


@query(
    "period_ordinals",
    """
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(year(d) AS BIGINT) AS a,
       CAST(year(d) * 2 + (CASE WHEN month(d) > 6 THEN 1 ELSE 0 END) AS BIGINT) AS h,
       CAST(year(d) * 4 + quarter(d) - 1 AS BIGINT) AS q,
       CAST(year(d) * 12 + month(d) - 1 AS BIGINT) AS m,
       CAST(floor((date_diff('day', DATE '1970-01-01', d) - (isodow(d) - 1)) / 7.0) AS BIGINT) AS w,
       CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) AS d,
       CASE WHEN strftime(make_date(year(d), 12, 28), '%V') = '53' THEN 53 ELSE 52 END AS weeks,
       CAST(NULL AS BIGINT) AS bad
FROM d""",
)
def period_ordinals(spark, sf_dir):
    """Ordinals of the order date written as a period of each scale."""
    day = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders")
    half = F.when(F.month(day) > 6, "2").otherwise("1")
    iso_year = F.extract(F.lit("yearofweek"), day).cast("string")
    texts = {
        "a": (F.date_format(day, "yyyy"), "A"),
        "h": (F.concat(F.date_format(day, "yyyy"), F.lit("H"), half), "H"),
        "q": (F.concat(F.date_format(day, "yyyy"), F.lit("Q"), F.quarter(day).cast("string")), "Q"),
        "m": (F.date_format(day, "yyyy'M'MM"), "M"),
        "w": (F.concat(iso_year, F.lit("W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")), "W"),
        "d": (F.date_format(day, "yyyyMMdd"), "D"),
    }
    ordinals = [period_ordinal(text, scale).alias(name) for name, (text, scale) in texts.items()]
    bad = any_period_ordinal(F.concat(F.date_format(day, "yyyy"), F.lit("M13")), F.lit("M1"))
    weeks = iso_weeks_in_year(F.year(day))
    return orders.select("o_orderkey", *ordinals, weeks.alias("weeks"), bad.alias("bad"))


@query(
    "cube_cell_tokens",
    """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE
    WHEN l_linenumber % 7 = 0 THEN '"-"' WHEN l_linenumber % 7 = 1 THEN '".."'
    WHEN l_linenumber % 7 = 2 THEN '"' || CAST(l_partkey AS VARCHAR) || '"'
    WHEN l_linenumber % 7 = 3 THEN '-' WHEN l_linenumber % 7 = 4 THEN '1e400'
    WHEN l_linenumber % 7 = 5 THEN '-' || CAST(l_partkey AS VARCHAR) || '.5'
    ELSE CAST(l_suppkey AS VARCHAR) END AS token, l_partkey, l_suppkey FROM lineitem)
SELECT token, count(*) AS cells,
       CASE WHEN l_linenumber % 7 = 5 THEN -l_partkey - 0.5::DOUBLE
            WHEN l_linenumber % 7 = 6 THEN CAST(l_suppkey AS DOUBLE) END AS value,
       CASE WHEN l_linenumber % 7 = 0 THEN '-' WHEN l_linenumber % 7 = 1 THEN '..' END AS symbol
FROM t GROUP BY ALL""",
)
def cube_cell_tokens(spark, sf_dir):
    """The cell grammar over tokens written from every line item."""
    line = F.col("l_linenumber") % 7
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    token = (
        F.when(line == 0, '"-"')
        .when(line == 1, '".."')
        .when(line == 2, F.concat(F.lit('"'), part, F.lit('"')))
        .when(line == 3, "-")
        .when(line == 4, "1e400")
        .when(line == 5, F.concat(F.lit("-"), part, F.lit(".5")))
        .otherwise(supplier)
    )
    tokens = table(spark, sf_dir, "lineitem").select(token.alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cells"))
    return counted.select(
        "token",
        "cells",
        cube.cell_value(F.col("token")).alias("value"),
        cube.cell_symbol(F.col("token")).alias("symbol"),
    )


def cube_documents(spark, sf_dir):
    """A PC-Axis file per nation: customers by segment and balance sign.

    The text is put together by Spark; a segment without customers gets a symbol.
    """
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    counted = customers.groupBy("c_nationkey").agg(
        *[
            F.count(F.when((F.col("c_mktsegment") == s) & test, True)).alias(f"{s}_{i}")
            for s in SEGMENTS
            for i, test in enumerate((F.col("c_acctbal") < 0, F.col("c_acctbal") >= 0))
        ]
    )
    joined = nations.join(counted, nations.n_nationkey == counted.c_nationkey)

    def cell(name):
        return F.when(F.col(name) > 0, F.col(name).cast("string")).otherwise(F.lit('".."'))

    cells = F.concat_ws(" ", *[cell(f"{s}_{i}") for s in SEGMENTS for i in (0, 1)])
    listed = ",\n".join(f'"{s}"' for s in SEGMENTS)
    codes = ",".join(f'"{i:02d}"' for i in range(1, len(SEGMENTS) + 1))
    text = F.concat(
        F.lit('CHARSET="ANSI";\nCODEPAGE="utf-8";\nMATRIX="'),
        F.col("n_name"),
        F.lit('";\nTITLE="Customers of "\n"'),
        F.col("n_name"),
        F.lit('";\nDECIMALS=0;\nUNITS="customers; ""all""";\n'),
        F.lit('STUB="Segment";\nHEADING="Balance";\n'),
        F.lit(f'VALUES("Segment")={listed};\nCODES("Segment")={codes};\n'),
        F.lit('VALUES("Balance")="below","above";\nDATASYMBOL2="not counted";\n'),
        F.lit('NOTE("Segment")="Made from the customer table.";\nDATA=\n'),
        cells,
        F.lit(";\n"),
    )
    return joined.select(F.col("n_name").alias("cube"), F.encode(text, "UTF-8").alias("content"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "cube_files_long",
    """
WITH seg AS (SELECT unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS segment,
                    unnest([1,2,3,4,5]) AS place),
sign AS (SELECT unnest(['below','above']) AS balance),
nat AS (SELECT DISTINCT n_nationkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey),
counted AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'below' ELSE 'above' END AS balance,
                   count(*) AS n FROM customer GROUP BY ALL)
SELECT n_name AS cube, segment, '0' || place AS segment_code, sign.balance AS balance,
       CAST(n AS DOUBLE) AS value, CASE WHEN n IS NULL THEN '..' END AS value__symbol
FROM nat CROSS JOIN seg CROSS JOIN sign
LEFT JOIN counted ON c_nationkey = n_nationkey AND c_mktsegment = segment AND counted.balance = sign.balance""",
)
def cube_files_long(spark, sf_dir):
    files = cube_documents(spark, sf_dir)
    dimensions = cube_files.dimensions(cube_files.statements(files))
    cells = cube.decode(cube_files.cell_chunks(files).drop("error"), dimensions)
    labels, codes = F.col("labels"), F.col("codes")
    return cells.select(
        "cube",
        labels[0].alias("segment"),
        codes[0].alias("segment_code"),
        labels[1].alias("balance"),
        "value",
        "value__symbol",
    )


@query(
    "cube_files_metadata",
    """
SELECT DISTINCT n_name AS cube, n_name AS matrix, 'Customers of ' || n_name AS title,
       'customers; "all"' AS unit, '0' AS decimals, 'utf-8' AS codepage, '..' AS symbol,
       'not counted' AS symbol_name, 'Made from the customer table.' AS note
FROM nation JOIN customer ON c_nationkey = n_nationkey""",
)
def cube_files_metadata(spark, sf_dir):
    rows = cube_files.statements(cube_documents(spark, sf_dir))
    names = cube_files.symbol_names(rows).withColumnRenamed("name", "symbol_name")
    noted = cube_files.notes(rows).select("cube", F.col("value").alias("note"))
    scalars = cube_files.scalars(rows)
    return scalars.join(names, "cube").join(noted, "cube").select(
        "cube", "matrix", "title", "unit", "decimals", "codepage", "symbol", "symbol_name", "note"
    )


@query(
    "cube_files_problems",
    """
SELECT DISTINCT n_name AS cube, 'INVALID_PCAXIS_DATA' AS code, 'CODES' AS detail
FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 1
UNION ALL
SELECT DISTINCT n_name, 'PCAXIS_KEYS_UNSUPPORTED', NULL
FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 2""",
)
def cube_files_problems(spark, sf_dir):
    """Every file, two thirds of them damaged in a known way."""
    kind = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("cube"), (F.col("n_nationkey") % 3).alias("kind")
    )
    text = F.decode("content", "UTF-8")
    short = F.regexp_replace(text, ',"05";', ";")
    keyed = F.regexp_replace(text, "DATA=", 'KEYS("Segment")="VALUES";\nDATA=')
    damaged = F.when(F.col("kind") == 1, short).when(F.col("kind") == 2, keyed).otherwise(text)
    files = cube_documents(spark, sf_dir).join(kind, "cube")
    files = files.select("cube", F.encode(damaged, "UTF-8").alias("content"))
    return cube_files.metadata_problems(cube_files.statements(files))
