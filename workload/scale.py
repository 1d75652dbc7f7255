"""Operators forced into the plans they have on very large tables, by low thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievetable.operators.catalogue import parent_datasets
from sievetable.operators.ordering import expand_counts, with_row_numbers
from sievetable.operators.skew import salted_join
from workload.registry import query
from workload.views import table


@query(
    "ranked_many_ranges",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 1 AS row FROM orders",
)
def ranked_many_ranges(spark, sf_dir):
    """Row numbers over 64 ranges."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    numbered = with_row_numbers(orders, ["o_totalprice", "o_orderkey"], ranges=64)
    return numbered.select("o_orderkey", "row")


@query(
    "hot_key_join",
    """WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, n FROM lineitem JOIN n USING (l_returnflag, l_linestatus)""",
)
def hot_key_join(spark, sf_dir):
    """A few keys that hold all rows, spread from 50 rows on."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    keys = ["l_returnflag", "l_linestatus"]
    sizes = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(lines, sizes, keys, "n", hot_weight=50, spread_by=["l_orderkey", "l_linenumber"])
    return joined.select("l_orderkey", "l_linenumber", "n")


@query(
    "hot_parent_datasets",
    """SELECT 'u' || c_nationkey % 2 AS url, 'i' AS id, 'd' || min(c_nationkey % 2) AS dataset_id, count(*) AS n
 FROM customer GROUP BY 1""",
)
def hot_parent_datasets(spark, sf_dir):
    """Resources without a dataset that all share two URLs and one id."""
    url = F.concat(F.lit("u"), (F.col("c_nationkey") % 2).cast("string"))
    orphans = table(spark, sf_dir, "customer").select(url.alias("url"), F.lit("i").alias("id"))
    parent = F.concat(F.lit("d"), (F.col("c_nationkey") % 2).cast("string"))
    known = table(spark, sf_dir, "customer").select(url.alias("url"), F.lit("i").alias("id"), parent.alias("dataset_id"))
    joined = parent_datasets(orphans, known, hot_weight=50)
    return joined.groupBy("url", "id", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "expand_hot_counts",
    """SELECT o_orderstatus, c AS copy FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) t, unnest(range(0, n)) u(c)""",
)
def expand_hot_counts(spark, sf_dir):
    """Groups of thousands of rows, expanded in pieces of ten."""
    groups = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return expand_counts(groups, "n", chunk=10).select("o_orderstatus", "copy")
