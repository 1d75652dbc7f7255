"""The statement policy and the limits of bounded SQL."""

from __future__ import annotations

import pytest

from sievetable.errors import DataError
from sievetable.plans import bounded, guard, staged

ACCEPTED = [
    "SELECT 1",
    "WITH row AS (SELECT 1 AS value) SELECT * FROM row",
    "VALUES (1), (2)",
    "-- comment;\nSELECT ';' AS value /* ; */",
    "\u2003SELECT 1",
    "SELECT count(*) FROM range(10) CROSS JOIN range(5)",
    "SELECT * FROM data WHERE id IN (SELECT max(id) FROM data)",
    "SELECT id, row_number() OVER (PARTITION BY id ORDER BY id) FROM data",
    "SELECT * FROM data LATERAL VIEW explode(array(1, 2)) t AS x",
    'SELECT "id" FROM data GROUP BY ALL',
    "SELECT id FROM data UNION SELECT 2 ORDER BY 1",
    "TABLE data",
]

REFUSED = [
    "",
    "SELECT 1; SELECT 2",
    "COPY data TO '/tmp/out.csv'",
    "ATTACH '/tmp/other.db' AS other",
    "DETACH other",
    "INSTALL httpfs",
    "FORCE INSTALL httpfs",
    "LOAD httpfs",
    "PRAGMA version",
    "SET spark.sql.runSQLOnFiles = true",
    "CALL checkpoint()",
    "CREATE TABLE x(i INTEGER)",
    "DROP TABLE data",
    "INSERT INTO data VALUES (1)",
    "UPDATE data SET i = 1",
    "DELETE FROM data",
    "BEGIN TRANSACTION",
    "EXPORT DATABASE '/tmp/export'",
    "EXPLAIN SELECT 1",
    "SHOW TABLES",
    "DESCRIBE data",
    "CACHE TABLE data",
    "ADD JAR '/x'",
    "EXECUTE IMMEDIATE 'SELECT 1'",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM csv.`/etc/passwd`",
    "SELECT * FROM other",
    "SELECT * FROM default.data",
    "SELECT * FROM read_csv('/etc/passwd')",
    "SELECT * FROM identifier('oth' || 'er')",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
    "SELECT filter(array(1), x -> reflect('a', 'b'))",
    "SELECT system.builtin.reflect('a', 'b')",
    "SELECT * FROM (SELECT transform(id) USING 'cat' FROM data)",
    "WITH a AS (SELECT transform(id) USING 'cat' FROM data) SELECT * FROM a",
    "WITH b AS (SELECT * FROM csv.`/etc/passwd`) SELECT 1",
    "SELECT * FROM data WHERE id = (SELECT reflect('a', 'b'))",
    "SELECT * FROM data WHERE EXISTS (SELECT * FROM text.`/etc/passwd`)",
    "FROM data INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(spark, sql):
    guard.check_statement(spark, sql) if '"' not in sql else bounded.select(spark.range(3), sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(DataError) as caught:
        guard.check_statement(spark, sql)
    assert caught.value.code == "QUERY_FORBIDDEN"


def test_registered_function_is_refused(spark):
    spark.udf.register("sneaky", lambda: 1, "int")
    with pytest.raises(DataError):
        guard.check_statement(spark, "SELECT sneaky()")


def test_statement_size(spark):
    with pytest.raises(DataError) as caught:
        guard.check_statement(spark, f"SELECT '{'x' * 65_537}'")
    assert caught.value.code == "QUERY_SQL_TOO_LARGE"


def test_rows_are_capped_and_flagged(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, value int")
    result = bounded.run(frame, "SELECT * FROM data ORDER BY value", bounded.QueryLimits(rows=2))
    assert [r.name for r in result.rows] == ["a", "b"]
    assert result.truncated and result.columns == ["name", "value"]
    whole = bounded.run(frame, "SELECT * FROM data", bounded.QueryLimits(rows=3))
    assert len(whole.rows) == 3 and not whole.truncated


def test_other_limits(spark):
    frame = spark.range(4)
    cases = [
        ("SELECT repeat('x', 100)", {"cell_bytes": 50}, "QUERY_CELL_LIMIT"),
        ("SELECT id, repeat('x', 100) FROM data", {"output_bytes": 200}, "QUERY_OUTPUT_LIMIT"),
        ("SELECT 1, 2, 3", {"columns": 2}, "QUERY_COLUMN_LIMIT"),
    ]
    for sql, limits, code in cases:
        with pytest.raises(DataError) as caught:
            bounded.run(frame, sql, bounded.QueryLimits(**limits))
        assert caught.value.code == code
    for value in (0, -1, 1_000_001, 1.5, True):
        with pytest.raises(DataError):
            bounded.QueryLimits(rows=value)


def test_timeout(spark):
    slow = "SELECT count(*) FROM range(20000000000) WHERE sin(id) + cos(id) > 5"
    with pytest.raises(DataError) as caught:
        bounded.run(spark.range(1), slow, bounded.QueryLimits(timeout_seconds=2))
    assert caught.value.code == "QUERY_TIMEOUT"


def test_settings_and_view_are_restored(spark):
    spark.range(2).createOrReplaceTempView("data")
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    with pytest.raises(DataError):
        bounded.run(spark.range(5), "DROP TABLE data")
    bounded.run(spark.range(5), "SELECT * FROM data")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before
    assert spark.table("data").count() == 2
    spark.catalog.dropTempView("data")


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(path)
    frame = bounded.select(spark.read.parquet(path), "SELECT b FROM data WHERE id > 90")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,90)]" in plan
    assert "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_stage_is_written_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    key = staged.stage_key("0" * 64, "csv", None, "x")
    assert staged.staged_table(spark, str(tmp_path), key, build).status == "miss"
    again = staged.staged_table(spark, str(tmp_path), key, build)
    assert again.status == "hit" and again.table.count() == 5 and len(built) == 1
    assert staged.staged_table(spark, str(tmp_path), key, build, warnings=1).status == "bypass"


def test_export_formats(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    bounded.export(frame, "SELECT * FROM data", str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 2
    with pytest.raises(DataError):
        bounded.export(frame, "SELECT * FROM data", str(tmp_path / "p"), "parquet")
