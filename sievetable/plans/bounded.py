"""One bounded read-only SQL statement over a prepared table."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.functions.cells import quoted
from sievetable.plans.guard import TABLE_NAME, check_statement

# Largest allowed limits.
MAXIMA = {
    "rows": 1_000_000,
    "timeout_seconds": 600,
    "sql_bytes": 64 * 1024,
    "columns": 4_096,
    "cell_bytes": 16 * 1024 * 1024,
    "output_bytes": 256 * 1024 * 1024,
}

# How a statement is read: quoted names are identifiers, paths are not tables.
_STATEMENT_CONF = {
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
}


@dataclass(frozen=True)
class QueryLimits:
    """Limits of one statement; ``rows=None`` sets no bound on a lazy result."""

    rows: int | None = 1_000
    timeout_seconds: int = 30
    sql_bytes: int = 64 * 1024
    columns: int = 256
    cell_bytes: int = 1024 * 1024
    output_bytes: int = 16 * 1024 * 1024

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "rows" and value is None:
                continue
            whole = isinstance(value, int) and not isinstance(value, bool)
            if not whole or not 0 < value <= MAXIMA[f.name]:
                raise DataError(
                    "QUERY_LIMIT_INVALID",
                    f"{f.name} must be a positive integer no larger than {MAXIMA[f.name]}.",
                    limit=f.name,
                    value=value,
                )


@dataclass(frozen=True)
class QueryResult:
    """Collected rows of a bounded statement."""

    columns: list[str]
    rows: list[Row]
    truncated: bool
    sql: str


#: The view and the settings belong to the session, so one statement is analysed at a time.
_SCOPE = threading.RLock()


@contextmanager
def _statement_scope(spark: SparkSession, table: DataFrame) -> Iterator[None]:
    """The table as view ``data`` and the reading rules; both restored after."""
    with _SCOPE:
        yield from _named_table(spark, table)


def _named_table(spark: SparkSession, table: DataFrame) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in _STATEMENT_CONF}
    existing = None
    if spark.catalog._jcatalog.tableExists(TABLE_NAME):
        existing = spark.table(TABLE_NAME)
    table.createOrReplaceTempView(TABLE_NAME)
    try:
        for key, value in _STATEMENT_CONF.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
        spark.catalog.dropTempView(TABLE_NAME)
        if existing is not None:
            existing.createOrReplaceTempView(TABLE_NAME)


def select(table: DataFrame, sql: str, limits: QueryLimits | None = None) -> DataFrame:
    """The checked statement as a lazy frame of at most ``rows`` + 1 rows.

    A row beyond ``rows`` tells that the result was cut. The scan behind ``data`` keeps column pruning and filter pushdown.
    """
    limits = limits or QueryLimits()
    spark = table.sparkSession
    with _statement_scope(spark, table):
        check_statement(spark, sql, max_sql_bytes=limits.sql_bytes)
        result = spark.sql(sql)
    if len(result.columns) > limits.columns:
        raise DataError(
            "QUERY_COLUMN_LIMIT", f"Query returns more than {limits.columns} columns."
        )
    return result if limits.rows is None else result.limit(limits.rows + 1)


def run(table: DataFrame, sql: str, limits: QueryLimits | None = None) -> QueryResult:
    """Run the statement under its time, row, cell and output limits."""
    limits = limits or QueryLimits()
    if limits.rows is None:
        raise DataError("QUERY_LIMIT_INVALID", "Collected rows need a bound.", limit="rows", value=None)
    frame = select(table, sql, limits)
    spark = table.sparkSession
    names = [f"c{i}" for i in range(len(frame.columns))]
    renamed = frame.toDF(*names)
    sizes = [F.octet_length(F.col(quoted(n)).cast("string")) for n in names]
    if any(f.dataType.typeName() in ("struct", "array", "map", "variant") for f in renamed.schema):
        sizes = [F.octet_length(F.to_json(F.struct(n))) for n in names]
    largest = F.array_max(F.array(*[F.coalesce(s, F.lit(0)) for s in sizes]))
    output = F.octet_length(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    measured = renamed.withColumns({"_cell": largest, "_output": output})

    rows, total = [], 0
    with _deadline(spark, limits.timeout_seconds):
        for row in measured.toLocalIterator():
            if row._cell > limits.cell_bytes:
                raise DataError("QUERY_CELL_LIMIT", "A query cell is too large.", limit=limits.cell_bytes)
            total += row._output
            if total > limits.output_bytes:
                raise DataError(
                    "QUERY_OUTPUT_LIMIT", "Query output is too large.", limit=limits.output_bytes
                )
            rows.append(Row(*frame.columns)(*row[: len(names)]))
    return QueryResult(
        columns=frame.columns,
        rows=rows[: limits.rows],
        truncated=len(rows) > limits.rows,
        sql=sql,
    )


@contextmanager
def _deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Interrupt this thread's Spark jobs when the time is up."""
    tag = f"bounded-{uuid.uuid4().hex}"
    expired = threading.Event()

    def stop() -> None:
        expired.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    spark.addTag(tag)
    timer.start()
    try:
        yield
    except Exception as error:
        if expired.is_set():
            raise DataError("QUERY_TIMEOUT", f"The query took more than {seconds} s.") from error
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
    if expired.is_set():
        raise DataError("QUERY_TIMEOUT", f"The query took more than {seconds} s.")


def export(table: DataFrame, sql: str, path: str, target: str, **options: object) -> bool:
    """Write a statement's rows as csv, tsv, json or ndjson; whether rows were left out."""
    from sievetable.operators.export import write_table

    if target not in ("csv", "tsv", "json", "ndjson"):
        raise DataError("QUERY_OUTPUT_FORMAT", "Query output is csv, tsv, json or ndjson.")
    limits = options.pop("limits", None) or QueryLimits()
    frame = select(table, sql, limits)
    if limits.rows is None:
        write_table(frame, path, target, **options)
        return False
    write_table(frame.limit(limits.rows), path, target, **options)
    return not frame.offset(limits.rows).isEmpty()
