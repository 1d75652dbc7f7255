"""Queries over paths: detection, quoted line breaks, parse errors, staging, refusals.

The files are written by Spark from the given tables into a new folder below the
session's checkpoint folder.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.operators import cube, export, lineage, quality, selection, snapshot
from sievetable.plans import bounded, paths
from sievetable.plans.staged import kept
from sievetable.sources import cube_files, delimited, headers, inventory, json_docs, json_items, positions, ranges, tables
from workload.files import scratch
from workload.quality import _GROUPED
from workload.registry import query
from workload.views import orders_dirty, table

_ALL = bounded.QueryLimits(rows=None)
# So many bytes of a table's files go into one written file.
PART_BYTES = 16 * 1024 * 1024
SPLIT_BYTES = (64 * 1024, 4 * 1024 * 1024)


def scanned_bytes(frame):
    """Bytes of the files that a frame reads, as its plan estimates them."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(frame, least):
    """How many files a frame is written to: a number that grows with it, so that no task gets more."""
    return max(least, scanned_bytes(frame) // PART_BYTES)


def split_bytes(files):
    """Splits of 64 KiB for small files, and of up to 4 MiB, below the size of a file, for large ones."""
    least, most = SPLIT_BYTES
    return min(most, max(least, scanned_bytes(files) // 256))


def written_documents(spark, sf_dir, target):
    path = scratch(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    export.write_table(documents.repartition(parts(documents, 2), "doc_id"), path, target)
    return path


@query("open_ndjson_large", "SELECT doc_id, sha256(text) AS digest, lang, source FROM documents")
def open_ndjson_large(spark, sf_dir):
    """Documents as NDJSON files beyond the size of the sample, opened by their content."""
    opened = tables.open_table(spark, written_documents(spark, sf_dir, "ndjson"))
    return opened.table.select("doc_id", F.sha2("text", 256).alias("digest"), "lang", "source")


@query(
    "detect_corpus_large",
    """SELECT f.format, count(*) AS files FROM (SELECT DISTINCT lang FROM documents) l,
 (VALUES ('ndjson'), ('csv'), ('parquet')) f(format) GROUP BY 1""",
)
def detect_corpus_large(spark, sf_dir):
    """A file for each language and format, told apart by what they hold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").repartition("lang")
    root = scratch(spark)
    for target in ("ndjson", "csv", "parquet"):
        export.write_table(documents, f"{root}/{target}", target, partition_by=["lang"])
    found = tables.detect_files(spark, root)
    return found.groupBy("format").agg(F.count(F.lit(1)).alias("files"))


@query(
    "detect_corpus_edges",
    """WITH g AS (SELECT DISTINCT doc_id // 500 AS g FROM documents)
SELECT format, confidence, encoding, (SELECT count(*) FROM g) AS files, (SELECT count(*) FROM g) AS digests
FROM (VALUES ('csv', 'content', 'utf-16le'), ('parquet', 'signature', NULL), ('xlsx', 'signature', NULL)) f(format, confidence, encoding)""",
)
def detect_corpus_edges(spark, sf_dir):
    """Files that their first or last bytes tell: UTF-16, Parquet without an extension, workbooks."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 500).alias("part"), "doc_id", "text", "n_chars")
    root = scratch(spark)

    def written(frame: pd.DataFrame) -> pd.DataFrame:
        part = frame["part"].iloc[0]
        lines = [f"{i};{n}" for i, n in zip(frame["doc_id"], frame["n_chars"])]
        book = io.BytesIO()
        with zipfile.ZipFile(book, "w") as archive:
            for at, text in enumerate(frame["text"]):
                archive.writestr(f"xl/media/{at}.txt", text)
            archive.writestr("[Content_Types].xml", "<Types/>")
            archive.writestr("xl/workbook.xml", "<workbook/>")
        columns = io.BytesIO()
        pq.write_table(pa.table({"text": list(frame["text"])}), columns, compression="none")
        files = {
            f"{part}-wide.txt": b"\xff\xfe" + "\r\n".join(["id;n", *lines]).encode("utf-16-le"),
            f"{part}-columns": columns.getvalue(),
            f"{part}-book": book.getvalue(),
        }
        return pd.DataFrame({"name": list(files), "content": list(files.values())})

    made = rows.groupBy("part").applyInPandas(written, "name string, content binary")
    ranges.write_files(spark, made, root)
    files = ranges.listed(spark, root)
    found = inventory.detect(inventory.read_heads(spark, root)).groupBy("format", "confidence", "encoding")
    digests = lineage.file_digests(spark, root).join(files.select("path", F.sha2("content", 256).alias("sha256")), ["path", "sha256"])
    return found.agg(F.count(F.lit(1)).alias("files")).withColumn(
        "digests", F.floor(digests.agg(F.count(F.lit(1))).scalar() / 3)
    )


@query("csv_multiline_roundtrip", "SELECT doc_id, sha256(text) AS digest, lang, source FROM documents")
def csv_multiline_roundtrip(spark, sf_dir):
    """Texts with line breaks come back from delimited files as they were."""
    opened = tables.open_table(spark, written_documents(spark, sf_dir, "csv"), text_columns=["text"])
    return opened.table.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("digest"), "lang", "source")


@query(
    "csv_multiline_validate",
    """SELECT 0::BIGINT AS structural, (SELECT count(*) FROM documents) AS records""",
)
def csv_multiline_validate(spark, sf_dir):
    """Quoted line breaks are no structural issue."""
    path = written_documents(spark, sf_dir, "csv")
    issues = delimited.validate_delimited(spark, path)
    codes = ["INCONSISTENT_COLUMN_COUNT", "MALFORMED_DELIMITED_DATA", "INVALID_ENCODING"]
    found = issues.filter(F.col("code").isin(codes)).agg(F.count(F.lit(1)).alias("structural"))
    records = delimited.read_delimited(spark, path).agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.withColumn("records", records)


@query(
    "csv_multiline_splits",
    """SELECT doc_id, sha256(text) AS digest, row_number() OVER (ORDER BY doc_id) AS number, true AS many_splits FROM documents""",
)
def csv_multiline_splits(spark, sf_dir):
    """Files whose quoted texts go over the borders of many splits, cut into their records.

    A small table is one file. A larger one is cut by its order, as one task writes a file.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark)
    ranged = documents.repartitionByRange(parts(documents, 1), "doc_id").sortWithinPartitions("doc_id")
    export.write_table(ranged, path, "csv")
    written = spark.read.text(path)
    files = len(written.inputFiles())
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(split_bytes(written)))
    try:
        splits = spark.read.text(path).rdd.getNumPartitions()
        found = kept(delimited.data_records(spark, path, ",", "UTF-8"), "records")
    finally:
        spark.conf.set(setting, before)
    cells = delimited.parsed_records(found, documents.schema, ",", "FAILFAST")
    # The names of the files have their order.
    numbered = positions.number_file_rows(cells, [F.col("file")], F.col("number"), pieces=files, row="number", start=1)
    return numbered.select(
        "doc_id", F.sha2("text", 256).alias("digest"), "number", F.lit(splits > files).alias("many_splits")
    )


@query("csv_relaxed_rows", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def csv_relaxed_rows(spark, sf_dir):
    """Relaxed reading: missing cells are null, cells beyond the header are dropped."""
    key = F.col("c_custkey")
    cells = [key.cast("string"), F.col("c_name")]
    line = F.when(key % 3 == 0, F.concat_ws(",", *cells)).when(
        key % 3 == 1, F.concat_ws(",", *cells, "c_mktsegment", F.lit("more"))
    ).otherwise(F.concat_ws(",", *cells, "c_mktsegment"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    headed = F.when(first, F.concat(F.lit("id,name,segment\n"), line)).otherwise(line)
    path = scratch(spark)
    table(spark, sf_dir, "customer").repartition(2, "c_custkey").select(headed.alias("value")).write.text(path)
    rows = delimited.read_delimited(spark, path, relaxed=True)
    return rows.select(F.col("id").cast("bigint").alias("c_custkey"), "name", "segment")


@query("ndjson_validate", f"""{_GROUPED} SELECT code, field, row, occurrences FROM all_issues""")
def ndjson_validate(spark, sf_dir):
    """The dirty orders as NDJSON in their order: issues carry the rows of the files."""
    dirty = orders_dirty(spark, sf_dir)
    place = F.col("o_orderkey").cast("bigint")
    path = scratch(spark)
    export.write_table(dirty.repartitionByRange(parts(dirty, 4), place).sortWithinPartitions(place), path, "ndjson")
    return tables.validate_path(spark, path).select("code", "field", "row", "occurrences")


@query(
    "json_parse_errors",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 1 AS row FROM documents)
SELECT 'PARSE_ERROR' AS code, min(row) AS row, count(*) AS occurrences FROM r WHERE doc_id % 9 = 4""",
)
def json_parse_errors(spark, sf_dir):
    """A ninth of the lines lack their last character: one issue, with the first row and a count."""
    key = F.col("doc_id")
    line = F.to_json(F.struct(key.alias("id"), "text"))
    cut = F.when(key % 9 == 4, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = documents.repartitionByRange(parts(documents, 3), "doc_id").sortWithinPartitions("doc_id")
    path = scratch(spark)
    ordered.select(cut.alias("value")).write.text(path)
    issues = tables.validate_json_lines(spark, path).filter("code = 'PARSE_ERROR'")
    return issues.select("code", "row", "occurrences")


@query("json_document_items", "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def json_document_items(spark, sf_dir):
    """A JSON array for each part of the documents, read as its items."""
    items = table(spark, sf_dir, "documents").select(
        F.pmod("doc_id", F.lit(16)).alias("part"), F.to_json(F.struct("doc_id", "lang")).alias("item")
    )
    arrays = items.groupBy("part").agg(
        F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list("item")), ",\n"), F.lit("]")).alias("value")
    )
    path = scratch(spark)
    arrays.repartition("part").write.partitionBy("part").text(path)
    rows = json_docs.read_json_document(spark, path)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "json_array_splits",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS number, sha256(text) AS digest,
 true AS many_splits FROM documents""",
)
def json_array_splits(spark, sf_dir):
    """Four lists as arrays on many splits: items carry their place and their whole text.

    Of a small table each list is one array. Of a larger one it is cut by its order into
    arrays of bounded size, as one task writes a file, and the places go on through them.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = parts(documents, 1)
    ends = documents.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    width = 1 if ends.low is None else -(-(ends.high - ends.low + 1) // blocks)
    block = F.floor((F.col("doc_id") - F.lit(ends.low)) / width).alias("block")
    part = F.pmod("doc_id", F.lit(4)).alias("part")
    item = F.concat(F.lit(","), F.to_json(F.struct("doc_id", "text")))
    items = documents.select(part, block, F.lit(1).alias("turn"), "doc_id", item.alias("value"))
    bracket = F.when(F.col("turn") == 0, F.lit('[{"doc_id":null}')).otherwise(F.lit("]"))
    frames = documents.select(part, block).distinct().withColumn("turn", F.explode(F.array(F.lit(0), F.lit(2))))
    lines = items.unionByName(
        frames.select("part", "block", "turn", F.lit(None).cast("bigint").alias("doc_id"), bracket.alias("value"))
    )
    path = scratch(spark)
    ordered = lines.repartition(4 * blocks, "part", "block").sortWithinPartitions("part", "block", "turn", "doc_id")
    ordered.select("part", "block", "value").write.partitionBy("part", "block").text(path)
    written = spark.read.text(path)
    files = len(written.inputFiles())
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(split_bytes(written)))
    try:
        splits = spark.read.text(path).rdd.getNumPartitions()
        found = kept(json_items.read_items(spark, path).items.select("part", "block", "number", "value"), "items")
    finally:
        spark.conf.set(setting, before)
    # Each array starts with an item of its own, number 0.
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("part", "block").agg(F.max("number").alias("last"))
    offsets = sizes.select("part", "block", F.coalesce(F.sum("last").over(earlier), F.lit(0)).alias("offset"))
    placed = found.join(F.broadcast(offsets), ["part", "block"]).withColumn("number", F.col("number") + F.col("offset"))
    parsed = placed.select("number", F.from_json("value", "doc_id bigint, text string").alias("item"))
    digest = F.sha2("item.text", 256).alias("digest")
    rows = parsed.select("item.doc_id", "number", digest, F.lit(splits > files).alias("many_splits"))
    return rows.filter("doc_id IS NOT NULL")


@query(
    "json_cells",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance, '{"b":1}' AS plain FROM customer""",
)
def json_cells(spark, sf_dir):
    """Text cells declared as JSON are decoded; other text stays as it is."""
    balance = F.to_json(F.struct(F.col("c_acctbal").alias("b")))
    cell = F.when(F.col("c_custkey") % 2 == 0, balance).otherwise(F.lit("{broken"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", cell.alias("j"), F.lit('{"b":1}').alias("plain"))
    decoded = json_docs.json_columns_to_variant(rows, ["j"])
    value = F.try_variant_get("j", "$.b", "double")
    return decoded.select("c_custkey", value.alias("balance"), "plain")


@query("file_sizes", "SELECT CAST(page_id AS VARCHAR) AS page, strlen(html)::BIGINT + 1 AS bytes FROM pages")
def file_sizes(spark, sf_dir):
    """Every page as a file, with its size from the inventory."""
    path = scratch(spark)
    # A folder for a thousand pages; a task writes its files itself, so the driver moves none.
    name = F.concat_ws("/", F.floor(F.col("page_id") / 1000), F.concat(F.lit("page_id="), "page_id"))
    pages = table(spark, sf_dir, "pages").select(
        name.alias("name"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).cast("binary").alias("content")
    )
    ranges.write_files(spark, pages.repartition(parts(pages, 2), "name"), path)
    found = inventory.read_corpus(spark, path)
    return found.select(F.regexp_extract("path", r"page_id=(\d+)", 1).alias("page"), "bytes")


@query(
    "file_preview",
    """SELECT o_orderkey, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 20""",
)
def file_preview(spark, sf_dir):
    """The first twenty rows and whether there are more."""
    found = selection.preview(table(spark, sf_dir, "orders"), order_by=["o_orderkey"])
    return found.rows.select("o_orderkey").crossJoin(found.truncated)


@query(
    "query_path_staged",
    """SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, 'miss' AS first, 'hit' AS second
 FROM customer GROUP BY 1""",
)
def query_path_staged(spark, sf_dir):
    """A statement over NDJSON files; the second request reads what the first one wrote."""
    path, root = scratch(spark), scratch(spark)
    export.write_table(table(spark, sf_dir, "customer"), path, "ndjson")
    sql = 'SELECT "c_mktsegment", count(*) AS n, round(sum("c_acctbal"), 2) AS balance FROM data GROUP BY ALL'
    first = paths.query_path(spark, path, sql, root=root, limits=_ALL)
    second = paths.query_path(spark, path, sql, root=root, limits=_ALL)
    return second.frame.withColumns({"first": F.lit(first.status), "second": F.lit(second.status)})


@query(
    "query_output_provenance",
    """SELECT 'query' AS operation, 'true' AS truncated, 10::BIGINT AS rows, 0::BIGINT AS unverified, true AS same_source""",
)
def query_output_provenance(spark, sf_dir):
    """Ten rows of a statement written with records that match the files."""
    path, root, output = scratch(spark), scratch(spark), scratch(spark)
    export.write_table(table(spark, sf_dir, "customer"), path, "ndjson")
    sql = 'SELECT "c_custkey", "c_name" FROM data ORDER BY "c_custkey"'
    limits = bounded.QueryLimits(rows=10)
    records = paths.export_query(spark, path, sql, output, "csv", root=root, limits=limits)
    source = lineage.table_digest(lineage.file_digests(spark, path)).first().sha256
    outcome = lineage.verify(lineage.file_digests(spark, output, "part-*"), records)
    n = F.count(F.lit(1)).alias("n")
    step = F.col("transformations")[0]
    return records.select(
        step["operation"].alias("operation"),
        step["details"]["truncated"].alias("truncated"),
        delimited.read_delimited(spark, output).agg(n).scalar().alias("rows"),
        outcome.filter("outcome <> 'verified'").agg(n).scalar().alias("unverified"),
        (step["inputSha256"] == source).alias("same_source"),
    ).distinct()


@query("path_schema", """SELECT unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']) AS name,
 unnest(['double', 'integer', 'string', 'string', 'integer']) AS type, false AS nullable, (SELECT count(*) FROM customer) AS sampled_rows""")
def path_schema(spark, sf_dir):
    """The schema of delimited files, inferred over all rows."""
    path = scratch(spark)
    customers = table(spark, sf_dir, "customer")
    export.write_table(customers.select(*sorted(customers.columns)), path, "csv")
    return paths.schema_path(spark, path).select("name", "type", "nullable", "sampled_rows")


@query(
    "bounded_result",
    """SELECT l_orderkey, l_linenumber, true AS truncated FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 50""",
)
def bounded_result(spark, sf_dir):
    """A collected result under its limits, and that it was cut."""
    sql = 'SELECT "l_orderkey", "l_linenumber" FROM data ORDER BY "l_orderkey", "l_linenumber", "l_partkey"'
    lines = table(spark, sf_dir, "lineitem")
    found = bounded.run(lines, sql, bounded.QueryLimits(rows=50))
    rows = [(*row, found.truncated) for row in found.rows]
    return spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, truncated boolean")


@query(
    "bounded_refusals",
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'refused' WHEN 2 THEN 'refused' ELSE 'refused' END AS outcome FROM nation""",
)
def bounded_refusals(spark, sf_dir):
    """Statements about every nation: a query, a file read, a write, a second statement."""
    nations = table(spark, sf_dir, "nation")
    outcomes = []
    for key, name in nations.select("n_nationkey", "n_name").toLocalIterator():
        sql = [
            f"SELECT count(*) FROM data WHERE \"n_name\" = '{name}'",
            f"SELECT * FROM parquet.`/{name}`",
            f"INSERT INTO data SELECT '{name}'",
            f"SELECT 1; SELECT '{name}'",
        ][key % 4]
        try:
            bounded.select(nations, sql, _ALL)
            outcomes.append((key, "ok"))
        except DataError:
            outcomes.append((key, "refused"))
    return spark.createDataFrame(outcomes, "n_nationkey int, outcome string")


@query(
    "validation_limits",
    """SELECT unnest(['VALIDATION_COLUMN_LIMIT', 'VALIDATION_RECORD_LIMIT', 'VALIDATION_RECORD_TOO_LARGE', 'VALIDATION_TOTAL_BYTES_LIMIT']) AS code,
 (SELECT count(*) FROM orders) AS rows""",
)
def validation_limits(spark, sf_dir):
    """Each bound that the orders exceed."""
    orders = table(spark, sf_dir, "orders")
    bounds = [{"max_columns": 2}, {"max_records": 10}, {"max_record_bytes": 20}, {"max_total_bytes": 1000}]
    codes = []
    for bound in bounds:
        try:
            quality.check_limits(orders, quality.ValidationLimits(**bound))
        except DataError as error:
            codes.append((error.code,))
    found = spark.createDataFrame(codes, "code string")
    return found.withColumn("rows", orders.agg(F.count(F.lit(1)).alias("n")).scalar())


@query(
    "export_refusals",
    """SELECT 'EMPTY_INPUT' AS empty_input, 'exists' AS second_write, count(*) AS rows FROM nation""",
)
def export_refusals(spark, sf_dir):
    """Nothing is written from no rows, and nothing is overwritten unless forced."""
    nations = table(spark, sf_dir, "nation")
    path = scratch(spark)
    try:
        export.require_rows(nations.filter("n_nationkey < 0"))
        empty = "written"
    except DataError as error:
        empty = error.code
    export.write_table(nations, path, "csv")
    try:
        export.write_table(nations, path, "csv")
        second = "written"
    except Exception:  # Spark's own error for a path that exists
        second = "exists"
    export.write_table(nations, path, "csv", force=True)
    rows = delimited.read_delimited(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"empty_input": F.lit(empty), "second_write": F.lit(second)}
    )


@query(
    "blank_headers",
    """SELECT 'EMPTY_HEADER' AS code, 2 AS column, count(*) AS rows FROM region""",
)
def blank_headers(spark, sf_dir):
    """A header cell without a name."""
    path = scratch(spark)
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    line = F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name")
    regions.select(F.when(first, F.concat(F.lit("id,\n"), line)).otherwise(line).alias("value")).write.text(path)
    issues = delimited.validate_delimited(spark, path).filter("code = 'EMPTY_HEADER'")
    rows = delimited.read_delimited(spark, path).agg(F.count(F.lit(1)).alias("n")).scalar()
    return issues.select("code", "column").withColumn("rows", rows)


# Cubes: one per nation, a cell for each of its customers.


def nation_cubes(spark, sf_dir):
    """PC-Axis texts; some have a bad cell, no values for a dimension, or a short translated list."""
    key = F.col("c_nationkey")
    names = F.array_sort(F.collect_list(F.struct("c_custkey")))
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(names.alias("d"))
    values = F.array_join(F.transform("d", lambda x: F.concat(F.lit('"c'), x["c_custkey"].cast("string"), F.lit('"'))), ",")
    cells = F.array_join(
        F.transform(
            "d",
            lambda x: F.when((key % 3 == 0) & (x["c_custkey"] % 10 == 0), F.lit("x")).otherwise(
                x["c_custkey"].cast("string")
            ),
        ),
        " ",
    )
    stub = F.when(key % 3 == 1, F.lit('STUB="a","z";')).otherwise(F.lit('STUB="a";'))
    translated = F.when(key % 3 == 2, F.lit('LANGUAGES="sl","en";STUB[en]="b";VALUES[en]("b")="only one","two";'))
    text = F.concat(
        F.lit('CHARSET="ANSI";CODEPAGE="windows-1250";MATRIX="m";'),
        stub,
        F.lit('VALUES("a")='),
        values,
        F.lit(";"),
        F.coalesce(translated, F.lit("")),
        F.lit("DATA=\n"),
        cells,
        F.lit(";"),
    )
    return per.select(key.cast("string").alias("cube"), F.encode(text, "UTF-8").alias("content"))


@query(
    "cube_files_bad_cells",
    """SELECT CAST(c_nationkey AS VARCHAR) AS cube, 'x' AS token, count(*) AS cells FROM customer
 WHERE c_nationkey % 3 = 0 AND c_custkey % 10 = 0 GROUP BY 1""",
)
def cube_files_bad_cells(spark, sf_dir):
    """Cells that are no number and no symbol."""
    chunks = cube_files.cell_chunks(nation_cubes(spark, sf_dir)).drop("error")
    return cube.invalid_tokens(chunks).groupBy("cube", "token").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "cube_files_mixed",
    """WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS cube, CASE k % 3 WHEN 1 THEN 'dimension without VALUES' ELSE 'VALUES translation' END AS detail
 FROM n WHERE k % 3 = 1 OR (k % 3 = 2 AND n <> 2)""",
)
def cube_files_mixed(spark, sf_dir):
    """A dimension without values, and translated lists of another length."""
    rows = cube_files.statements(nation_cubes(spark, sf_dir))
    return cube_files.metadata_problems(rows).select("cube", "detail")


@query(
    "cube_bounds",
    """SELECT CAST(c_nationkey AS VARCHAR) AS cube, 'too many dimensions' AS problem, count(*) AS actual FROM customer
 GROUP BY 1 HAVING count(*) > 64""",
)
def cube_bounds(spark, sf_dir):
    """A dimension for each customer of a nation: too many beyond 64."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    dimensions = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("cube"), place.alias("dimension"), F.col("c_name").alias("name")
    )
    return cube.check_dimensions(dimensions)


@query(
    "cat_manifest_mismatch",
    """SELECT 'v1/snapshots/' || doc_id || '.json' AS snapshot_path, unnest(CASE doc_id % 5 WHEN 0 THEN ['count'] WHEN 1 THEN ['bytes', 'sha256']
 WHEN 2 THEN ['manifest'] WHEN 3 THEN ['generatedAt'] ELSE [] END) AS field FROM documents""",
)
def cat_manifest_mismatch(spark, sf_dir):
    """Snapshots against manifests: a wrong count, other bytes, none at all, another time."""
    kind = F.col("doc_id") % 5
    made = F.lit("2026-01-01T00:00:00Z")
    content = F.to_json(F.struct(F.length("text").alias("count"), made.alias("generatedAt"), "text"))
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("v1/snapshots/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("snapshot_path"),
        F.length("text").cast("bigint").alias("count"),
        content.alias("content"),
    )
    listed = files.withColumn("generated_at", made)
    manifests = listed.filter(kind != 2).select(
        "snapshot_path",
        F.when(kind == 0, F.col("count") + 1).otherwise(F.col("count")).alias("count"),
        F.when(kind == 3, F.lit("2026-01-02T00:00:00Z")).otherwise(made).alias("generated_at"),
        F.octet_length("content").cast("bigint").alias("bytes"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
    )
    changed = F.when(kind == 1, F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    return snapshot.manifest_mismatches(files.select("snapshot_path", changed.alias("content")), manifests)


@query(
    "header_overflow",
    """SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'x' END AS extra_column_2 FROM supplier""",
)
def header_overflow(spark, sf_dir):
    """Cells beyond the header get columns of their own."""
    cells = F.when(F.col("s_suppkey") % 4 == 0, F.array("s_name", F.lit("x"))).otherwise(F.array("s_name"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", cells.alias("cells"))
    return headers.cells_to_columns(rows, "cells", ["name"])
