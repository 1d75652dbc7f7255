"""File queries: XML, archives, format inventory, delimited text, streams.

Files are made by Spark from the given tables; where a reader needs a real
folder, it is a new one below the session's checkpoint folder.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sievetable.operators import export, lineage, quality
from sievetable.plans.staged import stage_key, staged_table
from sievetable.session import checkpoint_dir
from sievetable.sources import (
    archives,
    delimited,
    headers,
    inventory,
    json_docs,
    positions,
    xml_records,
)
from sievetable.streaming import continuous
from workload.quality import _GROUPED, _PER_CELL, ISSUE_COLUMNS
from workload.registry import query
from workload.views import ORDERS_DIRTY_COLUMNS, ORDERS_DIRTY_SQL, orders_dirty, table

_DIRTY = f"WITH {ORDERS_DIRTY_SQL}"


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


# XML: a document per supplier nation, a record per supplier.


def supplier_xml(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    balance = F.format_string("%.2f", "s_acctbal")
    element = F.concat(
        F.lit('<s:supplier key="'),
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0"),
        F.lit('"><s:name>'),
        F.col("s_name"),
        F.lit('</s:name><s:account unit="usd"><s:balance> '),
        balance,
        F.lit(" </s:balance></s:account><s:tag>one</s:tag><s:tag>"),
        F.col("s_name"),
        F.lit("</s:tag><s:empty/></s:supplier>"),
    )
    # A nation's share of the suppliers grows with the table, so its document
    # is cut into files of at most a hundred suppliers.
    listed = suppliers.groupBy(
        "s_nationkey", F.floor(F.col("s_suppkey") / 100).alias("file")
    ).agg(F.array_join(F.array_sort(F.collect_list(element)), "").alias("body"))
    joined = listed.join(nations, listed.s_nationkey == nations.n_nationkey)
    return joined.select(
        F.concat("n_name", F.lit("/"), F.col("file").cast("string")).alias("document"),
        F.concat(
            F.lit('<?xml version="1.0"?><s:nation xmlns:s="urn:x"><s:title>'),
            F.col("n_name"),
            F.lit("</s:title>"),
            F.col("body"),
            F.lit("</s:nation>"),
        ).alias("xml"),
    )


_XML = """WITH f AS (SELECT n_name || '/' || s_suppkey // 100 AS document, * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT document, count(*) AS n FROM f GROUP BY 1)"""


@query(
    "xml_paths",
    f"""{_XML} SELECT document, '/s:nation' AS path, 1 AS occurrences FROM n
UNION ALL SELECT document, '/s:nation/s:title', 1 FROM n
UNION ALL SELECT document, '/s:nation/s:supplier', n FROM n
UNION ALL SELECT document, '/s:nation/s:supplier/s:name', n FROM n
UNION ALL SELECT document, '/s:nation/s:supplier/s:account', n FROM n
UNION ALL SELECT document, '/s:nation/s:supplier/s:account/s:balance', n FROM n
UNION ALL SELECT document, '/s:nation/s:supplier/s:tag', n * 2 FROM n
UNION ALL SELECT document, '/s:nation/s:supplier/s:empty', n FROM n""",
)
def xml_paths(spark, sf_dir):
    paths = xml_records.element_paths(supplier_xml(spark, sf_dir))
    return paths.select("document", "path", "occurrences")


@query(
    "xml_record_paths",
    f"""{_XML} SELECT document, n AS occurrences, 2::BIGINT AS candidates, NULL::VARCHAR AS record_path FROM n WHERE n > 1""",
)
def xml_record_paths(spark, sf_dir):
    """supplier and account repeat equally, so a path must be given."""
    return xml_records.record_paths(xml_records.element_paths(supplier_xml(spark, sf_dir)))


@query(
    "xml_rows",
    f"""{_XML} SELECT document, row_number() OVER (PARTITION BY document ORDER BY s_suppkey) - 1 AS record,
 lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS key, s_name AS name, printf('%.2f', s_acctbal) AS balance,
 'usd' AS unit, '["one","' || s_name || '"]' AS tag FROM f""",
)
def xml_rows(spark, sf_dir):
    names = ["@key", "s:name", "s:account/s:balance", "s:account/@unit", "s:tag"]
    flat = xml_records.record_rows(supplier_xml(spark, sf_dir), "/s:nation/s:supplier", names).drop("error")
    return flat.toDF("document", "record", "key", "name", "balance", "unit", "tag")


@query(
    "xml_broken_documents",
    f"""{_XML}, k AS (SELECT document, n, (ascii(document) + n) % 4 = 0 AS bad FROM n)
SELECT document, CASE WHEN bad THEN 0 ELSE n END AS records, CASE WHEN bad THEN 1 ELSE 0 END::BIGINT AS errors FROM k""",
)
def xml_broken_documents(spark, sf_dir):
    """Documents of which some lack their end: an error row each, and all rows of the others."""
    made = supplier_xml(spark, sf_dir)
    n = F.size(F.split("xml", "<s:empty/>")) - 1
    bad = (F.ascii("document") + n) % 4 == 0
    cut = F.when(bad, F.expr("substring(xml, 1, length(xml) - 12)")).otherwise(F.col("xml"))
    rows = xml_records.record_rows(made.withColumn("xml", cut), "/s:nation/s:supplier", ["s:name"])
    return rows.groupBy("document").agg(F.count("record").alias("records"), F.count("error").alias("errors"))


@query(
    "xml_native_rows",
    f"""{_XML} SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS key, s_name AS name,
 printf('%.2f', s_acctbal) AS balance, 'usd' AS unit FROM f""",
)
def xml_native_rows(spark, sf_dir):
    """The same records through Spark's XML reader."""
    path = scratch(spark)
    # A folder per fifty documents' numbers, so that the files grow with the input and not
    # their count; the documents stand below one root element.
    bundle = F.floor(F.split_part("document", F.lit("/"), F.lit(2)).cast("bigint") / 50).alias("bundle")
    document = F.replace("xml", F.lit('<?xml version="1.0"?>'), F.lit(""))
    bundles = supplier_xml(spark, sf_dir).groupBy(bundle).agg(
        F.concat(
            F.lit('<?xml version="1.0"?><s:nations xmlns:s="urn:x">'),
            F.array_join(F.array_sort(F.collect_list(document)), ""),
            F.lit("</s:nations>"),
        ).alias("value")
    )
    bundles.write.partitionBy("bundle").text(path)
    rows = xml_records.read_xml(spark, path, "s:supplier")
    picked = [F.col(f"`{c}`") for c in ("@key", "s:name", "s:account/s:balance", "s:account/@unit")]
    return rows.select(*picked).toDF("key", "name", "balance", "unit")


# Archives: one per document, made in the tasks.


def document_archives(spark, sf_dir):
    def build(batches):
        for batch in batches:
            contents = []
            for key, digest in zip(batch["doc_id"], batch["digest"], strict=True):
                target = io.BytesIO()
                with zipfile.ZipFile(target, "w") as made:
                    kind = key % 6
                    made.writestr("readme.txt", digest)
                    if kind in (0, 1):
                        made.writestr("data/rows.csv", "id,text\n1,x\n")
                    if kind == 1:
                        made.writestr("data/rows.json", "[]")
                    if kind == 2:
                        made.writestr("../up.csv", "id\n")
                    if kind == 3:
                        made.writestr("inner.zip", b"PK")
                    if kind == 4:
                        made.writestr("zeros.csv", "0" * 100_000, zipfile.ZIP_DEFLATED, 1)
                content = target.getvalue()
                contents.append(content[:20] if key % 60 == 5 else content)
            names = "a" + batch["doc_id"].astype(str)
            yield pd.DataFrame({"archive": names, "content": contents})

    # Texts stay out of Python: an archive holds the digest of its document's whole text.
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    documents = table(spark, sf_dir, "documents").select("doc_id", digest)
    return documents.mapInPandas(build, "archive string, content binary")


_ARCHIVE_OUTCOME = """CASE WHEN doc_id % 60 = 5 THEN 'INVALID_ARCHIVE_DATA' ELSE
 CASE doc_id % 6 WHEN 0 THEN 'selected' WHEN 1 THEN 'ARCHIVE_ENTRY_REQUIRED' WHEN 2 THEN 'UNSAFE_ARCHIVE_ENTRY'
 WHEN 3 THEN 'UNSAFE_ARCHIVE_ENTRY' WHEN 4 THEN 'ARCHIVE_LIMIT_EXCEEDED' ELSE 'ARCHIVE_NO_SUPPORTED_ENTRY' END END"""


@query(
    "archive_choice",
    f"""SELECT 'a' || doc_id AS archive, {_ARCHIVE_OUTCOME} AS outcome,
 CASE WHEN doc_id % 60 = 5 THEN 0 ELSE CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 5 THEN 1 ELSE 2 END END::BIGINT AS entries,
 CASE WHEN doc_id % 6 = 0 THEN 'data/rows.csv' END AS entry FROM documents""",
)
def archive_choice(spark, sf_dir):
    entries = archives.archive_entries(document_archives(spark, sf_dir))
    return archives.choose_entry(entries).select("archive", "outcome", "entries", "entry")


@query(
    "archive_extract",
    """SELECT 'a' || doc_id AS archive, 'data/rows.csv' AS entry, 'id,text' || chr(10) || '1,x' || chr(10) AS content
 FROM documents WHERE doc_id % 6 = 0""",
)
def archive_extract(spark, sf_dir):
    made = document_archives(spark, sf_dir)
    chosen = archives.choose_entry(archives.archive_entries(made))
    extracted = archives.extract_entries(made, chosen)
    return extracted.select("archive", "entry", F.col("content").cast("string").alias("content"))


# Inventory.


def corpus(spark, sf_dir):
    """A file per page: raw pages and rewritten ones, named by key."""
    page = F.col("page_id")
    kind = page % 8
    a, b = page.cast("string"), F.length("html").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("id,n\n"), a, F.lit(","), b, F.lit("\n")))
        .when(kind == 1, F.concat(F.lit("id\tn\n"), a, F.lit("\t"), b, F.lit("\n")))
        .when(kind == 2, F.concat(F.lit("id;n\n"), a, F.lit(";"), b, F.lit("\n")))
        .when(kind == 3, F.concat(F.lit('{"id":'), a, F.lit('}\n{"id":'), b, F.lit("}\n")))
        .when(kind == 4, F.concat(F.lit('[{"id":'), a, F.lit("}]")))
        .when(kind == 5, F.concat(F.lit('CHARSET="ANSI";MATRIX="m";STUB="a";VALUES("a")="x";DATA='), a, F.lit(";")))
        .when(kind == 6, F.concat(F.lit("PAR1"), F.col("html"), F.lit("PAR1")))
        .otherwise(F.concat(F.lit("\n  "), F.substring("html", 1, 20)))
    )
    content = F.when(
        (kind == 1) & (page % 3 == 0), F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    ).otherwise(F.encode(text, "UTF-8"))
    bad = F.concat(content, F.unhex(F.lit("FF")))
    content = F.when((kind == 0) & (page % 5 == 0), bad).otherwise(content)
    name = F.when(page % 2 == 0, ".CSV").otherwise(".tsv")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/in/p"), a, name).alias("path"),
        content.alias("content"),
        F.when(page % 7 == 0, "text/csv; header=present").alias("media_type"),
        F.lit(None).cast("string").alias("declared"),
    )


_CORPUS = """WITH k AS (SELECT '/in/p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.CSV' ELSE '.tsv' END AS path,
 page_id AS p, page_id % 8 AS kind, page_id % 7 = 0 AS media, page_id % 2 = 0 AS even,
 page_id % 8 = 0 AND page_id % 5 = 0 AS bad FROM pages),
f AS (SELECT *, CASE WHEN kind = 6 THEN 'parquet' WHEN kind = 5 THEN 'pcaxis'
   WHEN bad THEN CASE WHEN media THEN 'csv' WHEN even THEN 'csv' ELSE 'tsv' END
   WHEN kind = 1 THEN 'tsv' WHEN kind IN (0, 2) THEN 'csv' WHEN media THEN 'csv'
   WHEN kind = 3 THEN 'ndjson' WHEN kind = 4 THEN 'json' ELSE 'xml' END AS format FROM k)"""


@query(
    "file_inventory",
    f"""{_CORPUS} SELECT path, format,
 CASE WHEN kind = 6 THEN 'signature' WHEN kind = 5 THEN 'content' WHEN bad AND NOT media THEN 'extension'
      WHEN media AND kind = 1 THEN 'content' WHEN media THEN 'media-type' ELSE 'content' END AS confidence,
 CASE WHEN kind IN (5, 6) OR (bad AND NOT media) THEN NULL WHEN kind = 1 AND p % 3 = 0 THEN 'utf-16le' ELSE 'utf-8' END AS encoding,
 CASE WHEN bad THEN NULL WHEN kind = 0 THEN ',' WHEN kind = 1 THEN chr(9) WHEN kind = 2 THEN ';' END AS delimiter
FROM f""",
)
def file_inventory(spark, sf_dir):
    found = inventory.detect(corpus(spark, sf_dir))
    return found.select("path", "format", "confidence", "encoding", "delimiter")


@query(
    "file_issues",
    f"""{_CORPUS} SELECT path, format, 'INVALID_ENCODING' AS code FROM f WHERE bad AND media
UNION ALL SELECT path, format, 'DELIMITER_MISMATCH' FROM f
WHERE ((even AND format = 'tsv') OR (NOT even AND format = 'csv')) AND NOT (bad AND media)""",
)
def file_issues(spark, sf_dir):
    return inventory.file_issues(corpus(spark, sf_dir))


@query(
    "sniff_documents",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM documents),
t AS (SELECT doc_id, lines[1:10] AS lines FROM l),
c AS (SELECT doc_id, len(lines) AS n,
 list_transform(lines, lambda x: len(x) - len(replace(x, ',', ''))) AS a, list_transform(lines, lambda x: len(x) - len(replace(x, chr(9), ''))) AS b,
 list_transform(lines, lambda x: len(x) - len(replace(x, ';', ''))) AS s, list_transform(lines, lambda x: len(x) - len(replace(x, '|', ''))) AS p FROM t),
o AS (SELECT doc_id, CASE WHEN n >= 2 AND a[1] > 0 AND list_min(a) = list_max(a) THEN a[1] ELSE 0 END AS a,
 CASE WHEN n >= 2 AND b[1] > 0 AND list_min(b) = list_max(b) THEN b[1] ELSE 0 END AS b,
 CASE WHEN n >= 2 AND s[1] > 0 AND list_min(s) = list_max(s) THEN s[1] ELSE 0 END AS s,
 CASE WHEN n >= 2 AND p[1] > 0 AND list_min(p) = list_max(p) THEN p[1] ELSE 0 END AS p FROM c)
SELECT doc_id, CASE WHEN greatest(a, b, s, p) = 0 THEN NULL WHEN a = greatest(a, b, s, p) THEN ','
 WHEN b = greatest(a, b, s, p) THEN chr(9) WHEN s = greatest(a, b, s, p) THEN ';' ELSE '|' END AS delimiter FROM o""",
)
def sniff_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", inventory.sniff_delimiter(F.col("text")).alias("delimiter")
    )


# Delimited and JSON files.


@query(
    "csv_validate",
    _PER_CELL.replace("all_issues AS (", "listed AS (")
    + f""", dup AS ({_GROUPED[_GROUPED.index("SELECT 'DUPLICATE_ROW'") : _GROUPED.index("UNION ALL", _GROUPED.index("SELECT 'DUPLICATE_ROW'"))]})
SELECT * FROM listed WHERE code <> 'DUPLICATE_ROW' UNION ALL SELECT * FROM dup""",
)
def csv_validate(spark, sf_dir):
    """The dirty orders written as CSV and validated as a file."""
    path = scratch(spark)
    export.write_table(orders_dirty(spark, sf_dir), path, "csv")
    return delimited.validate_delimited(spark, path).select(*ISSUE_COLUMNS)


@query(
    "csv_ragged",
    """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 1 AS row FROM customer)
SELECT 'DUPLICATE_HEADER' AS code, 'Header ''name'' is duplicated.' AS message, 1::BIGINT AS row, 1::BIGINT AS occurrences
UNION ALL SELECT 'INCONSISTENT_COLUMN_COUNT', 'Row ' || min(row) || ' has ' || arg_min(CASE WHEN c_custkey % 7 = 0 THEN 4 ELSE 2 END, row) || ' columns; expected 3.',
 min(row), count(*) FROM r WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0""",
)
def csv_ragged(spark, sf_dir):
    """Customers as lines of uneven width under a repeated header."""
    key = F.col("c_custkey")
    name = F.concat(F.lit('"x, '), F.col("c_name"), F.lit('"'))
    line = (
        F.when(key % 7 == 0, F.concat_ws(",", key.cast("string"), name, F.lit("a"), F.lit("b")))
        .when(key % 11 == 0, F.concat_ws(",", key.cast("string"), name))
        .otherwise(F.concat_ws(",", key.cast("string"), name, F.lit("c")))
    )
    # Several files in the order of the keys, each with its header.
    ordered = table(spark, sf_dir, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    headed = F.when(first, F.concat(F.lit("id,name,name\n"), line)).otherwise(line)
    path = scratch(spark)
    ordered.select(headed.alias("value")).write.text(path)
    issues = delimited.validate_delimited(spark, path)
    return issues.filter(
        F.col("code").isin("DUPLICATE_HEADER", "INCONSISTENT_COLUMN_COUNT")
    ).select("code", "message", "row", "occurrences")


@query(
    "csv_typed_roundtrip",
    f"""{_DIRTY} SELECT sparse, mixed, count(*) AS n, sum(CAST(o_orderkey AS BIGINT))::BIGINT AS keys, min(CAST(o_orderdate AS DATE)) AS first_day
 FROM dirty GROUP BY ALL""",
)
def csv_typed_roundtrip(spark, sf_dir):
    """Null and empty text stay apart through a CSV file; types come back."""
    path = scratch(spark)
    export.write_table(orders_dirty(spark, sf_dir), path, "csv")
    typed = delimited.read_typed(spark, path, text=["mixed", "sparse"])
    return typed.groupBy("sparse", "mixed").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_orderkey").cast("bigint").alias("keys"),
        F.min("o_orderdate").alias("first_day"),
    )


@query(
    "json_roundtrip",
    "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
)
def json_roundtrip(spark, sf_dir):
    path = scratch(spark)
    export.write_table(table(spark, sf_dir, "customer"), path, "ndjson")
    rows = json_docs.read_json_lines(spark, path)
    return rows.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query(
    "json_scan_problems",
    """SELECT CASE WHEN strlen(text) + strlen(CAST(doc_id AS VARCHAR)) + 14 - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END > 5000
   THEN 'RECORD_TOO_LARGE' WHEN doc_id % 9 = 0 THEN 'INVALID_NDJSON' END AS problem, count(*) AS lines
 FROM documents GROUP BY 1""",
)
def json_scan_problems(spark, sf_dir):
    """A JSON line as long as each document; a ninth lack their last character."""
    key = F.col("doc_id")
    body = F.struct(key.alias("id"), F.repeat(F.lit("x"), F.octet_length("text")).alias("t"))
    line = F.to_json(body)
    cut = F.when(key % 9 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    path = scratch(spark)
    table(spark, sf_dir, "documents").select(cut.alias("value")).write.text(path)
    scanned = json_docs.scan_json_lines(spark, path, "id bigint, t string", max_record_bytes=5000)
    return scanned.groupBy("problem").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "header_plan",
    """SELECT c_custkey, c_name AS column_1, c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS name_2,
 CASE WHEN c_custkey % 10 = 0 THEN 'extra' END AS extra_column_4 FROM customer""",
)
def header_plan(spark, sf_dir):
    """Rows of cells under a header with a blank and a repeat; some rows overflow."""
    usual = F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    cells = F.when(F.col("c_custkey") % 10 == 0, F.array_append(usual, F.lit("extra"))).otherwise(usual)
    rows = table(spark, sf_dir, "customer").select("c_custkey", cells.alias("cells"))
    return headers.cells_to_columns(rows, "cells", ["", "name", "name"])


@query(
    "file_row_numbers",
    "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER () + 1 AS row FROM lineitem",
)
def file_row_numbers(spark, sf_dir):
    """Numbers that follow the order of the rows in the file."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_linenumber", "_metadata"
    )
    return positions.number_parquet_rows(rows).drop("_metadata")


@query(
    "convert_provenance",
    """SELECT 'csv' AS target, 'true' AS safe, CAST(count(*) AS VARCHAR) AS changes, 0::BIGINT AS problems,
 1::BIGINT AS wrong FROM orders WHERE o_orderkey < 0""".replace(
        "CAST(count(*) AS VARCHAR)",
        f"(WITH {ORDERS_DIRTY_SQL} SELECT CAST(count(*) FILTER (regexp_matches(note, '^[=+@-]')) AS VARCHAR) FROM dirty)",
    ).replace("1::BIGINT AS wrong", "0::BIGINT AS wrong").replace(" FROM orders WHERE o_orderkey < 0", ""),
)
def convert_provenance(spark, sf_dir):
    """Convert, then check the records against the files that were written."""
    path = scratch(spark)
    records = lineage.convert(
        orders_dirty(spark, sf_dir),
        path,
        "csv",
        source_format="parquet",
        source_sha256="0" * 64,
        spreadsheet=True,
    )
    details = F.col("transformations")[0]["details"]
    outcome = lineage.verify(lineage.file_digests(spark, path, "part-*"), records)
    n = F.count(F.lit(1)).alias("n")
    wrong = outcome.filter("outcome <> 'verified'").agg(n).scalar()
    problems = lineage.record_violations(records).agg(n).scalar()
    return records.select(
        details["targetFormat"].alias("target"),
        details["spreadsheetSafe"].alias("safe"),
        details["spreadsheetSafeChanges"].alias("changes"),
        problems.alias("problems"),
        wrong.alias("wrong"),
    ).distinct()


@query(
    "staged_reuse",
    """SELECT l_returnflag, count(*) AS n, 'miss' AS first, 'hit' AS second FROM lineitem GROUP BY 1""",
)
def staged_reuse(spark, sf_dir):
    """The second request reads what the first one wrote."""
    root = scratch(spark)
    key = stage_key("0" * 64, "parquet", None, spark.version)

    def build():
        return table(spark, sf_dir, "lineitem")

    first = staged_table(spark, root, key, build)
    second = staged_table(spark, root, key, build)
    return second.table.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(first.status).alias("first"),
        F.lit(second.status).alias("second"),
    )


@query(
    "stream_validation",
    f"""{_GROUPED} SELECT code, field, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM all_issues GROUP BY ALL""",
)
def stream_validation(spark, sf_dir):
    """The dirty orders arrive as a stream of files and are validated in batches."""
    source, root = scratch(spark), scratch(spark)
    orders_dirty(spark, sf_dir).repartition(4, "o_orderkey").write.parquet(source)
    stream = (
        spark.readStream.schema(orders_dirty(spark, sf_dir).schema)
        .option("maxFilesPerTrigger", 2)
        .parquet(source)
    )
    running = continuous.validate_stream(stream, root).trigger(availableNow=True).start()
    running.awaitTermination()
    return continuous.issues_so_far(spark, root)


