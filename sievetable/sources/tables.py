"""Open, validate or convert a path, whatever its format.

Every file below a folder is looked at first. Files of different formats, dialects
or headers are an error that names them; they are never read by each other's rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievetable.errors import DataError
from sievetable.operators import cube, quality
from sievetable.operators.lineage import convert, file_digests, table_digest
from sievetable.plans.staged import kept
from sievetable.sources import (
    cube_files,
    delimited,
    inventory,
    json_docs,
    json_items,
    positions,
    xml_records,
)

# Formats that are read as a table.
TABLE_FORMATS = ("csv", "tsv", "json", "ndjson", "parquet", "xml", "pcaxis")


class Opened(NamedTuple):
    """A table, how it was recognised, and columns that are codes."""

    table: DataFrame
    format: str
    code_columns: list[str]


def detect_files(
    spark: SparkSession, path: str, *, media_type: str | None = None, declared: str | None = None
) -> DataFrame:
    """Format evidence of every non-empty file of a path."""
    heads = inventory.read_heads(spark, path).withColumns(
        {
            "media_type": F.lit(media_type).cast("string"),
            "declared": F.lit(declared).cast("string"),
        }
    )
    return inventory.detect(heads)


def detect_path(
    spark: SparkSession, path: str, *, media_type: str | None = None, declared: str | None = None
) -> Row:
    """format, confidence, encoding, delimiter and first file of a path whose files are alike.

    ``mismatched`` counts the files whose extension names the other delimiter.
    """
    found = detect_files(spark, path, media_type=media_type, declared=declared)
    rules = ["format", "header", "read_as"]
    first = F.min(F.struct("path", "extension", "confidence", "bytes")).alias("first")
    # Two kinds are enough to refuse, so the driver sees three rows at most.
    other = ((F.col("extension") == "csv") & (F.col("format") == "tsv")) | (
        (F.col("extension") == "tsv") & (F.col("format") == "csv")
    )
    mismatched = F.count_if(other).alias("mismatched")
    # A header without rows, as Spark writes it for an empty first partition, shows no
    # delimiter. It goes with the files that have the same header.
    told = [
        F.max("encoding").alias("encoding"),
        F.min("delimiter").alias("delimiter"),
        (F.min("delimiter") != F.max("delimiter")).alias("differ"),
    ]
    named = found.withColumn("read_as", F.coalesce("encoding", F.lit("utf-8")))
    grouped = named.groupBy(*rules).agg(first, mismatched, *told).select(
        "format", "encoding", "delimiter", "header", "mismatched", "differ", "first.*"
    )
    kinds = grouped.orderBy("path").limit(3).collect()
    if not kinds:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        if files.select("path").isEmpty():
            raise DataError("LOCAL_FILE_NOT_FOUND", "There is no file at the path.", path=path)
        raise DataError("EMPTY_INPUT", "All files of the path are empty.", path=path)
    if len({k.format for k in kinds}) > 1:
        raise DataError(
            "MIXED_FORMATS",
            "The files of the path have different formats.",
            formats={k.path: k.format for k in kinds},
        )
    if kinds[0].format in ("csv", "tsv") and (len(kinds) > 1 or kinds[0].differ):
        raise DataError(
            "MIXED_HEADERS",
            "The files of the path have different headers or dialects.",
            headers={k.path: k.header for k in kinds},
        )
    return kinds[0]


def open_table(
    spark: SparkSession,
    path: str,
    *,
    format: str | None = None,
    record_path: str | None = None,
    text_columns: Sequence[str] = (),
) -> Opened:
    """The typed table of a path."""
    found = None if format in ("json", "ndjson", "parquet", "xml", "pcaxis") else detect_path(spark, path)
    form = format or found.format
    if form not in TABLE_FORMATS:
        raise DataError("UNSUPPORTED_FORMAT", f"'{form}' is not read as a table.", format=form)
    if form in ("csv", "tsv"):
        delimiter = found.delimiter or ("," if form == "csv" else "\t")
        encoding = found.encoding or "utf-8"
        table = delimited.read_typed(spark, path, delimiter, encoding=encoding, text=text_columns)
        return Opened(table, form, list(text_columns))
    if form == "json":
        return Opened(json_docs.read_json_document(spark, path), form, [])
    if form == "ndjson":
        return Opened(json_docs.read_json_lines(spark, path), form, [])
    if form == "parquet":
        return Opened(spark.read.parquet(path), form, [])
    if form == "xml":
        return Opened(_open_xml(spark, path, record_path), form, [])
    return _open_cube(spark, path)


def _xml_records(spark: SparkSession, path: str, record_path: str | None) -> DataFrame:
    """Records of all documents, and a row with an error for each broken one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    documents = files.select(F.col("path").alias("document"), F.col("content").alias("xml"))
    if record_path is None:
        paths = xml_records.element_paths(documents)
        best = xml_records.record_paths(paths, per_document=False)
        chosen = best.orderBy(F.col("occurrences").desc()).first()
        record_path = chosen.record_path if chosen is not None else None
    if record_path is None:
        raise DataError("XML_RECORD_PATH_REQUIRED", "Choose the path of the records.")
    return xml_records.xml_records(documents.withColumn("record_path", F.lit(record_path)))


def _xml_table(records: DataFrame) -> DataFrame:
    # Names are schema: the driver gets one row per distinct field.
    names = sorted(r.field for r in xml_records.field_names(records).collect())
    if not names:
        raise DataError("EMPTY_INPUT", "The path has no records.")
    return xml_records.record_columns(records, names)


def _open_xml(spark: SparkSession, path: str, record_path: str | None) -> DataFrame:
    records = _xml_records(spark, path, record_path)
    broken = records.filter(F.col("error").isNotNull()).select("document", "error").first()
    if broken is not None:
        raise DataError("INVALID_XML", "A document cannot be read.", path=broken.document, detail=broken.error)
    return _xml_table(records).drop("document", "record")


def _open_cube(spark: SparkSession, path: str) -> Opened:
    files = cube_files.read_cube_files(spark, path, "*")
    rows = cube_files.statements(files)
    problem = cube_files.metadata_problems(rows).first()
    if problem is not None:
        raise DataError(problem.code, "The cube file cannot be decoded.", cube=problem.cube, detail=problem.detail)
    dimensions = cube_files.dimensions(rows)
    bound = cube.check_dimensions(dimensions).first()
    if bound is not None:
        raise DataError("PCAXIS_LIMIT", f"The cube has {bound.problem}.", cube=bound.cube, actual=bound.actual)
    # One row per set of dimensions; a second one is enough to refuse the path.
    listed = dimensions.groupBy("cube", "dimension", "name").agg(F.max(F.col("code").isNotNull()).alias("coded"))
    shapes = listed.groupBy("cube").agg(F.array_sort(F.collect_list(F.struct("dimension", "name", "coded"))).alias("d"))
    kinds = shapes.groupBy("d").agg(F.min("cube").alias("cube")).orderBy("cube").limit(2).collect()
    if len(kinds) > 1:
        raise DataError(
            "MIXED_CUBES", "The cubes of the path have different dimensions.", cubes=[k.cube for k in kinds]
        )
    bindings = cube.column_bindings([(d.name, d.coded) for d in kinds[0].d])
    chunks = cube_files.cell_chunks(files)
    unreadable = chunks.filter(F.col("error").isNotNull()).select("cube", "error").first()
    if unreadable is not None:
        raise DataError(unreadable.error, "The cells of the cube cannot be read.", cube=unreadable.cube)
    chunks = chunks.drop("error")
    cube.require_complete(chunks, dimensions)
    bad = cube.invalid_tokens(chunks).first()
    if bad is not None:
        raise DataError("INVALID_PCAXIS_DATA", "A cell is no number and no symbol.", cube=bad.cube, cell=bad.token)
    table = cube.to_columns(cube.decode(chunks, dimensions), bindings).drop("index")
    return Opened(table, "pcaxis", [b.code for b in bindings if b.code is not None])


def _parse_errors(bad: DataFrame) -> DataFrame:
    """One PARSE_ERROR for all (row, detail) that cannot be read: the first row, and a count."""
    first = bad.agg(
        F.min("row").alias("row"), F.min_by("detail", F.coalesce("row", F.lit(0))).alias("detail"), F.count(F.lit(1)).alias("n")
    ).filter("n > 0")
    return first.select(
        *quality.issue(
            "PARSE_ERROR",
            row=F.col("row"),
            occurrences=F.col("n"),
            context=F.create_map(F.lit("detail"), F.coalesce("detail", F.lit(""))),
        )
    )


def _validate_texts(spark: SparkSession, numbered: DataFrame, schema: StructType | None) -> DataFrame:
    """Issues of numbered JSON texts (row, value): those that cannot be parsed, and the others' rows."""
    bad = numbered.filter(~inventory.one_json_value(F.col("value")))
    errors = _parse_errors(bad.select("row", F.substring("value", 1, 80).alias("detail")))
    if schema is None:
        return errors
    parsed = numbered.filter(inventory.one_json_value(F.col("value"))).select(
        F.col("row").alias("_row"), F.inline(F.array(F.from_json(json_docs.as_record(F.col("value")), schema)))
    )
    return errors.unionByName(quality.validate(parsed, position="_row"))


def validate_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Issues of newline-delimited JSON, rows numbered in the order of the files."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    numbered = positions.number_text_rows(lines).select("row", "value")
    read = spark.read.option("columnNameOfCorruptRecord", "_broken").json(path).drop("_broken")
    return _validate_texts(spark, numbered, read.schema if read.columns else None)


def validate_json_document(spark: SparkSession, path: str) -> DataFrame:
    """Issues of JSON documents, items numbered within each file in its order."""
    found = json_items.read_items(spark, path)
    invalid = found.items.filter(~inventory.one_json_value(F.col("value"))).select("file")
    wrong = kept(invalid.unionByName(found.faults.select("file")).distinct(), "json-faults")
    heads = found.files.join(wrong, "file", "left_semi")
    broken = heads.select(F.lit(None).cast("bigint").alias("row"), F.substring("head", 1, 80).alias("detail"))
    items = found.items.join(wrong, "file", "left_anti")
    numbered = positions.number_file_rows(
        items, [F.col("path")], F.col("number"), pieces=positions.pieces_bound(spark.read.text(path), splits=False)
    ).select("row", "value")
    schema = json_docs.inferred_schema(items.select(json_docs.as_record(F.col("value")).alias("value")))
    rows = _validate_texts(spark, numbered, schema if len(schema) else None)
    return _parse_errors(broken).unionByName(rows)


def validate_xml(spark: SparkSession, path: str, record_path: str | None = None) -> DataFrame:
    """Issues of XML records, numbered in the order of the files."""
    records = _xml_records(spark, path, record_path)
    broken = records.filter(F.col("error").isNotNull())
    errors = _parse_errors(broken.select(F.lit(None).cast("bigint").alias("row"), F.col("error").alias("detail")))
    read = _xml_table(records)
    numbered = positions.number_file_rows(
        read, [F.col("document")], F.col("record"), pieces=positions.MAX_BROADCAST_PIECES + 1, row="_row"
    ).drop("document", "record")
    return errors.unionByName(quality.validate(numbered, position="_row"))


def validate_path(
    spark: SparkSession,
    path: str,
    *,
    order_by: Sequence[Column | str] | None = None,
    record_path: str | None = None,
) -> DataFrame:
    """All issues of a path: of its files, its structure and its rows."""
    found = detect_path(spark, path)
    extra = []
    if found.mismatched:
        name = F.lit(found.format.upper())
        told = quality.issue("DELIMITER_MISMATCH", arguments=[name], occurrences=F.lit(found.mismatched))
        extra.append(spark.range(1).select(*told))
    if found.format in ("csv", "tsv"):
        delimiter = found.delimiter or ("," if found.format == "csv" else "\t")
        issues = delimited.validate_delimited(
            spark, path, delimiter, encoding=(found.encoding or "utf-8").upper()
        )
    elif found.format == "parquet":
        table = spark.read.parquet(path)
        numbered = positions.number_parquet_rows(table.select("*", "_metadata"), row="_row")
        issues = quality.validate(
            numbered.drop("_metadata"), position="_row", columns=table.columns
        )
    elif found.format == "ndjson":
        issues = validate_json_lines(spark, path)
    elif found.format == "json":
        issues = validate_json_document(spark, path)
    elif found.format == "xml":
        issues = validate_xml(spark, path, record_path)
    else:
        opened = open_table(spark, path, format=found.format, record_path=record_path)
        issues = quality.validate(opened.table, order_by)
        if opened.format == "pcaxis":
            files = cube_files.read_cube_files(spark, path, "*")
            dimensions = cube_files.dimensions(cube_files.statements(files))
            cells = cube.decode(cube_files.cell_chunks(files).drop("error"), dimensions)
            extra.append(cube.symbol_issues(cells).drop("cube"))
    for part in extra:
        issues = issues.unionByName(part)
    return issues


def convert_path(
    spark: SparkSession, path: str, output: str, target: str, **options: object
) -> DataFrame:
    """Convert a path to csv, tsv, json, ndjson or parquet, with provenance records."""
    opened = open_table(
        spark,
        path,
        record_path=options.pop("record_path", None),
        text_columns=options.pop("text_columns", ()),
    )
    source = table_digest(file_digests(spark, path)).first().sha256
    return convert(
        opened.table, output, target, source_format=opened.format, source_sha256=source, **options
    )
