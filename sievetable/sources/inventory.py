"""Format and dialect evidence for a corpus of files: one row in, one row out.

Input rows have ``path`` and ``content``, and may have ``media_type`` and
``declared``. The content is a whole file, or its first and last 64 KiB. Evidence is
column expressions over these edges, alike at every size.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetable.sources import ranges

SAMPLE_BYTES = ranges.EDGE_BYTES

# Formats by extension and by media type.
EXTENSIONS = {
    "csv": "csv",
    "tsv": "tsv",
    "json": "json",
    "jsonl": "ndjson",
    "ndjson": "ndjson",
    "xlsx": "xlsx",
    "parquet": "parquet",
    "zip": "zip",
    "xml": "xml",
    "px": "pcaxis",
}
MEDIA_TYPES = {
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
    "application/json": "json",
    "application/x-ndjson": "ndjson",
    "application/ndjson": "ndjson",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.apache.parquet": "parquet",
    "application/parquet": "parquet",
    "application/xml": "xml",
    "text/xml": "xml",
    "text/x-pcaxis": "pcaxis",
}
DECLARED = {
    "csv": "csv",
    "tsv": "tsv",
    "json": "json",
    "jsonl": "ndjson",
    "ndjson": "ndjson",
    "xlsx": "xlsx",
    "parquet": "parquet",
    "xml": "xml",
}
DELIMITERS = (",", "\t", ";", "|")
ZIP_STARTS = ("504B0304", "504B0506", "504B0708")
PARQUET_MARK = "50415231"


def _lookup(key: Column, values: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for name, form in values.items():
        found = F.when(key == name, F.lit(form)).otherwise(found)
    return found


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, bytes, modified_at) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        "path", "content", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at")
    )


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, content) of every non-empty file: its first and last 64 KiB."""
    return ranges.read_edges(ranges.listed(spark, path).filter("length > 0"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)\z", 1))


def signature(content: Column) -> Column:
    """parquet, xlsx or zip from the first and last bytes, else null."""
    head = F.hex(F.substring(content, 1, 4))
    tail = F.hex(F.substring(content, -4, 4))
    sample = F.concat(
        F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1"),
        F.decode(F.substring(content, -SAMPLE_BYTES, SAMPLE_BYTES), "ISO-8859-1"),
    )
    workbook = sample.contains("xl/workbook.xml") & sample.contains("[Content_Types].xml")
    return F.when((head == PARQUET_MARK) & (tail == PARQUET_MARK), "parquet").when(
        head.isin(*ZIP_STARTS), F.when(workbook, "xlsx").otherwise("zip")
    )


def text_encoding(content: Column) -> Column:
    """utf-16le or utf-16be by byte-order mark, else utf-8."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark == "FFFE", "utf-16le").when(mark == "FEFF", "utf-16be").otherwise("utf-8")


def sample_text(content: Column) -> Column:
    """First 64 KiB as text without its byte-order mark; null when not valid."""
    head = F.substring(content, 1, SAMPLE_BYTES)
    wide = F.decode(F.substring(head, 3, SAMPLE_BYTES), "UTF-16LE")
    wide_big = F.decode(F.substring(head, 3, SAMPLE_BYTES), "UTF-16BE")
    # The sample may end inside a character, which has four bytes at most.
    ends = [F.substring(head, 1, SAMPLE_BYTES - missing) for missing in range(4)]
    whole = F.octet_length(content) <= SAMPLE_BYTES
    plain = F.when(whole, F.try_validate_utf8(head.cast("string"))).otherwise(
        F.coalesce(*[F.try_validate_utf8(end.cast("string")) for end in ends])
    )
    encoding = text_encoding(content)
    text = F.when(encoding == "utf-16le", wide).when(encoding == "utf-16be", wide_big).otherwise(plain)
    return F.regexp_replace(text, r"\A\x{FEFF}", "")


def count(delimiter: str, line: Column) -> Column:
    """Occurrences of a delimiter in a line."""
    return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))


def sniff_delimiter(text: Column) -> Column:
    """Delimiter with the same positive count on each of the first ten lines.

    The one with most cells wins; equal ones keep the order comma, tab,
    semicolon, bar.
    """
    lines = F.filter(
        F.transform(F.split(text, r"\r?\n"), lambda line: F.regexp_replace(line, r"\A\s+|\s+\z", "")),
        lambda line: line != "",
    )
    first = F.slice(lines, 1, 10)

    scored = []
    for place, delimiter in enumerate(DELIMITERS):
        counts = F.transform(first, partial(count, delimiter))
        here = counts[0]
        steady = F.array_min(counts) == F.array_max(counts)
        ok = (F.size(first) >= 2) & (here > 0) & steady
        scored.append(
            F.when(
                ok,
                F.struct(here.alias("cells"), F.lit(-place).alias("rank"), F.lit(delimiter).alias("d")),
            )
        )
    return F.array_max(F.array(*scored))["d"]


def one_json_value(text: Column) -> Column:
    """The text is one JSON value, with nothing after it."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(listed.isNotNull() & single, F.lit(False))


def structured_content(text: Column, fallback: Column | None = None, cut: Column | None = None) -> Column:
    """ndjson, json, xml, tsv or csv by the look of the text, else null.

    Of a ``cut`` text the last line is left out when lines are looked at, as it
    may be only a part.
    """
    cut = F.lit(False) if cut is None else cut
    trimmed = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    last = F.length(F.substring_index(text, "\n", -1))
    ended = F.substring(text, F.lit(1), F.length(text) - last)
    complete = F.when(cut & ended.contains("\n"), F.regexp_replace(ended, r"\A\s+|\s+\z", "")).otherwise(trimmed)
    lines = F.filter(F.split(complete, r"\r?\n"), lambda line: line.rlike(r"\S"))
    objects = F.forall(
        lines, lambda line: line.rlike(r"\A\s*[\[{]") & one_json_value(line)
    )
    first = F.slice(lines, 1, 5)

    def steady(delimiter: str) -> Column:
        counts = F.transform(first, partial(count, delimiter))
        return (counts[0] > 0) & (F.array_min(counts) == F.array_max(counts))

    bracket, brace = trimmed.startswith("["), trimmed.startswith("{")
    whole = one_json_value(trimmed)
    several = (F.size(lines) > 1) | (cut & (complete != trimmed))
    fallback = F.lit(None).cast("string") if fallback is None else fallback
    return (
        F.when(trimmed.isNull() | (trimmed == ""), F.lit(None))
        .when(several & objects, "ndjson")
        .when(bracket | (brace & whole), "json")
        .when(brace, fallback)
        .when(trimmed.startswith("<"), "xml")
        .when(steady("\t") & ~steady(","), "tsv")
        .when(steady(","), "csv")
    )


def cube_keywords(content: Column) -> Column:
    """Leading statement keywords of a PC-Axis file, in order."""
    head = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
    before_data = F.regexp_extract(head, r"(?is)\A(.*?)(?:;\s*DATA\s*=|\z)", 1)
    unquoted = F.regexp_replace(before_data, r'"[^"]*+"', '""')
    statements = F.slice(F.split(unquoted, ";"), 1, 64)
    keyword = r"(?s)\A(?:\x{EF}\x{BB}\x{BF})?\s*([A-Za-z][A-Za-z0-9_-]*)(?:\[[^\]\r\n]+\])?(?:\([^)]*\))?\s*="
    found = F.transform(statements, lambda s: F.upper(F.regexp_extract(s, keyword, 1)))
    # Keywords count up to the first statement that is not an assignment.
    bad = F.array_position(found, F.lit("")).cast("int")
    return F.when(bad > 0, F.slice(found, F.lit(1), bad - 1)).otherwise(found)


def is_cube(content: Column) -> Column:
    """PC-Axis by its leading keywords."""
    words = cube_keywords(content)

    def has(*names: str) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))

    dense = has("CODEPAGE", "CHARSET") & has("MATRIX") & has("STUB", "HEADING") & has("VALUES")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    versioned = (first == "AXIS-VERSION") | ((first == "CHARSET") & (second == "AXIS-VERSION"))
    return F.coalesce(dense | versioned, F.lit(False))


def detect(files: DataFrame) -> DataFrame:
    """format, confidence, encoding and delimiter of each file.

    Evidence in order: signature, cube keywords and declarations, media type
    (a sniffed delimiter may correct it), content, declared format, extension.
    """
    for name in ("media_type", "declared"):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast("string"))
    content = F.col("content")
    media = F.lower(F.trim(F.split_part(F.coalesce("media_type", F.lit("")), F.lit(";"), F.lit(1))))
    declared = F.regexp_replace(F.lower(F.trim("declared")), r"\A\.", "")
    evidence = files.select(
        *files.columns,
        extension(F.col("path")).alias("_ext"),
        signature(content).alias("_sig"),
        is_cube(content).alias("_cube"),
        text_encoding(content).alias("_enc"),
        sample_text(content).alias("_text"),
        (F.octet_length(content) > SAMPLE_BYTES).alias("_longer"),
        _lookup(media, MEDIA_TYPES).alias("_media"),
        declared.alias("_declared"),
    )
    by_extension = _lookup(F.col("_ext"), EXTENSIONS)
    fallback = F.when(by_extension.isin("json", "ndjson"), by_extension)
    evidence = evidence.withColumns(
        {
            "_structured": structured_content(F.col("_text"), fallback, F.col("_longer")),
            "_by_extension": by_extension,
        }
    )
    is_json = F.col("_structured").isin("json", "ndjson")
    evidence = evidence.withColumn(
        "_delimiter",
        F.when(~F.coalesce(is_json, F.lit(False)), sniff_delimiter(F.col("_text"))),
    )
    dialect = F.when(F.col("_delimiter") == "\t", "tsv").when(F.col("_delimiter").isNotNull(), "csv")
    by_content = F.coalesce(F.when(is_json, F.col("_structured")), dialect, F.col("_structured"))
    by_declared = _lookup(F.col("_declared"), DECLARED)
    corrected = F.col("_media").isin("csv", "tsv") & (dialect != F.col("_media"))

    def result(form: Column | str, confidence: str) -> Column:
        form = F.lit(form) if isinstance(form, str) else form
        return F.struct(form.alias("format"), F.lit(confidence).alias("confidence"))

    found = (
        F.when(F.col("_sig").isNotNull(), result(F.col("_sig"), "signature"))
        .when(F.col("_media") == "pcaxis", result("pcaxis", "media-type"))
        .when(F.col("_declared").isin("pcaxis", "pc-axis", "px"), result("pcaxis", "declared-format"))
        .when(F.col("_ext") == "px", result("pcaxis", "extension"))
        .when(F.col("_cube"), result("pcaxis", "content"))
        .when(corrected, result(dialect, "content"))
        .when(F.col("_media").isNotNull(), result(F.col("_media"), "media-type"))
        .when(by_content.isNotNull(), result(by_content, "content"))
        .when(by_declared.isNotNull(), result(by_declared, "declared-format"))
        .when(F.col("_by_extension").isNotNull(), result(F.col("_by_extension"), "extension"))
        .otherwise(result("unknown", "unknown"))
    )
    by_text = F.col("found.format").isin("csv", "tsv", "json", "ndjson", "xml") & F.col(
        "found.confidence"
    ).isin("media-type", "content")
    extra = [c for c in files.columns if c not in ("content", "media_type", "declared")]
    header = F.regexp_extract("_text", r"\A([^\r\n]*)", 1)
    return evidence.withColumn("found", found).select(
        *extra,
        F.col("_ext").alias("extension"),
        "found.format",
        "found.confidence",
        F.when(by_text, F.col("_enc")).alias("encoding"),
        F.when(by_text, F.col("_delimiter")).alias("delimiter"),
        F.when(F.col("found.format").isin("csv", "tsv"), header).alias("header"),
    )


def file_issues(files: DataFrame) -> DataFrame:
    """INVALID_ENCODING and DELIMITER_MISMATCH per file, over whole files."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    found = detect(files.withColumn("valid_utf8", valid))
    text = F.col("format").isin("csv", "tsv", "json", "ndjson")
    encoding = F.coalesce(text & (F.col("encoding") == "utf-8") & ~F.col("valid_utf8"), F.lit(False))
    mismatch = ((F.col("extension") == "csv") & (F.col("format") == "tsv")) | (
        (F.col("extension") == "tsv") & (F.col("format") == "csv")
    )
    codes = F.array_compact(
        F.array(
            F.when(encoding, F.lit("INVALID_ENCODING")),
            F.when(mismatch & ~encoding, F.lit("DELIMITER_MISMATCH")),
        )
    )
    return found.select("path", "format", F.explode(codes).alias("code"))


def access(found: DataFrame) -> DataFrame:
    """Operations each detected file supports, and why not."""
    direct = ~F.col("format").isin("zip", "unknown")
    operations = F.when(
        direct, F.lit(["inspect", "preview", "schema", "validate", "query", "convert"])
    ).otherwise(F.lit(["inspect"]))
    limitation = F.when(
        F.col("format") == "zip",
        "Only one non-nested supported ZIP entry is extracted per operation.",
    )
    return found.withColumns({"operations": operations, "limitation": limitation})
