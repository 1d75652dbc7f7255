"""PC-Axis files: statements and cell chunks of many files, as rows.

A file is split at its quotes and semicolons inside a task - the only step that
depends on reading characters in order - and leaves as rows: one per metadata
value, and one per chunk of cells. Everything after that is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetable.functions.periods import period_ordinal
from sievetable.sources.batches import in_frames

CHUNK_CELLS = 65_536
CODEPAGES = {"windows-1250": "cp1250", "utf-8": "utf-8"}

# Keywords whose value is one text in quoted segments, and notes.
LONG_TEXT_KEYWORDS = {
    "BASEPERIOD",
    "CELLNOTE",
    "CELLNOTEX",
    "CONTACT",
    "DATABASE",
    "DESCRIPTION",
    "INFO",
    "INFOFILE",
    "NOTE",
    "NOTEX",
    "REFPERIOD",
    "SOURCE",
    "TITLE",
    "VALUENOTE",
    "VALUENOTEX",
}
NOTE_KEYWORDS = (
    "CELLNOTE",
    "CELLNOTEX",
    "DATANOTE",
    "DATANOTECELL",
    "DATANOTESUM",
    "NOTE",
    "NOTEX",
    "VALUENOTE",
    "VALUENOTEX",
)

STATEMENT_SCHEMA = (
    "cube string, place int, keyword string, language string, subkeys array<string>,"
    " position int, value string, error string"
)
CHUNK_SCHEMA = "cube string, base bigint, cells array<string>, error string"

_STATEMENT = re.compile(r'[^";]*(?:"[^"]*"[^";]*)*(?:;|\Z)')
_LEFT = re.compile(r'\s*([A-Za-z][\w-]*)(?:\[\s*"?([\w-]+)"?\s*\])?(?:\((.*)\))?\s*\Z', re.S)
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_WRAP = re.compile(r"[ \t]*(?:\r\n|\r|\n)[ \t]*")
_CELL = re.compile(r'"(?:[^"]|"")*"|[^\s,;"]+')


class CubeFileError(ValueError):
    """A file that is not a readable dense cube; the code says why."""


def _quoted_list(text: str) -> list[str]:
    """Items of a quoted list; a single unquoted item is allowed."""
    if '"' not in text:
        return [text.strip()] if text.strip() else []
    rest = _QUOTED.sub("", text)
    if rest.replace(",", "").strip():
        raise CubeFileError("INVALID_PCAXIS_DATA")
    items = _QUOTED.findall(text)
    if len(items) != rest.count(",") + 1:
        raise CubeFileError("INVALID_PCAXIS_DATA")
    return [_WRAP.sub(" ", item.replace('""', '"')) for item in items]


def _head_and_data(content: bytes) -> tuple[str, bytes]:
    """Decoded metadata text, and the bytes after ``DATA=``."""
    latin = content.decode("latin-1")
    for found in _STATEMENT.finditer(latin):
        left = found.group().split("=", 1)[0].strip().upper()
        if left == "KEYS" or left.startswith(("KEYS(", "KEYS[")):
            raise CubeFileError("PCAXIS_KEYS_UNSUPPORTED")
        if left == "DATA":
            head = latin[: found.start()]
            data_at = found.start() + found.group().index("=") + 1
            break
    else:
        raise CubeFileError("INVALID_PCAXIS_DATA")
    page = re.search(r'\bCODEPAGE\s*=\s*"([^"]*)"\s*;', head, re.I)
    encoding = CODEPAGES.get(page.group(1).strip().lower()) if page else None
    if encoding is None:
        raise CubeFileError("PCAXIS_ENCODING_UNSUPPORTED")
    text = head.encode("latin-1").decode(encoding)
    return text.lstrip("﻿"), content[data_at:]


def _statements(content: bytes) -> Iterator[tuple]:
    """(place, keyword, language, subkeys, position, value) of the metadata."""
    text, _ = _head_and_data(content)
    for place, found in enumerate(_STATEMENT.finditer(text)):
        statement = found.group().removesuffix(";")
        if not statement.strip():
            continue
        equals = re.match(r'[^="]*(?:"[^"]*"[^="]*)*=', statement)
        left = _LEFT.match(equals.group()[:-1]) if equals else None
        if left is None:
            raise CubeFileError("INVALID_PCAXIS_DATA")
        keyword = left.group(1).upper()
        subkeys = _quoted_list(left.group(3)) if left.group(3) else []
        right = statement[equals.end() :]
        if keyword == "TIMEVAL":
            listed = re.match(r"\s*(TLIST\([^)]*\))\s*,?(.*)\Z", right, re.S | re.I)
            if listed is None:
                raise CubeFileError("INVALID_PCAXIS_DATA")
            periods = _quoted_list(listed.group(2)) if listed.group(2).strip() else []
            values = [listed.group(1), *periods]
        elif keyword in LONG_TEXT_KEYWORDS and '"' in right:
            if _QUOTED.sub("", right).strip():
                raise CubeFileError("INVALID_PCAXIS_DATA")
            values = ["".join(s.replace('""', '"') for s in _QUOTED.findall(right))]
        else:
            values = _quoted_list(right)
        if not values:
            raise CubeFileError("INVALID_PCAXIS_DATA")
        for position, value in enumerate(values):
            yield place, keyword, left.group(2), subkeys, position, value


def _cell_chunks(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(base, tokens) of the cells, a bounded number of cells at a time."""
    _, data = _head_and_data(content)
    if not data.rstrip().endswith(b";"):
        raise CubeFileError("INVALID_PCAXIS_DATA")
    base, tokens = 0, []
    for found in _CELL.finditer(data.decode("latin-1")):
        tokens.append(found.group())
        if len(tokens) == CHUNK_CELLS:
            yield base, tokens
            base, tokens = base + len(tokens), []
    if tokens:
        yield base, tokens


def read_cube_files(spark: SparkSession, path: str, pattern: str = "*.px") -> DataFrame:
    """(cube, content) for the files below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select(F.col("path").alias("cube"), "content")


def statements(files: DataFrame) -> DataFrame:
    """One row per metadata value; an unreadable file is one row with ``error``."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for cube, content in zip(batch["cube"], batch["content"], strict=True):
            try:
                yield from [(cube, *entry, None) for entry in _statements(content)]
            except (CubeFileError, UnicodeDecodeError) as error:
                code = str(error) if isinstance(error, CubeFileError) else "INVALID_PCAXIS_DATA"
                yield cube, 0, None, None, None, 0, None, code

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["cube", "place", "keyword", "language", "subkeys", "position", "value", "error"]
        for batch in batches:
            yield from in_frames(rows(batch), names)

    return files.select("cube", "content").mapInPandas(split, STATEMENT_SCHEMA)


def cell_chunks(files: DataFrame) -> DataFrame:
    """Cell chunks of each file, for the cube decoder."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for cube, content in zip(batch["cube"], batch["content"], strict=True):
            try:
                for base, cells in _cell_chunks(content):
                    yield cube, base, cells, None
            except CubeFileError as error:
                yield cube, 0, None, str(error)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from in_frames(rows(batch), ["cube", "base", "cells", "error"], most=64)

    return files.select("cube", "content").mapInPandas(split, CHUNK_SCHEMA)


def _default(rows: DataFrame, *keywords: str) -> DataFrame:
    return rows.filter(F.col("keyword").isin(*keywords) & F.col("language").isNull())


def dimensions(rows: DataFrame) -> DataFrame:
    """Dimension values in the decoder's form: stub dimensions, then heading.

    Values and codes align by position.
    """
    heading = (F.col("keyword") == "HEADING").cast("int")
    named = _default(rows, "STUB", "HEADING").select(
        "cube", heading.alias("role"), F.col("position").alias("at"), F.col("value").alias("name")
    )
    listed = named.groupBy("cube").agg(
        F.array_sort(F.collect_list(F.struct("role", "at", "name"))).alias("d")
    )
    order = listed.select("cube", F.posexplode("d").alias("place", "e")).select(
        "cube", (F.col("place") + 1).alias("dimension"), F.col("e.name").alias("name")
    )
    by_name = _default(rows, "VALUES", "CODES").filter(F.size("subkeys") == 1)
    aligned = by_name.groupBy("cube", F.col("subkeys")[0].alias("name"), "position").agg(
        F.max(F.when(F.col("keyword") == "VALUES", F.col("value"))).alias("label"),
        F.max(F.when(F.col("keyword") == "CODES", F.col("value"))).alias("code"),
    )
    return order.join(aligned, ["cube", "name"]).select(
        "cube", "dimension", "name", "position", "label", "code"
    )


def metadata_problems(rows: DataFrame) -> DataFrame:
    """Why a file cannot be decoded: unreadable, or its lists do not fit.

    Lists of codes, periods and translations must be as long as the default
    list of values (of dimensions, for a translated role).
    """
    unreadable = rows.filter(F.col("error").isNotNull()).select(
        "cube", F.col("error").alias("code"), F.lit(None).cast("string").alias("detail")
    )
    readable = rows.filter(F.col("error").isNull())
    present = readable.groupBy("cube").agg(
        F.max(F.col("keyword") == "MATRIX").alias("matrix"),
        F.max(F.col("keyword").isin("STUB", "HEADING")).alias("axis"),
        F.max(
            F.when(
                (F.col("keyword") == "DECIMALS")
                & ~F.coalesce(F.col("value").try_cast("int").between(0, 15), F.lit(False)),
                True,
            )
        ).alias("decimals"),
    )
    lacking = present.filter(~F.col("matrix") | ~F.col("axis") | F.col("decimals").isNotNull())
    lacking = lacking.select(
        "cube", F.lit("INVALID_PCAXIS_DATA").alias("code"), F.lit("mandatory").alias("detail")
    )
    lists = readable.filter(
        F.col("keyword").isin("VALUES", "CODES", "STUB", "HEADING", "TIMEVAL")
    )
    sizes = lists.groupBy("cube", "keyword", "language", "subkeys").agg(
        F.count(F.lit(1)).alias("size"),
        F.min_by("value", "position").alias("directive"),
    )
    default = sizes.filter(F.col("language").isNull())
    base = default.filter(F.col("keyword").isin("VALUES", "STUB", "HEADING")).select(
        "cube", "keyword", "subkeys", F.col("size").alias("expected")
    )
    period = time_periods(sizes.filter(F.col("keyword") == "TIMEVAL"))
    own = default.filter(F.col("keyword") == "CODES").select("cube", "subkeys", "size", "keyword")
    own = own.unionByName(period.select("cube", "subkeys", F.col("periods").alias("size"), "keyword"))
    values = base.filter(F.col("keyword") == "VALUES").drop("keyword")
    wrong = own.join(values, ["cube", "subkeys"], "left").filter(
        ~F.coalesce(F.col("size") == F.col("expected"), F.lit(False))
    )
    roles = sizes.filter(F.col("language").isNotNull() & F.col("keyword").isin("STUB", "HEADING"))
    role_base = base.filter(F.col("keyword") != "VALUES").drop("subkeys")
    translated = roles.join(role_base, ["cube", "keyword"], "left").filter(
        ~F.coalesce(F.col("size") == F.col("expected"), F.lit(False))
    )
    translations = lists.filter(F.col("language").isNotNull() & (F.col("keyword") == "VALUES"))
    own_lists = translations.groupBy("cube", "language", "subkeys").agg(F.count(F.lit(1)).alias("size"))
    # A translated list is as long as the default one of the dimension at the same place.
    place = readable.filter(F.col("keyword").isin("STUB", "HEADING")).select(
        "cube", "language", "keyword", "position", F.array("value").alias("subkeys")
    )
    default_place = place.filter(F.col("language").isNull()).drop("language").withColumnRenamed("subkeys", "default")
    at = own_lists.join(place, ["cube", "language", "subkeys"]).join(default_place, ["cube", "keyword", "position"])
    unequal = at.join(
        values.select("cube", F.col("subkeys").alias("default"), "expected"), ["cube", "default"], "left"
    ).filter(~F.coalesce(F.col("size") == F.col("expected"), F.lit(False)))
    # Every dimension of the default language has a list of values, or its periods.
    axes = default_place.select("cube", F.col("default").alias("subkeys"))
    listed = default.filter(F.col("keyword") == "VALUES").select("cube", "subkeys")
    valueless = axes.join(listed, ["cube", "subkeys"], "left_anti")
    names = readable.filter(F.col("keyword").isin("STUB", "HEADING"))
    repeated = names.groupBy("cube", "language", "value").count().filter("count > 1")
    code = F.lit("INVALID_PCAXIS_DATA").alias("code")
    parts = [
        unreadable,
        lacking,
        wrong.select("cube", code, F.col("keyword").alias("detail")),
        translated.select("cube", code, F.concat("keyword", F.lit(" translation")).alias("detail")),
        repeated.select("cube", code, F.lit("repeated dimension").alias("detail")),
        unequal.select("cube", code, F.lit("VALUES translation").alias("detail")),
        valueless.select("cube", code, F.lit("dimension without VALUES").alias("detail")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def time_periods(timevals: DataFrame) -> DataFrame:
    """Number of periods of each TIMEVAL: listed, or the length of its range.

    Needs ``directive`` (the TLIST text) and ``size`` (values with the directive).
    """
    pattern = r'(?i)\ATLIST\(\s*([AHQMWD])1\s*(?:,\s*"([^"]*)"\s*-\s*"([^"]*)"\s*)?\)\z'
    scale = F.upper(F.regexp_extract("directive", pattern, 1))
    first = F.regexp_extract("directive", pattern, 2)
    last = F.regexp_extract("directive", pattern, 3)

    def length(s: str) -> Column:
        return period_ordinal(last, s) - period_ordinal(first, s) + 1

    ranged = F.coalesce(*[F.when(scale == s, length(s)) for s in "AHQMWD"])
    listed = F.when(first == "", F.col("size") - 1)
    counted = F.coalesce(listed, F.when(ranged > 0, ranged))
    return timevals.withColumns({"scale": scale, "periods": counted})


def scalars(rows: DataFrame) -> DataFrame:
    """One row per file: matrix, title, contents, unit, source, database, decimals."""
    names = {
        "MATRIX": "matrix",
        "TITLE": "title",
        "CONTENTS": "contents",
        "UNITS": "unit",
        "SOURCE": "source",
        "DATABASE": "database",
        "DECIMALS": "decimals",
        "CODEPAGE": "codepage",
    }
    plain = _default(rows, *names).filter(F.size("subkeys") == 0)
    picked = [
        F.max(F.when(F.col("keyword") == key, F.col("value"))).alias(name)
        for key, name in names.items()
    ]
    return plain.groupBy("cube").agg(*picked)


def symbol_names(rows: DataFrame) -> DataFrame:
    """Declared names of the missing-value symbols of each file."""
    symbols = {"DATASYMBOLNIL": "-", **{f"DATASYMBOL{i}": "." * i for i in range(1, 7)}}
    token = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair])
    return _default(rows, *symbols).select(
        "cube", token[F.col("keyword")].alias("symbol"), F.col("value").alias("name")
    )


def notes(rows: DataFrame) -> DataFrame:
    """Notes in any language, with what they are about."""
    return rows.filter(F.col("keyword").isin(*NOTE_KEYWORDS)).select(
        "cube", "place", "keyword", "language", "subkeys", "value"
    )
