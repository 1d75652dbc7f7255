"""Items of JSON arrays, read in splits.

A comma stands between any two items, so text is read up to commas and even an array on
one line has many splits. Whether a comma ends an item depends on all text before it: on
being inside a string, and on how many brackets are open. So a split is first scanned
under both string states. These small rows are composed in the order of each file, which
tells state and depth at every split's start. Then the splits are cut at depth one, and
the pieces of items over borders are stitched together.

A file that doesn't start with a bracket is one item. An array that isn't closed, text
behind it, an item without text and a line break inside a string make a file faulty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievetable.plans.staged import kept
from sievetable.sources.positions import MAX_BROADCAST_PIECES, pieces_bound
from sievetable.sources.records import by_split

BACKSLASH, COMMA, OPEN, CLOSE, QUOTE = b"\\,[]\""
MARKS = np.zeros(256, bool)
MARKS[list(b'"[]{},\r\n')] = True
BREAKS = np.zeros(256, bool)
BREAKS[list(b"\r\n")] = True
STEP = np.zeros(256, np.int64)
STEP[list(b"[{")] = 1
STEP[list(b"]}")] = -1
CUTS = {OPEN: "open", COMMA: "comma", CLOSE: "close"}
BLANK = b" \t\r\n\xef\xbb\xbf"
HEAD_BYTES = 400


class Items(NamedTuple):
    """Items of all files, files that are no JSON by their structure, and whether text is wide.

    ``items``: file, path, number (from 0 in each file), value, and the folders' columns.
    ``faults``: file, path, head. ``files``: file, path, head, and the folders' columns.
    Files are ``wide`` if one of them is not UTF-8 but has two or four bytes a character.
    """

    items: DataFrame
    faults: DataFrame
    files: DataFrame
    wide: bool


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and bytes of quotes, brackets, commas and line breaks that are not escaped."""
    text = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(MARKS[text])
    slashes = np.flatnonzero(text == BACKSLASH)
    if len(slashes):
        place = np.arange(len(slashes))
        first = np.concatenate(([True], np.diff(slashes) != 1))
        in_run = place - np.maximum.accumulate(np.where(first, place, 0))
        at = at[~np.isin(at, slashes[in_run % 2 == 0] + 1)]
    return at, text[at]


def outside(kinds: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each mark stands outside strings; of quotes, whether it opens one."""
    quotes = kinds == QUOTE
    return (np.cumsum(quotes) - quotes + inside) % 2 == 0


def stretches(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): text between commas, in order within a split's task."""
    text = spark.read.option("lineSep", ",").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"),
    )


def joined(values: pd.Series, at_start: bool) -> bytes:
    """The text of stretches, with the comma before them."""
    return (b"" if at_start else b",") + b",".join(values)


def split_facts(text: DataFrame) -> DataFrame:
    """(file, split, head, odd, step_0, step_1, breaks_0, breaks_1) of each split.

    The number names the state at the split's start, outside or inside a string: steps in
    depth, and line breaks inside strings. ``odd`` tells whether the split turns the state.
    """
    columns = ["file", "split", "head", "odd", "step_0", "step_1", "breaks_0", "breaks_1"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head, odd, steps, breaks = None, b"", 0, [0, 0], [0, 0]

        def row() -> tuple:
            return (*now, head.decode("utf-8", "replace") if now[1] == 0 else None, odd, *steps, *breaks)

        for frame in frames:
            rows = []
            for key, part in by_split(frame):
                fresh = key != now
                if fresh:
                    if now is not None:
                        rows.append(row())
                    now, head, odd, steps, breaks = key, b"", 0, [0, 0], [0, 0]
                data = joined(part["value"], fresh and key[1] == 0)
                if not head and key[1] == 0:
                    head = data.lstrip(BLANK)[:HEAD_BYTES]
                _, kinds = marks(data)
                first = outside(kinds, bool(odd))
                for state, free in ((0, first), (1, ~first)):
                    steps[state] += int(STEP[kinds[free]].sum())
                    breaks[state] += int(BREAKS[kinds[~free]].sum())
                odd = (odd + int((kinds == QUOTE).sum())) % 2
            yield pd.DataFrame(rows, columns=columns)
        if now is not None:
            yield pd.DataFrame([row()], columns=columns)

    return text.mapInPandas(
        run,
        "file bigint, split bigint, head string, odd int, "
        "step_0 bigint, step_1 bigint, breaks_0 bigint, breaks_1 bigint",
    )


def split_states(facts: DataFrame) -> DataFrame:
    """(file, split, head, array, inside, depth, odd, step, breaks): what holds at each split's start.

    A window holds one narrow row for each split of a file.
    """
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = facts.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    chosen = inside.select(
        "file",
        "split",
        "head",
        "odd",
        "inside",
        *(F.when(F.col("inside"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")).alias(c) for c in ("step", "breaks")),
    )
    array = F.max(F.col("head").startswith("[")).over(Window.partitionBy("file"))
    return chosen.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0))).withColumn("array", array)


def split_pieces(text: DataFrame) -> DataFrame:
    """(file, split, number, value, after, until, edge) from text with ``array``, ``inside`` and ``depth``.

    ``number`` counts the cuts before the piece within the split; ``after`` and ``until``
    name the cuts on its sides. ``edge`` marks pieces that may go on in another split.
    """
    columns = ["file", "split", "number", "value", "after", "until", "edge"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, array, inside, depth, number, held, after = None, False, False, 0, 0, [], None

        def row(until: str | None) -> tuple:
            return (*now, number, b"".join(held), after, until, number == 0 or until is None)

        for frame in frames:
            rows = []
            for key, part in by_split(frame):
                fresh = key != now
                if fresh:
                    if now is not None:
                        rows.append(row(None))
                    now, number, held = key, 0, []
                    array, inside = bool(part["array"].iloc[0]), bool(part["inside"].iloc[0])
                    depth, after = int(part["depth"].iloc[0]), "start" if key[1] == 0 else None
                data = joined(part["value"], fresh and key[1] == 0)
                start = 0
                if array:
                    at, kinds = marks(data)
                    free = outside(kinds, inside)
                    depths = depth + np.cumsum(STEP[kinds] * free)
                    first = ((kinds == COMMA) | (kinds == OPEN)) & (depths == 1)
                    for place in np.flatnonzero(free & (first | ((kinds == CLOSE) & (depths == 0)))).tolist():
                        cut = CUTS[int(kinds[place])]
                        held.append(data[start : at[place]])
                        rows.append(row(cut))
                        start, number, held, after = int(at[place]) + 1, number + 1, [], cut
                    if len(kinds):
                        depth = int(depths[-1])
                        inside = (inside + int((kinds == QUOTE).sum())) % 2 == 1
                held.append(data[start:])
            yield pd.DataFrame(rows, columns=columns)
        if now is not None:
            yield pd.DataFrame([row(None)], columns=columns)

    return text.select("file", "split", "array", "inside", "depth", "value").mapInPandas(
        run, "file bigint, split bigint, number bigint, value binary, after string, until string, edge boolean"
    )


def stitched(pieces: DataFrame, *, broadcast: bool) -> DataFrame:
    """(file, number, value, after, until): whole pieces, ``number`` counted through each file."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    cuts = pieces.groupBy("file", "split").agg(F.max("number").alias("cuts"))
    offsets = cuts.select("file", "split", F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("offset"))
    numbered = pieces.join(F.broadcast(offsets) if broadcast else offsets, ["file", "split"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("offset"))
    columns = ["file", "number", F.col("value").cast("string").alias("value"), "after", "until"]
    parts = F.array_sort(F.collect_list(F.struct("split", F.col("value").cast("string").alias("value"))))
    edges = numbered.filter("edge").groupBy("file", "number").agg(
        F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("value"),
        F.max("after").alias("after"),
        F.max("until").alias("until"),
    )
    return numbered.filter(~F.col("edge")).select(*columns).unionByName(edges)


def read_items(spark: SparkSession, path: str) -> Items:
    """The items of all files of a path, one row for each."""
    text = stretches(spark, path)
    states = kept(split_states(split_facts(text)), "json-splits")
    bound = pieces_bound(spark.read.text(path), splits=True)
    narrow = states.select("file", "split", "array", "inside", "depth")
    if bound <= MAX_BROADCAST_PIECES:
        stated = text.join(F.broadcast(narrow), ["file", "split"])
    else:  # the join shuffles, so the order of the text is restored
        placed = text.withColumn("place", F.monotonically_increasing_id()).join(narrow, ["file", "split"])
        stated = placed.repartition("file", "split").sortWithinPartitions("file", "split", "place")
    pieces = kept(split_pieces(stated), "json-pieces")
    listing = spark.read.format("binaryFile").load(path)
    folders = [c for c in listing.columns if c not in ("path", "modificationTime", "length", "content")]
    name = F.col("_metadata.file_path")
    listing = listing.select(F.xxhash64(name).alias("file"), name.alias("path"), *folders)
    ends = states.groupBy("file").agg(
        F.max("head").alias("head"),
        F.bool_or("array").alias("array"),
        ((F.sum("odd") % 2 == 1) | (F.sum("step") != 0) | (F.sum("breaks") > 0)).alias("broken"),
    )
    files = kept(listing.join(ends, "file"), "json-files")
    found = stitched(pieces, broadcast=bound <= MAX_BROADCAST_PIECES)
    few = len(text.inputFiles()) <= MAX_BROADCAST_PIECES
    named = found.join(F.broadcast(files) if few else files, "file")
    value = F.btrim("value", F.lit(" \t\r\n\ufeff"))
    named = named.withColumn("value", value).withColumn("empty", F.col("value") == "")
    item = (~F.col("array") | F.col("after").isin("open", "comma")) & ~F.col("empty")
    lacking = F.col("empty") & ((F.col("after") == "comma") | ((F.col("after") == "open") & (F.col("until") != "close")))
    behind = (F.col("after") == "close") & (~F.col("empty") | F.col("until").isNotNull())
    wrong = named.filter(F.col("array") & (lacking | behind)).select("file", "path", "head")
    faults = files.filter("array AND broken").select("file", "path", "head").unionByName(wrong).distinct()
    number = F.when(F.col("array"), F.col("number") - 1).otherwise(0).alias("number")
    wide = not files.filter(F.contains("head", F.lit("\0"))).isEmpty()
    items = named.filter(item).select("file", "path", number, "value", *folders)
    return Items(items, faults, files.select("file", "path", "head", *folders), wide)
