"""Records of delimited files with quoted line breaks, read in splits.

Whether a line starts inside a quoted cell depends on all lines before it. So a split
is first scanned under both states: what state it leaves, and how many records start in
it. These small rows are composed in the order of each file, which tells the state at
every split's start. Then the splits are cut into records; the last record of a split
and the lines that go on with it in later splits are stitched together.

Lines end with a line feed; a carriage return before one belongs to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievetable.plans.staged import kept
from sievetable.sources.positions import MAX_BROADCAST_PIECES, pieces_bound

QUOTE, BREAK, RETURN = b'"', b"\n", b"\r"


def open_after(line: bytes, delimiter: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at a line's end, from the state at its start.

    A cell is quoted if a quote is its first character. Behind the quote that closes it,
    and in other cells, everything up to the delimiter belongs to the cell.
    """
    at = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            while at >= 0 and line[at + 1 : at + 2] == QUOTE:
                at = line.find(QUOTE, at + 2)
            if at < 0:
                return True
        elif line[at : at + 1] == QUOTE:
            inside = True
            at += 1
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        inside = False
        at += 1


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, split, value): lines as bytes, in order within a split's task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    name = F.col("_metadata.file_path")
    return lines.select(
        name.alias("path"),
        F.xxhash64(name).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"),
    )


def by_split(frame: pd.DataFrame) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """Stretches of rows of one (file, split)."""
    changes = (frame[["file", "split"]] != frame[["file", "split"]].shift()).any(axis=1)
    starts = [*changes.to_numpy().nonzero()[0].tolist(), len(frame)]
    for start, end in zip(starts, starts[1:]):
        part = frame.iloc[start:end]
        yield (int(part["file"].iloc[0]), int(part["split"].iloc[0])), part


def split_facts(lines: DataFrame, delimiter: str) -> DataFrame:
    """(path, file, split, out_0, out_1, starts_0, starts_1) of each split.

    The number names the state at the split's start: outside or inside a quoted cell.
    Empty lines outside are no records. Only lines with a quote go to Python as they are.
    """
    d = delimiter.encode()
    has_quote = F.instr(F.col("value").cast("string"), '"') > 0
    empty = F.col("value").isin(bytearray(b""), bytearray(RETURN))
    narrow = lines.select(
        F.when(F.col("split") == 0, F.col("path")).alias("path"),
        "file",
        "split",
        empty.alias("empty"),
        F.when(has_quote, F.col("value")).alias("value"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, path, state, starts = None, None, [False, True], [0, 0]

        def row() -> tuple:
            return (path, *now, int(state[0]), int(state[1]), *starts)

        for frame in frames:
            rows = []
            for key, part in by_split(frame):
                if key != now:
                    if now is not None:
                        rows.append(row())
                    now, path, state, starts = key, part["path"].iloc[0], [False, True], [0, 0]
                for empty, value in zip(part["empty"], part["value"]):
                    for s in (0, 1):
                        if not state[s] and not empty:
                            starts[s] += 1
                        if value is not None:
                            state[s] = open_after(value, d, state[s])
            yield pd.DataFrame(rows, columns=_FACTS)
        if now is not None:
            yield pd.DataFrame([row()], columns=_FACTS)

    return narrow.mapInPandas(
        run, "path string, file bigint, split bigint, out_0 int, out_1 int, starts_0 bigint, starts_1 bigint"
    )


_FACTS = ["path", "file", "split", "out_0", "out_1", "starts_0", "starts_1"]


def split_states(facts: DataFrame) -> DataFrame:
    """(file, split, inside, before): the state and the number of records before each split.

    A split either sets the state, keeps it or turns it over. So the state is that of the
    last split that set it, turned over as often as splits since then do. A window holds
    one narrow row for each split of a file.
    """
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("out_0") == F.col("out_1")
    turns = F.when(sets | (F.col("out_0") == 0), 0).otherwise(1)
    turned = facts.withColumn("turned", F.sum(turns).over(order))
    mark = F.when(sets, F.struct(F.col("out_0").alias("state"), "turned"))
    marked = turned.withColumn("mark", F.last(mark, ignorenulls=True).over(before)).withColumn(
        "turned_before", F.coalesce(F.sum(turns).over(before), F.lit(0))
    )
    since = F.col("turned_before") - F.coalesce(F.col("mark.turned"), F.lit(0))
    stated = marked.withColumn("inside", (F.coalesce(F.col("mark.state"), F.lit(0)) + since) % 2 == 1)
    here = F.when(F.col("inside"), F.col("starts_1")).otherwise(F.col("starts_0"))
    return stated.withColumn("before", F.coalesce(F.sum(here).over(before), F.lit(0))).select(
        "file", "split", "inside", "before"
    )


def split_records(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, split, number, value, edge) from lines with ``inside`` and ``before``.

    ``number`` counts the records of a file from 0. ``edge`` marks what may go on in
    another split: the last record, and the lines before the first one.
    """
    d = delimiter.encode()
    columns = ["file", "split", "number", "value", "edge"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, inside, number, held, leading = None, False, 0, [], True

        def row(edge: bool) -> tuple:
            return (*now, number, BREAK.join(held), edge or leading)

        for frame in frames:
            rows = []
            for key, part in by_split(frame):
                if key != now:
                    if held:
                        rows.append(row(True))
                    now, inside, held, leading = key, bool(part["inside"].iloc[0]), [], True
                    number = int(part["before"].iloc[0]) - 1
                for value in part["value"]:
                    if not inside:
                        if value in (b"", RETURN):
                            continue
                        if held:
                            rows.append(row(False))
                        held, leading = [], False
                        number += 1
                    held.append(value)
                    if QUOTE in value:
                        inside = open_after(value, d, inside)
            yield pd.DataFrame(rows, columns=columns)
        if held:
            yield pd.DataFrame([row(True)], columns=columns)

    return lines.select("file", "split", "inside", "before", "value").mapInPandas(
        run, "file bigint, split bigint, number bigint, value binary, edge boolean"
    )


def read_records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(file, number, value): the text of every record; number 0 is a file's header."""
    lines = raw_lines(spark, path)
    facts = kept(split_facts(lines, delimiter), "splits")
    states = split_states(facts)
    if pieces_bound(spark.read.text(path), splits=True) <= MAX_BROADCAST_PIECES:
        stated = lines.join(F.broadcast(states), ["file", "split"])
    else:  # the join shuffles, so the order of the lines is restored
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(states, ["file", "split"])
        stated = placed.repartition("file", "split").sortWithinPartitions("file", "split", "place")
    parts = kept(split_records(stated, delimiter), "records")
    whole = parts.filter(~F.col("edge")).select("file", "number", "value")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("split", "value"))), lambda x: x["value"].cast("string"))
    edges = parts.filter("edge").groupBy("file", "number").agg(F.array_join(pieces, "\n").cast("binary").alias("value"))
    names = facts.filter("path IS NOT NULL").select("file", "path")
    if len(lines.inputFiles()) <= MAX_BROADCAST_PIECES:
        names = F.broadcast(names)
    text = F.decode("value", encoding) if encoding.upper() != "UTF-8" else F.col("value").cast("string")
    found = whole.unionByName(edges).join(names, "file")
    return found.select(F.col("path").alias("file"), "number", F.regexp_replace(text, r"\r\z", "").alias("value"))
