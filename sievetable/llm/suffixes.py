"""Removal of long repeated strings by sparse suffix sorting, one bucket at a time.

Every ``LENGTH``-byte string of a text belongs to its cover sample: of its positions,
the first whose following ``SAMPLE`` bytes have the smallest hash. Equal strings have
their sample at the same place, so samples chosen by content cover all pairs as those
of a difference cover do, but with one for some 170 bytes. Consecutive strings with one
sample are a context: the sample with the bytes before and behind it.

Contexts are bucketed by their sample. Equal contexts are counted and become one with
its multiplicity. In a bucket of different contexts, the sample suffixes are sorted
once; their ranks, cut at the wanted length by the common prefixes of neighbours,
decide the order of every string in the bucket together with the few bytes before the
sample. Strings with equal ranks on both sides are equal. One bucket at a time is in
memory. A bucket of more than ``CELL`` different contexts is never gathered: its ranges
of strings are bisected by counting digests of what all strings of a range, and any
string of it, have in common.

A passage that repeats a few characters has a context at each repeat, all alike but the
last ones, so one sample or context may hold most rows; joins by them are salted.

Null and short texts lose nothing. Repeated rows are repeats of each other. Strings
overlap freely, and what is repeated is judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetable.llm.minhash import mixed
from sievetable.llm.shared import written
from sievetable.operators.skew import LEAST_HOT_WEIGHT, salted_join

LENGTH, SAMPLE = 400, 64
WINDOW = LENGTH - SAMPLE + 1
CELL = 4096
HOT_ROWS = LEAST_HOT_WEIGHT
CHUNK = 1 << 18
FIRST_RANGE = 128
ROWS_OUT = 20_000

BASE = 0x9E3779B97F4A7C15
POWERS = np.full(CHUNK + LENGTH, BASE, np.uint64)
POWERS[0] = 1
POWERS = np.multiply.accumulate(POWERS)
INVERSES = np.full(CHUNK + LENGTH, pow(BASE, -1, 1 << 64), np.uint64)
INVERSES[0] = 1
INVERSES = np.multiply.accumulate(INVERSES)


def sample_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``SAMPLE`` bytes from each position on."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[: len(data)], out=sums[1:])
    return mixed((sums[SAMPLE:] - sums[:-SAMPLE]) * INVERSES[: len(data) - SAMPLE + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` neighbours."""
    size = len(values)
    padded = np.full(-(-size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:size] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: size - width + 1], ahead[width - 1 : size])


def contexts(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(hash, sample, first start, last start) of each context of a text."""
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(data) - LENGTH + 1, CHUNK):
        part = whole[begin : begin + CHUNK + LENGTH - 1]
        hashes = sample_hashes(part)
        places = np.arange(len(hashes), dtype=np.uint64)
        high = hashes & np.uint64(0xFFFFFFFF00000000)
        sample = (sliding_least(high | places, WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.diff(sample, prepend=-1))
        ends = np.append(starts[1:], len(sample)) - 1
        at = sample[starts]
        yield from zip(
            hashes[at].view(np.int64).tolist(),
            (at + begin).tolist(),
            (starts + begin).tolist(),
            (ends + begin).tolist(),
        )


def context_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, key, ctx, at, first, last) for every context of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "text_hash", "key", "ctx", "at", "first", "last"]
        for frame in frames:
            rows = []
            for i, text_hash, text in zip(frame["id"], frame["text_hash"], frame["text"]):
                data = text.encode("utf-8")
                if len(data) < LENGTH:
                    continue
                for key, at, first, last in contexts(data):
                    digest = hashlib.blake2b(data[first : last + LENGTH], digest_size=16)
                    digest.update((at - first).to_bytes(4, "little"))
                    rows.append((i, text_hash, key, digest.digest(), at, first, last))
                    if len(rows) >= ROWS_OUT:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInPandas(
        run, f"id {kind}, text_hash bigint, key bigint, ctx binary, at int, first int, last int"
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def with_bytes(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, ctx, n, m, at, content) of the chosen contexts; ``at`` is the sample's place in the content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, parts in zip(frame["text"], frame["parts"]):
                data = text.encode("utf-8")
                for p in parts:
                    content = data[p["first"] : p["last"] + LENGTH]
                    rows.append((p["key"], p["ctx"], p["n"], p["m"], p["at"] - p["first"], content))
            yield pd.DataFrame(rows, columns=["key", "ctx", "n", "m", "at", "content"])

    parts = chosen.groupBy("rep.id", "rep.text_hash").agg(
        F.collect_list(F.struct("key", "ctx", "n", "m", "rep.at", "rep.first", "rep.last")).alias("parts")
    )
    parts = parts.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "parts")
    text = keyed(docs, id_col, text_col)
    rows = text.join(parts, text["id"].eqNullSafe(F.col("__id")) & (text["text_hash"] == F.col("__hash")))
    return rows.select("text", "parts").mapInPandas(
        run, "key bigint, ctx binary, n bigint, m bigint, at int, content binary"
    ).dropDuplicates(["key", "ctx"])


def ranks(strings: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Ranks of the rows of a byte table, cut at each of the ``wanted`` lengths.

    The rows are sorted once; a rank grows where the common prefix of neighbours is
    shorter than the wanted length.
    """
    rows = [row.tobytes() for row in strings]
    order = np.array(sorted(range(len(rows)), key=rows.__getitem__))
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    out = np.zeros((len(rows), len(wanted)), np.int64)
    out[order[1:]] = np.cumsum(common[:, None] < wanted[None, :], axis=0)
    return out


def bucket_repeats(names: list[bytes], counts: list[int], ats: list[int], contents: list[bytes]) -> list[tuple]:
    """(ctx, low, high): ranges of sample offsets whose strings are repeated in a bucket."""
    size = len(names)
    behind = np.zeros((size, LENGTH), np.uint8)
    before = np.zeros((size, WINDOW), np.uint8)
    least = np.empty(size, np.int64)
    for i, (at, content) in enumerate(zip(ats, contents)):
        right = np.frombuffer(content, np.uint8)[at:]
        behind[i, : len(right)] = right
        before[i, :at] = np.frombuffer(content, np.uint8)[:at][::-1]
        least[i] = LENGTH - len(right)
    most = np.array(ats)
    offsets = np.arange(least.min(), most.max() + 1)
    both = ranks(behind, LENGTH - offsets) * size + ranks(before, offsets)
    valid = (offsets >= least[:, None]) & (offsets <= most[:, None])
    names_of = (both * len(offsets) + np.arange(len(offsets)))[valid]
    _, place = np.unique(names_of, return_inverse=True)
    weights = np.bincount(place, weights=np.repeat(np.array(counts), valid.sum(axis=1)))
    repeated = np.zeros((size, len(offsets) + 2), np.int8)
    repeated[:, 1:-1][valid] = weights[place] >= 2
    edges = np.diff(repeated, axis=1)
    row, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    return [(names[i], int(offsets[a]), int(offsets[b - 1])) for i, a, b in zip(row, low, high)]


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """(key, ctx, low, high) from contexts with their bytes, bucket by bucket."""

    def repeats(key: int, bucket: list[tuple]) -> list[tuple]:
        return [(key, *x) for x in bucket_repeats(*(list(c) for c in zip(*bucket)))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = None, []
        for frame in frames:
            found = []
            for now, *row in zip(*(frame[c] for c in ("key", "ctx", "n", "at", "content"))):
                if now != key:
                    if bucket:
                        found += repeats(key, bucket)
                    key, bucket = now, []
                bucket.append(tuple(row))
            yield pd.DataFrame(found, columns=["key", "ctx", "low", "high"])
        if bucket:
            yield pd.DataFrame(repeats(key, bucket), columns=["key", "ctx", "low", "high"])

    arranged = rows.repartition("key").sortWithinPartitions("key")
    return arranged.mapInPandas(run, "key bigint, ctx binary, low int, high int")


def bisected(rows: DataFrame) -> DataFrame:
    """(key, ctx, low, high) for large buckets, by counting digests of ranges of strings.

    A range whose common part is not shared is done, and so is one that is shared as a
    whole; of those that are shared alike one stays as a witness while ranges with the
    same common part are open. The rest is cut in halves.
    """
    least = F.lit(LENGTH) - (F.length("content") - F.col("at"))
    lows = F.array(*[F.lit(x) for x in range(0, WINDOW, FIRST_RANGE)])
    kept = ["key", "ctx", "at", "content"]
    state = rows.select(*kept, "n", F.lit(False).alias("known"), F.explode(lows).alias("low"))
    size, decided = FIRST_RANGE, None
    while True:
        high = F.col("low") + size - 1
        touching = state.where((F.col("low") <= F.col("at")) & (high >= least))
        part = F.substring("content", F.col("at") - F.col("low") + 1, F.lit(LENGTH - size + 1))
        whole = F.substring("content", F.col("at") - high + 1, F.lit(LENGTH + size - 1))
        inside = (F.col("low") >= least) & (high <= F.col("at"))
        hashed = touching.withColumn("part", F.md5(part)).withColumn("whole", F.when(inside, F.md5(whole)))
        hashed = written(hashed, "ranges")
        parts = hashed.groupBy("low", "part").agg(F.sum("n").alias("n_part")).where("n_part > 1")
        wholes = hashed.where("whole IS NOT NULL").groupBy("low", "whole").agg(F.sum("n").alias("n_whole"))
        left = hashed.join(parts, ["low", "part"]).join(wholes.where("n_whole > 1"), ["low", "whole"], "left")
        done = left.where("n_whole IS NOT NULL AND NOT known").select(
            "key", "ctx", F.col("low").cast("int").alias("low"), (F.col("low") + size - 1).cast("int").alias("high")
        )
        decided = done if decided is None else decided.unionAll(done)
        if size == 1:
            return decided
        size //= 2
        unknown = left.where("n_whole IS NULL AND NOT known")
        witnesses = (
            left.where("n_whole IS NOT NULL OR known")
            .join(unknown.select("low", "part").distinct(), ["low", "part"], "left_semi")
            .groupBy("low", F.coalesce("whole", "ctx").alias("same"))
            .agg(F.min(F.struct(*kept)).alias("row"), F.sum("n").alias("n"))
            .select("row.*", "n", F.lit(True).alias("known"), "low")
        )
        following = unknown.select(*kept, "n", "known", "low").unionAll(witnesses)
        halves = F.explode(F.array(F.col("low"), F.col("low") + size))
        state = following.select(*kept, "n", "known", halves.alias("low"))


def repeated_starts(docs: DataFrame, id_col: str, text_col: str, cell: int) -> DataFrame:
    """(id, text_hash, starts): ranges of starts of repeated strings in each text that has some."""
    rows = written(context_rows(docs, id_col, text_col), "contexts")
    keys = written(rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "keys")
    shared = written(salted_join(rows, keys, ["key"], "rows", hot_weight=HOT_ROWS).drop("rows"), "shared")
    grouped = shared.groupBy("key", "ctx").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "text_hash", "at", "first", "last")).alias("rep")
    )
    grouped = written(grouped, "grouped")
    buckets = written(grouped.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    chosen = salted_join(grouped, buckets, ["key"], "m", hot_weight=HOT_ROWS, spread_by=["ctx"])
    content = written(with_bytes(docs, chosen, id_col, text_col), "contents")
    found = sorted_buckets(content.where(F.col("m") <= cell))
    if content.where(F.col("m") > cell).limit(1).count():
        found = found.unionAll(bisected(content.where(F.col("m") > cell)))
    found = found.groupBy("key", "ctx").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    verdicts = grouped.select("key", "ctx", "n").join(found, ["key", "ctx"], "left")
    verdicts = written(verdicts.where("n > 1 OR ranges IS NOT NULL"), "verdicts")
    whole = F.array(F.struct((F.col("at") - F.col("last")).alias("low"), (F.col("at") - F.col("first")).alias("high")))
    ranges = F.when(F.col("n") > 1, whole).otherwise(F.col("ranges"))
    starts = salted_join(shared, verdicts, ["key", "ctx"], "n", hot_weight=HOT_ROWS).select(
        "id",
        "text_hash",
        F.transform(
            ranges, lambda r: F.struct((F.col("at") - r["high"]).alias("a"), (F.col("at") - r["low"]).alias("b"))
        ).alias("starts"),
    )
    return starts.groupBy("id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """One row per document: id, n_bytes, removed (spans of bytes), kept (the bytes left)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, text, starts in zip(frame["id"], frame["text"], frame["starts"]):
                data = text.encode("utf-8")
                spans: list[dict[str, int]] = []
                for a, b in sorted((x["a"], x["b"] + LENGTH) for x in starts) if starts is not None else ():
                    if spans and a <= spans[-1]["end"]:
                        spans[-1]["end"] = max(b, spans[-1]["end"])
                    else:
                        spans.append({"start": a, "end": b})
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((i, len(data), spans, kept))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "removed", "kept"])

    found = repeated_starts(docs, id_col, text_col, cell)
    found = found.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "starts")
    text = keyed(docs, id_col, text_col)
    same = text["id"].eqNullSafe(F.col("__id")) & (text["text_hash"] == F.col("__hash"))
    kind = docs.schema[id_col].dataType.simpleString()
    done = text.join(found, same, "left").select("id", "text", "starts").mapInPandas(
        run, f"id {kind}, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary"
    )
    return done.withColumnRenamed("id", id_col)
