"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Documents with equal sets form a
class. Each class has ``BANDS * ROWS`` minima; bands of them make candidate buckets, and
the low bits of the first ``KEPT`` minima are packed into a signature, from which the
similarity of a candidate pair is estimated by counting bits and correcting for chance
collisions. What passes is confirmed on the full sets.

No bucket is expanded into all its pairs. A class is first compared with two
representatives of each of its buckets, and the nearest of them by the estimate are
confirmed. Buckets whose classes are all in one component by then are done. The others
are compared in cells of bounded size, which hold the sets too and return only the
links that join components; a pair is looked at in the first of its common buckets.
Nothing is dropped or capped: a pair shares no band with probability
(1 - s^ROWS)^BANDS, below 3e-7 at similarity 0.85, and is lost by the estimate with
about 3e-5 where it is the only link.

Null and empty texts have no shingles, no class and no links. Repeated rows have equal
results. A null id becomes a component's id only if the component has no other, and its
rows are kept then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.llm.graph import components
from sievetable.llm.shared import written

ROWS, BANDS, KEPT, BITS = 5, 26, 128, 4
SEED = 20240607
#: Four standard deviations of the estimate below the wanted similarity still pass.
DEVIATIONS = 4
CELL = 1024
#: So many of a class's nearest representatives are confirmed at first.
FIRST_TRIES = 3
CACHED_WORDS = 200_000

_PARAMETERS = np.random.default_rng(SEED)
MULTIPLIERS = (_PARAMETERS.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) << 1) | 1
OFFSETS = _PARAMETERS.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
BAND_FACTORS = _PARAMETERS.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_TAGS = _PARAMETERS.integers(0, 1 << 63, BANDS, dtype=np.uint64)

_CACHE: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby inputs end far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    found = _CACHE.get(word)
    if found is None:
        if len(_CACHE) >= CACHED_WORDS:
            _CACHE.clear()
        found = _CACHE[word] = xxhash.xxh3_64_intdigest(word)
    return found


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    state = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        state = mixed(state * np.uint64(3) + hashes[at : at + len(state)])
    return np.unique(state)


def minima(shingle_set: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the hash functions."""
    low = (shingle_set >> np.uint64(32)).astype(np.uint32)
    best = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        part = low[start : start + 2048, None] * MULTIPLIERS + OFFSETS
        np.minimum(best, part.min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    by_band = best.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((mixed(by_band) * BAND_FACTORS).sum(axis=1, dtype=np.uint64) + BAND_TAGS).view(np.int64)


def signature(best: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, packed into 64-bit words."""
    low = (mixed(best[:KEPT].astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << np.uint8(4))).view(np.int64)


def set_key(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def least_equal(similarity: float) -> int:
    """How many low bits groups must agree for a pair to pass the estimate."""
    chance = 1 / (1 << BITS)
    expected = similarity + (1 - similarity) * chance
    spread = (KEPT * expected * (1 - expected)) ** 0.5
    return int(KEPT * expected - DEVIATIONS * spread)


def differing(a: Column, b: Column) -> Column:
    """Bit groups in which two packed signatures differ, by bit counts."""

    def groups(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, groups), F.lit(0), lambda n, x: n + x)


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, text_hash, n_shingles, set, bands, bits) for every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = shingles(text, size)
                if len(found):
                    best = minima(found)
                    rows.append((len(found), set_key(found), band_keys(best), signature(best)))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set", "bands", "bits"])
            out.insert(0, "id", frame["id"].array)
            out.insert(1, "text_hash", frame["text_hash"].array)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return narrow.mapInPandas(
        run, f"id {kind}, text_hash bigint, n_shingles bigint, set binary, bands array<bigint>, bits array<bigint>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(set, shingles, short) of the wanted classes, from the text of their first document.

    ``short`` are the sorted upper halves of the hashes, as 32-bit integers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shingles(text, size) for text in frame["text"]]
            same = [(k, x) for x, k in zip(found, frame["set"]) if set_key(x) == k]
            yield pd.DataFrame({
                "set": [k for k, _ in same],
                "shingles": [x.view(np.int64) for _, x in same],
                "short": [(x >> np.uint64(32)).astype(np.uint32).tobytes() for _, x in same],
            })

    ids = wanted.select(F.col("first").alias("__first"), "set")
    text = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = text.join(ids, F.col("__id").eqNullSafe(F.col("__first"))).select("set", "text")
    return rows.mapInPandas(run, "set binary, shingles array<bigint>, short binary").dropDuplicates(["set"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity_pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - common
    return both.where(100 * common >= similarity_pct * union).select("a", "b")


def joining_links(cell: pd.DataFrame, most: int, similarity_pct: int) -> list[tuple[bytes, bytes]]:
    """Links within a cell that join different components, the likeliest pairs first."""
    ones = np.uint64(0x1111111111111111)
    bits = np.stack(cell["bits"].to_list()).view(np.uint64)
    bands = np.stack(cell["bands"].to_list())
    root = pd.factorize(cell["root"])[0]
    block = cell["block"].to_numpy()
    band, split = int(cell["band"].iloc[0]), cell["lo"].iloc[0] != cell["hi"].iloc[0]
    left, right, apart = [], [], []
    for at in range(len(cell) - 1):
        rest = np.arange(at + 1, len(cell))
        rest = rest[root[rest] != root[at]]
        if split:
            rest = rest[block[rest] != block[at]]
        if band and len(rest):
            rest = rest[~(bands[rest, :band] == bands[at, :band]).any(axis=1)]
        if not len(rest):
            continue
        d = bits[rest] ^ bits[at]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        differing_groups = np.bitwise_count(d & ones).sum(axis=1)
        near = differing_groups <= most
        left.append(np.full(int(near.sum()), at))
        right.append(rest[near])
        apart.append(differing_groups[near])
    if not left:
        return []
    left, right, apart = map(np.concatenate, (left, right, apart))
    parent = list(range(int(root.max()) + 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    names = cell["set"].to_list()
    sets = [np.frombuffer(x, np.uint32) for x in cell["short"]]
    found = []
    for i in np.argsort(apart, kind="stable"):
        a, b = int(left[i]), int(right[i])
        x, y = top(int(root[a])), top(int(root[b]))
        if x == y:
            continue
        small, large = sorted((sets[a], sets[b]), key=len)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        common = int((large[at] == small).sum())
        if 100 * common >= similarity_pct * (len(small) + len(large) - common):
            parent[x] = y
            found.append((max(names[a], names[b]), min(names[a], names[b])))
    return found


def compare_cells(rows: DataFrame, most: int, similarity_pct: int) -> DataFrame:
    """(a, b): links between components, cell by cell.

    ``rows`` are (key, band, lo, hi, block, set, root, bits, bands, short), sorted by cell
    within tasks. The upper halves of the hashes may meet by chance, so a link is
    confirmed on the whole hashes afterwards.
    """
    names = ["key", "lo", "hi"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            starts = np.flatnonzero((frame[names] != frame[names].shift()).any(axis=1).to_numpy())
            continued = bool(held) and (frame[names].iloc[0] == held[-1][names].iloc[-1]).all()
            edges = [0, *starts[int(continued) :], len(frame)]
            found: list[tuple[bytes, bytes]] = []
            for number, (start, end) in enumerate(zip(edges, edges[1:])):
                if held and (number or not continued):
                    found += joining_links(pd.concat(held, ignore_index=True), most, similarity_pct)
                    held = []
                if end > start:
                    held.append(frame.iloc[start:end])
            yield pd.DataFrame(sorted(set(found)), columns=["a", "b"])
        if held:
            last = joining_links(pd.concat(held, ignore_index=True), most, similarity_pct)
            yield pd.DataFrame(last, columns=["a", "b"])

    return rows.mapInPandas(run, "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity_pct: int = 80,
) -> DataFrame:
    """One row per document: id, text_hash, n_shingles, component_id, kept.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of
    ``similarity_pct`` percent or more are linked; the component's id is its smallest
    document id.
    """
    most = KEPT - least_equal(similarity_pct / 100)
    rows = written(sketch(docs, id_col, text_col, size), "sketches")
    classes = (
        rows.where("set IS NOT NULL")
        .groupBy("set")
        .agg(F.min("id").alias("first"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    )
    classes = written(classes, "classes")
    members = classes.select("set", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("key").agg(
        F.min("set").alias("low"), F.max("set").alias("high"), F.count("*").alias("n")
    )
    # shared buckets only: (key, set, band, low, high, n)
    shared = written(members.join(buckets.where("n > 1"), "key"), "buckets")
    bits = classes.select("set", "bits")
    wanted = classes.join(shared.select("set").distinct(), "set", "left_semi").select("set", "first")
    sets = written(full_sets(docs, wanted, id_col, text_col, size), "sets")

    pairs = shared.select("set", F.explode(F.array("low", "high")).alias("rep")).where("set != rep").distinct()
    estimated = (
        pairs.join(bits, "set")
        .join(bits.select(F.col("set").alias("rep"), F.col("bits").alias("rep_bits")), "rep")
        .withColumn("differing", differing(F.col("bits"), F.col("rep_bits")))
        .where(F.col("differing") <= most)
    )
    # at most two representatives for each band
    nearest = F.slice(F.array_sort(F.collect_set(F.struct("differing", "rep"))), 1, FIRST_TRIES)
    chosen = estimated.groupBy("set").agg(nearest.alias("best")).select(F.col("set").alias("a"), F.explode("best").alias("x"))
    links = confirmed(chosen.select("a", F.col("x.rep").alias("b")), sets, similarity_pct)
    first = written(components(written(links, "links")), "components")

    labelled = shared.join(first.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "root", F.coalesce("root", "set")
    )
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("key")
    )
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    block = F.pmod(F.xxhash64("set"), blocks).cast("int")
    cells = (
        labelled.join(open_keys, "key", "left_semi")
        .select("key", "band", "set", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
        .withColumn("lo", F.least("block", "with"))
        .withColumn("hi", F.greatest("block", "with"))
        .join(classes.select("set", "bits", "bands"), "set")
        .join(sets.select("set", "short"), "set")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )
    rest = confirmed(compare_cells(cells, most, similarity_pct), sets, similarity_pct)
    roots = first.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    lifted = (
        rest.join(roots, F.col("a") == F.col("__node"), "left")
        .select(F.coalesce("__root", "a").alias("a"), "b")
        .join(roots, F.col("b") == F.col("__node"), "left")
        .select("a", F.coalesce("__root", "b").alias("b"))
    )
    second = components(written(lifted, "links"))
    labels = (
        classes.select("set", "first")
        .join(first.withColumnRenamed("node", "set"), "set", "left")
        .withColumn("root", F.coalesce("root", "set"))
        .join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        .withColumn("root", F.coalesce("top", "root"))
        .select("set", "first", "root")
    )
    labels = written(labels, "labels")
    smallest = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labels.join(smallest, "root").select("set", "component_id")
    out = rows.select("id", "text_hash", "n_shingles", "set").join(named, "set", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity_pct: int = 80) -> DataFrame:
    """``docs`` with one document of each component; of repeated rows one stays."""
    kept = near_duplicates(docs, id_col, text_col, size, similarity_pct).where("kept")
    keys = kept.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__text", F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    joined = hashed.join(keys, hashed[id_col].eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    return joined.dropDuplicates(["__id", "__hash"]).select(*docs.columns)
