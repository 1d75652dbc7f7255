"""Exact Jaccard join in its metric space: pivots, regions and windows of distances.

Documents are sets of word shingles and equal sets form a class. One minus the Jaccard
similarity is a metric, so with d(x, p) and d(y, p) known to a pivot p, x and y are too
far apart if the two differ by more than the wanted distance.

Between unrelated texts every distance is one, and no window of distances separates
them: pivots alone would copy nearly all classes into all regions. So the space is cut
by rare shingles first. Shingles are ordered by how common they are, and a set's prefix
is so long that two linked sets share ``SHARED`` shingles of it, or one for each ``SPACING``
shingles of the smaller set if that is more: long texts share a few with some others by
chance, the more so the more texts there are. A class that shares fewer with all others
together has no link. The classes that hold a shingle in their prefix meet its pivot, the
smallest class among them, and all classes that meet a pivot are its region. Every link lies
in a region; a class on a border is in several.

A region that fits into a task is joined there, recursively: the pivot's links are
confirmed, and what lies beyond, with the classes whose distance to the pivot is within
the window of what lies beyond, is a region with a new pivot. A larger region takes the
same step as a Spark join, one pivot for each region and round; what is still too large
after ``ROUNDS`` is cut into ranges of distance to its pivot, and pairs of blocks from
neighbouring ranges are joined. Nothing is dropped at any size. At first each class is
joined in its home alone, the largest of its regions, so that its set is sent once. Then
shingles that one component alone holds are left out, and what is left makes the regions
that are joined whole.

How common a shingle is only sets the order, so it may be known in part: blocks of rows
report the shingles they hold more than once, which are all that occur more often than
there are blocks; the ``MOST_COMMON`` most frequent of these come last in the order.

Null and empty texts have no shingles, no class and no links. Repeated rows have equal
results. A null id becomes a component's id only if the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.llm.graph import components
from sievetable.llm.minhash import set_key, shingles
from sievetable.llm.shared import written

MOST_COMMON = 1 << 18
BLOCK_SHINGLES = 4_000_000
#: Classes of a region that one task joins.
CELL = 1024
#: Linked sets share so many shingles of their prefixes, or as many as they can; long ones
#: share one for each ``SPACING`` shingles.
SHARED = 8
SPACING = 10
PEELINGS = 2
ROUNDS = 4
#: Sets of pivots and keys of texts are broadcast up to this size.
BROADCAST_BYTES = 32 << 20
KEY_BYTES = 16
#: Above the rounding of a distance; windows are this much wider.
SLACK = 1e-9


def linked(common: Column, one: Column, two: Column, similarity_pct: int) -> Column:
    return 100 * common >= similarity_pct * (one + two - common)


def local_repeats(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(shingle, n) that blocks of rows hold more than once."""

    def repeats(held: list[np.ndarray]) -> pd.DataFrame:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"shingle": found[n > 1].view(np.int64), "n": n[n > 1]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for frame in frames:
            for text in frame["text"]:
                held.append(shingles(text, size))
                total += len(held[-1])
                if total >= BLOCK_SHINGLES:
                    yield repeats(held)
                    held, total = [], 0
        if held:
            yield repeats(held)

    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.mapInPandas(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def common_shingles(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``MOST_COMMON`` shingles, sorted, and their counts: the most frequent ones."""
    counts = written(local_repeats(docs, text_col, size), "repeats")
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("low")).agg(F.count("*").alias("rows")).collect()
    least, total = None, 0
    for row in sorted(by_size, key=lambda r: -r.low):
        total += row.rows
        if total > MOST_COMMON:
            break
        least = 1 << row.low
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = counts.where(F.col("n") >= least).toPandas()
    keys = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy()[order]


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity_pct: int) -> np.ndarray:
    """The first shingles of a set in the order: two linked sets share as many as the smaller has beyond its rest."""
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]
    needed = -(-similarity_pct * len(found) // 100)
    return found[: len(found) - needed + min(max(SHARED, len(found) // SPACING), needed)]


def shared_least(n: Column, similarity_pct: int) -> Column:
    """Prefix shingles that a set of ``n`` has in common with any set it is linked with.

    The other set may have fewer shingles, and so a lower bound of its own.
    """
    smallest = F.ceil(n * similarity_pct / 100)
    wanted = F.greatest(F.lit(SHARED).cast("bigint"), F.floor(smallest / SPACING))
    return F.least(wanted, F.ceil(n * (similarity_pct * similarity_pct) / 10_000))


def prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, similarity_pct: int) -> DataFrame:
    """(id, text_hash, n_shingles, set, prefix) for every row."""
    keys, counts = common_shingles(docs, text_col, size)
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = shingles(text, size)
                if len(found):
                    first = prefix(found, *shared.value, similarity_pct)
                    rows.append((len(found), set_key(found), first.view(np.int64)))
                else:
                    rows.append((0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set", "prefix"])
            out.insert(0, "id", frame["id"].array)
            out.insert(1, "text_hash", frame["text_hash"].array)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInPandas(
        run, f"id {kind}, text_hash bigint, n_shingles bigint, set binary, prefix array<bigint>"
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def region_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(cls, n, shingles) of the wanted classes (cls, id, text_hash, set), from one text of each.

    Only texts with a wanted key are shuffled, and repeated rows meet where they are joined.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(c, shingles(text, size), k) for c, text, k in zip(frame["cls"], frame["text"], frame["set"])]
            same = [(c, x) for c, x, k in found if set_key(x) == k]
            yield pd.DataFrame(
                {"cls": [c for c, _ in same], "n": [len(x) for _, x in same], "shingles": [x.tobytes() for _, x in same]}
            )

    key = F.xxhash64("id", "text_hash").alias("key")
    ids = written(wanted.select(key, "cls", "set"), "wanted")
    text = keyed(docs, id_col, text_col).select(key, "text")
    if ids.count() * KEY_BYTES <= BROADCAST_BYTES:  # else all texts are shuffled
        text = text.join(F.broadcast(ids.select("key").distinct()), "key", "left_semi")
    one = text.join(ids, "key").dropDuplicates(["key", "cls", "text"])
    return one.mapInPandas(run, "cls bigint, n bigint, shingles binary")


def region_links(names: list[int], sets: list[np.ndarray], similarity_pct: int) -> list[tuple[int, int]]:
    """Links that join the components of a region, by pivots, windows and recursion."""
    window = 1 - similarity_pct / 100 + SLACK
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    shingle, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    waiting = [np.arange(len(names))]
    while waiting:
        members = waiting.pop()
        if len({top(i) for i in members.tolist()}) < 2:
            continue
        pivot, others = int(members[0]), members[1:]
        held = np.zeros(len(shingle), bool)
        held[flat[starts[pivot] : starts[pivot + 1]]] = True
        common = np.array([np.count_nonzero(held[flat[starts[i] : starts[i + 1]]]) for i in others.tolist()])
        union = sizes[others] + sizes[pivot] - common
        near = 100 * common >= similarity_pct * union
        for i in others[near].tolist():
            x, y = top(pivot), top(i)
            if x != y:
                parent[x] = y
                found.append((names[pivot], names[i]))
        if near.all():
            continue
        distance = 1 - common / union
        rest = ~near | (distance >= distance[~near].min() - window)
        others, near, distance = others[rest], near[rest], distance[rest]
        order = np.argsort(distance, kind="stable")
        # regions behind a gap in the distances hold no link to those before it
        for part in np.split(order, np.flatnonzero(np.diff(distance[order]) > window) + 1):
            beyond = others[part[~near[part]]]
            if len(beyond):
                waiting.append(np.concatenate([beyond, others[part[near[part]]]]))
    return found


def task_links(rows: DataFrame, similarity_pct: int) -> DataFrame:
    """(a, b): links of regions (region, cls, shingles) that are small enough for a task."""

    def joined(held: list[pd.DataFrame]) -> pd.DataFrame:
        region = pd.concat(held, ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in region["shingles"]]
        return pd.DataFrame(region_links(region["cls"].tolist(), sets, similarity_pct), columns=["a", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            edges = [0, *(np.flatnonzero(np.diff(frame["region"])) + 1).tolist(), len(frame)]
            for start, end in zip(edges, edges[1:]):
                if end == start:
                    continue
                part = frame.iloc[start:end]
                if held and held[-1]["region"].iloc[-1] != part["region"].iloc[0]:
                    yield joined(held)
                    held = []
                held.append(part)
        if held:
            yield joined(held)

    arranged = rows.repartition("region").sortWithinPartitions("region", "cls")
    return arranged.select("region", "cls", "shingles").mapInPandas(run, "a bigint, b bigint")


def pivot_distances(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(region, cls, n, common, distance) of the members (region, cls) to their region's pivot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            common = [
                int(np.isin(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).sum())
                for x, y in zip(frame["shingles"], frame["pivot_shingles"])
            ]
            yield frame[["region", "cls", "n", "pivot_n"]].assign(common=common)

    pivots = sets.select(
        F.col("cls").alias("region"), F.col("n").alias("pivot_n"), F.col("shingles").alias("pivot_shingles")
    )
    pivots = pivots.join(members.select("region").distinct(), "region", "left_semi")
    size = pivots.agg(F.sum(F.octet_length("pivot_shingles"))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else the sets are shuffled once more, by region
        pivots = F.broadcast(pivots)
    both = members.join(sets, "cls").join(pivots, "region")
    found = both.select("region", "cls", "n", "pivot_n", "shingles", "pivot_shingles").mapInPandas(
        run, "region bigint, cls bigint, n bigint, pivot_n bigint, common bigint"
    )
    return found.withColumn("distance", 1 - F.col("common") / (F.col("n") + F.col("pivot_n") - F.col("common")))


def block_pairs(members: DataFrame, window: float) -> DataFrame:
    """(region, cls): pairs of blocks of each region whose distances to its pivot may meet.

    A region is sliced by distance, each slice as wide as the window, so a link lies in a
    slice or in two neighbours. A slice is dealt into blocks by hash.
    """
    sliced = members.withColumn("slice", F.floor(F.col("distance") / window))
    sizes = sliced.groupBy("region", "slice").agg(F.ceil(F.count("*") / (CELL // 2)).alias("blocks"))
    name = F.struct("slice", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"))
    placed = sliced.join(sizes, ["region", "slice"]).select("region", "cls", name.alias("side"))
    blocks = sizes.select(
        "region", "slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    )
    reach = F.explode(F.array(F.col("slice"), F.col("slice") + 1)).alias("slice")
    left = blocks.select("region", F.struct("slice", "block").alias("one"), reach)
    right = blocks.select("region", "slice", F.struct("slice", "block").alias("two"))
    pairs = left.join(right, ["region", "slice"]).where(F.col("one") <= F.col("two"))
    sides = pairs.select(
        "region",
        F.xxhash64("region", "one", "two").alias("pair"),
        F.explode(F.array_distinct(F.array("one", "two"))).alias("side"),
    )
    return sides.join(placed, ["region", "side"]).select(F.col("pair").alias("region"), "cls")


def links(regions: DataFrame, sets: DataFrame, similarity_pct: int) -> DataFrame:
    """(a, b): links that join all components, from regions (region, cls)."""
    window = 1 - similarity_pct / 100 + SLACK
    found, left = [], regions
    for number in range(ROUNDS + 1):
        sizes = left.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
        small = left.join(sizes.where(F.col("size") <= CELL), "region").select("region", "cls")
        found.append(task_links(small.join(sets, "cls"), similarity_pct))
        large = left.join(sizes.where(F.col("size") > CELL), "region").select("region", "cls")
        if large.isEmpty():
            break
        measured = written(pivot_distances(large, sets), "distances")
        near = linked(F.col("common"), F.col("n"), F.col("pivot_n"), similarity_pct)
        found.append(measured.where(near & (F.col("cls") != F.col("region"))).select(F.col("region").alias("a"), F.col("cls").alias("b")))
        beyond = measured.where(~near).groupBy("region").agg(
            F.min("distance").alias("nearest"), F.min_by("cls", F.xxhash64("cls")).alias("pivot")
        )
        rest = measured.join(beyond, "region").where(~near | (F.col("distance") >= F.col("nearest") - window))
        if number == ROUNDS:
            pairs = block_pairs(rest.select("region", "cls", "distance"), window)
            found.append(task_links(pairs.join(sets, "cls"), similarity_pct))
            break
        left = written(rest.select(F.col("pivot").alias("region"), "cls").distinct(), "regions")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def peeled(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(region, cls, label, shingle) of entries (cls, label, shingle) that may make a link of two labels.

    A shingle that one label alone holds is left out, and so is a class with fewer shingles
    left than it has in common with any set it is linked with. A class has many entries and
    each shingle one of them, so a shingle's share of all entries is small, whatever its
    share of the classes.
    """
    entries = entries.repartition("shingle")
    for number in range(PEELINGS + 1):
        cells = entries.groupBy("shingle").agg(
            F.min("cls").alias("region"), F.min("label").alias("low"), F.max("label").alias("high")
        )
        cells = cells.where("low < high").select("shingle", "region")
        entries = written(entries.join(cells, "shingle"), "entries")
        if number < PEELINGS:
            shared = entries.groupBy("cls").agg(F.count("*").alias("shared"))
            few = shared.join(sizes, "cls").where(F.col("shared") < F.col("least")).select("cls")
            entries = entries.join(few, "cls", "left_anti").drop("region")
    return entries


def regions_of(entries: DataFrame, sizes: DataFrame, similarity_pct: int) -> DataFrame:
    """(region, cls): the classes that meet a pivot in peeled entries."""
    met = entries.groupBy("region", "cls").agg(F.count("*").alias("shared")).join(sizes, "cls")
    met = written(met, "met")
    # Two that only meet each other are compared nowhere else, so their own figures decide.
    pairs = met.groupBy("region").agg(
        F.count("*").alias("size"), F.min("shared").alias("shared"), F.max("least").alias("least"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    linkable = (F.col("shared") >= F.col("least")) & (100 * F.col("low") >= similarity_pct * F.col("high"))
    kept = pairs.where((F.col("size") > 2) | linkable).select("region")
    return written(met.join(kept, "region", "left_semi").select("region", "cls"), "regions")


def homes(regions: DataFrame) -> DataFrame:
    """(region, cls): each class in the largest of its regions."""
    sizes = regions.groupBy("region").agg(F.count("*").alias("size"))
    largest = F.max(F.struct("size", "region")).alias("home")
    return written(regions.join(sizes, "region").groupBy("cls").agg(largest).select("home.region", "cls"), "homes")


def open_entries(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, label, shingle): entries labelled by the component of their class."""
    labelled = entries.select("cls", "shingle").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return labelled.select("cls", F.coalesce("root", "cls").alias("label"), "shingle")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity_pct: int = 80
) -> DataFrame:
    """One row per document: id, text_hash, n_shingles, component_id (the smallest id it reaches)."""
    rows = written(prefixes(docs, id_col, text_col, size, similarity_pct), "prefixes")
    classes = (
        rows.where("set IS NOT NULL")
        .groupBy("set")
        .agg(
            F.min("id").alias("least"),
            F.min(F.struct("id", "text_hash")).alias("one"),
            F.first("n_shingles").alias("n"),
            F.first("prefix").alias("prefix"),
        )
        .select("set", "least", "one.id", "one.text_hash", "n", "prefix")
    )
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    sizes = classes.select("cls", "n", shared_least(F.col("n"), similarity_pct).alias("least"))
    entries = classes.select("cls", F.col("cls").alias("label"), F.explode("prefix").alias("shingle"))
    entries = peeled(entries, sizes)
    regions = regions_of(entries, sizes, similarity_pct)
    wanted = classes.join(regions.select("cls").distinct(), "cls", "left_semi").select("cls", "set", "id", "text_hash")
    sets = written(region_sets(docs, wanted, id_col, text_col, size), "sets")
    at_home = written(links(homes(regions), sets, similarity_pct), "links")
    first = written(components(at_home), "components")
    still_open = regions_of(peeled(open_entries(entries, first), sizes), sizes, similarity_pct)
    across = links(still_open, sets, similarity_pct)
    roots = components(written(at_home.unionAll(across), "links"))
    labels = classes.select("cls", "set", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    labels = labels.withColumn("root", F.coalesce("root", "cls"))
    smallest = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labels.join(smallest, "root").select("set", "component_id")
    out = rows.select("id", "text_hash", "n_shingles", "set").join(named, "set", "left")
    return out.select(
        F.col("id").alias(id_col), "text_hash", "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )
