"""Benchmark decontamination by windows of normalised words.

Every window of 13 consecutive item words (a shorter item is one window) is looked
for in all documents. Each window covers one aligned block of a document: with windows
of m words, blocks of k = (m + 1) / 2 words that start at every (m + 1 - k)-th word.
Only the blocks are hashed and looked up in the broadcast set of the windows' blocks;
a hit carries the words around it, which are compared with the whole window.

Only DataFrame functions run. The windows are broadcast while there are at most
``BROADCAST_BLOCKS`` blocks; beyond, the join shuffles. Null texts have no words and
null item ids are left out of the lists. Repeated rows get the same result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words before they are in lower case; a fixed value.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_BLOCKS = 200_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, in their case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def block_hash(words: Column) -> Column:
    """Equal for equal words, also where only non-ASCII letters differ in case."""
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def windows_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(m, window, items): each distinct window, its size and the items that hold it."""
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item"), words_of(ascii_lower(F.col(text_col))).alias("words")
    ).where(F.size("words") > 0)
    sized = items.withColumn("m", F.least(F.size("words"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)
    texts = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("m")), " "))
    rows = sized.select("item", "m", F.explode(F.array_distinct(texts)).alias("window"))
    return rows.groupBy("m", "window").agg(F.collect_set("item").alias("items"))


def blocks_of(windows: DataFrame) -> DataFrame:
    """The blocks a window may cover: (m, h, offset, window, items)."""
    k = F.floor((F.col("m") + 1) / 2).cast("int")
    offsets = F.sequence(F.lit(0), F.col("m") - k)
    rows = windows.select("m", "window", "items", F.split("window", " ").alias("words"), F.explode(offsets).alias("offset"))
    return rows.select(
        "m", block_hash(F.slice("words", F.col("offset") + 1, k)).alias("h"), "offset", "window", "items"
    )


def document_blocks(rows: DataFrame, m: int) -> DataFrame:
    """The aligned blocks of each document for windows of ``m`` words."""
    k = (m + 1) // 2
    step = m + 1 - k
    n = F.size("words")

    def block(p: Column) -> Column:
        first = F.greatest(p - (m - k), F.lit(1))
        around = F.slice("words", first, F.least(p + m, n + 1) - first)
        return F.struct(
            p.alias("p"),
            first.alias("first"),
            block_hash(F.slice("words", p, F.lit(k))).alias("h"),
            F.array_join(around, " ").alias("around"),
        )

    places = F.sequence(F.lit(1), n - k + 1, F.lit(step))
    exploded = rows.where(n >= m).select("id", "text_hash", F.explode(F.transform(places, block)).alias("b"))
    return exploded.select("id", "text_hash", F.lit(m).alias("m"), "b.*")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """(id, text_hash, start, m, items): every place of every window, words from 1."""
    windows = windows_of(benchmark, item_col, "text")
    counted = windows.groupBy("m").agg(F.count("*").alias("n")).collect()  # at most WINDOW rows
    total = sum(r["n"] * (r["m"] - (r["m"] + 1) // 2 + 1) for r in counted)
    blocks = blocks_of(windows)
    if total <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        words_of(F.col(text_col)).alias("words"),
    )
    parts = [document_blocks(rows, m) for m in sorted(r["m"] for r in counted) or [WINDOW]]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    start = F.col("p") - F.col("offset")
    same = F.array_join(
        F.slice(F.split(ascii_lower(F.col("around")), " "), start - F.col("first") + 1, F.col("m")), " "
    )
    inside = (start >= F.col("first")) & (F.size(F.split("around", " ")) >= start - F.col("first") + F.col("m"))
    return (
        found.join(blocks, ["m", "h"])
        .where(F.when(inside, same == F.col("window")).otherwise(F.lit(False)))
        .select("id", "text_hash", start.alias("start"), "m", "items")
    )


def covered(spans: Column) -> Column:
    """Words covered by sorted (start, m) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["m"]
        fresh = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + fresh).alias("n"))

    return F.aggregate(spans, zero, add)["n"].cast("long")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row per document: id, text_hash, n_words, n_hit, items, spans, contaminated.

    ``spans`` are the places (start, m) of the windows. A document is contaminated
    when a twentieth of its words or more is hit.
    """
    hits = find_hits(docs, benchmark, id_col, text_col, item_col)
    per_text = hits.groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "m"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hit = per_text.select(
        F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans", "items", covered(F.col("spans")).alias("n_hit")
    )
    sizes = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.size(words_of(F.col(text_col))).cast("long").alias("n_words"),
    )
    rows = sizes.join(
        hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        F.col("id").alias(id_col),
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start: int, m: int>>")).alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without contaminated documents."""
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated")
    keys = bad.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__id")) & (
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__hash")
    )
    return docs.join(keys, same, "left_anti")
