"""Phrases whose words attract each other, mined with mergeable Misra-Gries summaries.

Words are counted within their language and pieces of text, phrases of ``SIZES`` words
as well. The first pass hashes every occurrence of a phrase into one of many hash
partitions. A task sums its own occurrences, and a partition's sums are merged into one
Misra-Gries summary whose capacity exceeds the partition's mass divided by the wanted
count: where it overflows, as much is taken from every counter as leaves no more than
the capacity. All that is taken from one phrase stays below the wanted count, so each
frequent phrase survives. Survivors are kept as a bitmap over hash prefixes, whose size
is bounded; phrases that only share a prefix are looked at in vain, but none is lost.

The second pass counts the occurrences under the bitmap exactly, by their text. Scores,
cuts and what longer phrases cover are joins over the frequent phrases.

A null language is ``und``, a null text is empty. Empty texts and tables have no words
and no phrases. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetable.llm.minhash import mixed, word_hash
from sievetable.llm.shared import written

SIZES = (2, 3)
#: Hash partitions hold about so many occurrences; both counts are powers of two.
PARTITION_MASS, MOST_PART_BITS = 1 << 22, 16
#: The bitmap of survivors: 128 KiB to 64 MiB.
LEAST_MAP_BITS, MOST_MAP_BITS = 20, 29
#: What a task holds: words of a batch, hashes and distinct words before they are summed up.
BATCH_WORDS = 1 << 17
HELD_HASHES = 1 << 20
HELD_WORDS = 100_000
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A byte that UTF-8 never uses stands between pieces.
BORDER = b"\xff"
CUT = bytes.maketrans(SEPARATORS, BORDER * len(SEPARATORS))


def marked_words(text: str) -> list[bytes]:
    """The words of a text with a border wherever a piece ends."""
    words = text.encode("utf-8").lower().translate(CUT).replace(BORDER, b" \xff ").split()
    words.append(BORDER)
    return words


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, marked words) in lists of about ``BATCH_WORDS`` words, texts whole."""
    held: dict[str, list[bytes]] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            words = held.setdefault(lang, [])
            words += marked_words(text)
            if len(words) >= BATCH_WORDS:
                yield lang, held.pop(lang)
    yield from held.items()


def phrase_hashes(lang: str, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every phrase of ``size`` words within a piece."""
    hashes = np.fromiter((0 if w == BORDER else word_hash(w) for w in words), np.uint64, len(words))
    count = max(0, len(words) - size + 1)
    state = np.full(count, word_hash(f"{size} {lang}".encode()), np.uint64)
    inside = np.ones(count, bool)
    for at in range(size):
        here = hashes[at : at + count]
        inside &= here != 0
        state = mixed(state * np.uint64(3) + here)
    places = np.flatnonzero(inside)
    return places, state[places]


def packed(hashes: np.ndarray, part_bits: int) -> Iterator[tuple]:
    """(part, mass, single, several, times): one task's sums, by hash partition.

    A partition's keys are the 32 bits behind its own: ``single`` those that occur once.
    """
    high, times = np.unique(hashes >> np.uint64(32 - part_bits), return_counts=True)
    part = (high >> np.uint64(32)).astype(np.int64)
    key = high.astype(np.uint32)
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        k, n = key[start:end], times[start:end]
        once = n == 1
        yield (
            int(part[start]), int(n.sum()), k[once].tobytes(), k[~once].tobytes(), n[~once].astype(np.uint64).tobytes(),
        )


class Summary:
    """A Misra-Gries summary: no counter is short of its key's count by more than ``taken``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > 2 * self.capacity:
            self.fold()

    def fold(self) -> None:
        """Merge what waits; beyond the capacity, the same is taken from every counter."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting = []
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, place, counts)
        if len(self.keys) > self.capacity:
            least = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            self.taken += int(least)
            left = self.counts > least
            self.keys, self.counts = self.keys[left], self.counts[left] - least

    def survivors(self, count: int) -> np.ndarray:
        """All keys that may occur ``count`` times."""
        self.fold()
        return self.keys[self.counts + self.taken >= count]


def capacity_of(mass: int, count: int) -> int:
    """More than mass / count, so that less than ``count`` is taken from any key."""
    return mass // count + 1


def first_pass(texts: DataFrame, part_bits: int) -> DataFrame:
    """Packed sums of phrases by hash partition, and (lang, word, n) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}
        held: list[np.ndarray] = []

        def word_rows() -> pd.DataFrame:
            rows = [(lang, w.decode("utf-8"), n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "n"]).assign(
                part=None, mass=None, single=None, several=None, times=None
            )

        def sum_rows() -> pd.DataFrame:
            rows = list(packed(np.concatenate(held or [np.empty(0, np.uint64)]), part_bits))
            held.clear()
            return pd.DataFrame(rows, columns=["part", "mass", "single", "several", "times"]).assign(
                lang=None, word=None, n=None
            )

        for lang, words in batches(frames):
            counts.setdefault(lang, Counter()).update(words)
            counts[lang].pop(BORDER, None)
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield word_rows()
            held += [phrase_hashes(lang, words, size)[1] for size in SIZES]
            if sum(map(len, held)) > HELD_HASHES:
                yield sum_rows()
        yield word_rows()
        yield sum_rows()

    return texts.mapInPandas(
        run, "part int, mass bigint, single binary, several binary, times binary, lang string, word string, n bigint"
    )


def survivor_bits(sums: DataFrame, masses: dict[int, int], count: int, slice_bits: int) -> DataFrame:
    """(part, bits): each partition's slice of the bitmap of hash prefixes that survive."""

    def bits(summary: Summary) -> bytes:
        found = np.zeros(1 << slice_bits, np.uint8)
        found[summary.survivors(count) >> np.uint32(32 - slice_bits)] = 1
        return np.packbits(found).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, summary = None, None
        for frame in frames:
            for part, single, several, times in zip(*(frame[c] for c in ("part", "single", "several", "times"))):
                if part != now:
                    if summary is not None:
                        yield pd.DataFrame({"part": [now], "bits": [bits(summary)]})
                    now, summary = part, Summary(capacity_of(masses[part], count))
                once = np.frombuffer(single, np.uint32)
                summary.add(once, np.ones(len(once), np.int64))
                summary.add(np.frombuffer(several, np.uint32), np.frombuffer(times, np.uint64).astype(np.int64))
        if summary is not None:
            yield pd.DataFrame({"part": [now], "bits": [bits(summary)]})

    return sums.repartition("part").sortWithinPartitions("part").mapInPandas(run, "part int, bits binary")


def second_pass(texts: DataFrame, bitmap: bytes, map_bits: int) -> DataFrame:
    """(lang, phrase, size, n): occurrences of all phrases under the bitmap, summed by task."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(shared.value, np.uint8)
        for lang, words in batches(frames):
            for size in SIZES:
                places, hashes = phrase_hashes(lang, words, size)
                at = (hashes >> np.uint64(64 - map_bits)).astype(np.int64)
                there = (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                _, first, n = np.unique(hashes[there], return_index=True, return_counts=True)
                starts = places[there][first].tolist()
                phrases = [b" ".join(words[i : i + size]).decode("utf-8") for i in starts]
                if phrases:
                    yield pd.DataFrame({"lang": [lang] * len(phrases), "phrase": phrases, "size": size, "n": n})

    found = texts.mapInPandas(run, "lang string, phrase string, size int, n bigint")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def frequent(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", count: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, size, n) of phrases that occur ``count`` times."""
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    # a word and what follows it take some six bytes; this only sets the number of partitions
    occurrences = len(SIZES) * (size // 6 + 1)
    part_bits = min(MOST_PART_BITS, max(4, (occurrences // PARTITION_MASS).bit_length()))
    map_bits = min(MOST_MAP_BITS, max(LEAST_MAP_BITS, occurrences.bit_length() - 1))
    sums = written(first_pass(texts, part_bits), "phrase-sums")
    words = sums.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    packs = sums.where("part IS NOT NULL").select("part", "mass", "single", "several", "times")
    # one row per hash partition: at most 2 ** MOST_PART_BITS of them
    masses = {r.part: r.mass for r in packs.groupBy("part").agg(F.sum("mass").alias("mass")).collect()}
    slice_bits = map_bits - part_bits
    bitmap = bytearray((1 << map_bits) // 8)
    width = (1 << slice_bits) // 8
    for row in survivor_bits(packs, masses, count, slice_bits).toLocalIterator():
        bitmap[row.part * width : (row.part + 1) * width] = row.bits
    phrases = second_pass(texts, bytes(bitmap), map_bits).where(F.col("n") >= count)
    return written(words, "words"), written(phrases, "phrases")


def cuts(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, first, rest): every way to cut a phrase in two."""
    words = F.split("phrase", " ")

    def cut(k: Column) -> Column:
        return F.struct(
            k.alias("k"),
            F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"),
            F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest"),
        )

    every = F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)
    return candidates.select("lang", "phrase", F.col("n").alias("a"), F.inline(every))


def covered(candidates: DataFrame, share_pct: int) -> DataFrame:
    """(lang, phrase) of candidates that a longer one covers often enough."""
    words = F.split("phrase", " ")
    smaller = F.sequence(F.lit(min(SIZES)), F.col("size") - 1)
    inner = F.flatten(
        F.transform(
            smaller,
            lambda s: F.transform(
                F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice(words, i, s), " ")
            ),
        )
    )
    longer = candidates.where(F.col("size") > min(SIZES)).select("lang", F.explode(inner).alias("phrase"), "n")
    most = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    return (
        candidates.join(most, ["lang", "phrase"])
        .where(100 * F.col("longest") >= share_pct * F.col("n"))
        .select("lang", "phrase")
    )


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    count: int = 10,
    share_pct: int = 50,
    most: int = 2000,
) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l``, ``r`` count the phrase and the two parts of its weakest cut, ``n`` all
    words of the language; ``score`` is floor(10^6 a^2 / (l r)), computed in decimals.
    """
    words, phrases = frequent(docs, lang_col, text_col, count)
    parts = words.where(F.col("n") >= count).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    parts = parts.unionAll(phrases.where(F.col("size") < max(SIZES)).select("lang", "phrase", "n"))
    left = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    scored = (
        cuts(phrases)
        .join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .withColumns({c: F.col(c).cast("decimal(19,0)") for c in "alr"})
        .withColumn("score", F.expr("(1000000BD * a * a) div (l * r)"))
    )
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    chosen = weakest.join(covered(phrases, share_pct), ["lang", "phrase"], "left_anti").select(
        "lang", "phrase", *[F.col(f"cut.{c}").cast("bigint").alias(c) for c in ("a", "l", "r", "score")]
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = chosen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
