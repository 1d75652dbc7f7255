"""Runs of repeated words, proposed by a dictionary of basic factors.

Level k of the dictionary names every factor of 2^k words: a name at level k + 1 is the
pair of names of its halves. Occurrences of a name at i, i + q and i + 2q, each the next
one after the other and q at most twice the factor's length, are an arithmetic
progression and propose the period q. A run of period q and four times that length holds
such a progression of every factor of q to 2q - 1 words, as a primitive word occurs in
its own powers only at multiples of its length. Proposals of one period are extended
together: they lie in stretches where each word equals the word q places on, and a
stretch reaches as far as that holds. A stretch that was found with a smaller period
before is the same run.

Texts are worked on in batches. Words of different texts never have the same name, so
nothing goes over the border of a text, and a factor without a second occurrence in its
text is left out of the levels above. A text has to fit into a task.

Null and empty texts have no words and no runs. Repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_PERIODS = 6, 4
BATCH_WORDS = 2_000_000


class Run(NamedTuple):
    """A stretch of words from ``start``; ``period`` is its smallest."""

    start: int
    length: int
    period: int


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def named_words(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of all texts; equal words of one text share it, others don't."""
    total = sum(map(len, texts))
    names = np.empty(total, np.int64)
    at = free = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        for word in words:
            names[at] = seen.setdefault(word, free + len(seen))
            at += 1
        free += len(seen)
    return names


def repeated_names(place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by name and place, and their dense names, of names that occur twice or more."""
    order = np.argsort(name, kind="stable")
    place, name = place[order], name[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    dense = np.cumsum(new) - 1
    several = np.bincount(dense)[dense] > 1
    return place[several], dense[several]


def progressions(place: np.ndarray, name: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) where a name occurs thrice in a row at one distance of at most ``most``."""
    step = np.diff(place)
    same = name[1:] == name[:-1]
    twice = same[1:] & same[:-1] & (step[1:] == step[:-1]) & (step[1:] <= most)
    return place[:-2][twice], step[1:][twice]


def proposals(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, period) rows, sorted and distinct, proposed by the levels of the dictionary."""
    found = []
    place, name = repeated_names(np.arange(len(names)), names)
    length = 1
    while len(place):
        at, period = progressions(place, name, 2 * length)
        found.append(np.stack([np.searchsorted(bounds, at, side="right") - 1, period], axis=1))
        # names by place, for the pairs of the next level; places that were left out have none
        level = np.full(len(names) + length, -1, np.int64)
        level[place] = name
        place = np.sort(place)
        place = place[level[place + length] >= 0]
        pair = level[place] * (int(name.max()) + 1) + level[place + length]
        place, name = repeated_names(place, pair)
        length *= 2
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def stretches(names: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches with this period that are long enough."""
    equal = np.zeros(len(names) - period + 2, np.int8)
    equal[1:-1] = names[period:] == names[:-period]
    edges = np.diff(equal)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts + period
    long = lengths >= max(LEAST_LENGTH, LEAST_PERIODS * period)
    return zip(starts[long].tolist(), lengths[long].tolist())


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        dropped[run.start + run.period] += 1
        dropped[run.start + run.length] -= 1
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, by start and then period."""
    bounds = np.concatenate(([0], np.cumsum([len(words) for words in texts])))
    names = named_words(texts)
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    for text, period in proposals(names, bounds).tolist():  # periods ascend within a text
        for start, length in stretches(names[bounds[text] : bounds[text + 1]], period):
            found[text].setdefault((start, length), period)
    return [sorted((Run(*k, q) for k, q in runs.items()), key=lambda r: (r.start, r.period)) for runs in found]


def batches(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for words in texts:
        held.append(words)
        size += len(words)
        if size >= BATCH_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per document: id, runs (start, length, period, by start and then period), collapsed.

    ``collapsed`` are the words that are kept, joined by one space, as bytes. ``prepare``
    may change a document's words first, from its id and its words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["id"].array
            words = (
                prepare(i, words_of(text)) if prepare else words_of(text) for i, text in zip(ids, frame["text"])
            )
            at = 0
            for held in batches(words):
                found = runs_of_texts(held)
                out = pd.DataFrame({
                    "runs": [[r._asdict() for r in runs] for runs in found],
                    "collapsed": [b" ".join(collapsed(w, runs)) for w, runs in zip(held, found)],
                })
                out.insert(0, "id", ids[at : at + len(held)])
                at += len(held)
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = narrow.mapInPandas(
        run, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    )
    return found.withColumnRenamed("id", id_col)
