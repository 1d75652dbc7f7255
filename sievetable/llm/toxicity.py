"""Toxicity by the nearest labelled examples.

At most ``MAX_EXAMPLES`` labelled rows, the first by a hash of their id, are the
examples. All their words and word beginnings span the space; inverse document
frequencies count all documents. A term that speaks for the label, by a test of two
shares over the examples, weighs ``EMPHASIS`` times as much. A text's neighbours are
the ``NEIGHBOURS`` examples of largest TF-IDF cosine, found exactly: the postings of the
examples lie in blocks, each with its largest weight of a term, and a block is opened
only while the weights could still reach the last neighbour. Their votes weigh by
closeness, and a logistic curve fitted on examples without themselves makes
probabilities of them.

A text without any word of the examples has no neighbour; its score is the share of
the label among all examples. Null texts are empty. Of several labels of an id the
largest counts, of several texts the first in order; null labels and ids are left out.
Without examples every score is 0. Scores depend on the text alone, so repeated rows
have equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetable.llm.shared import written

MAX_EXAMPLES = 2_048
MIN_TEXTS, MIN_Z, MIN_LIFT = 3, 4.5, 3.0
EMPHASIS = 8.0
NEIGHBOURS, BLOCK = 15, 512
DAMPING = 0.5
EVIDENCE = 3
TASKS = 64

WORD = re.compile(r"[^\W\d_]+")
STEM, MARKS = 5, ("*", "**", "***")
ROWS_OUT = 1000


def term_counts(text: str) -> dict[str, int]:
    """How often each word stands in a text, and which word beginnings stand in it.

    A beginning of ``STEM`` letters has a term for once, twice and three times or more.
    """
    counts = dict(Counter(WORD.findall(text.lower())))
    stems: dict[str, int] = {}
    for word, n in counts.items():
        if len(word) >= STEM:
            stem = word[:STEM]
            stems[stem] = stems.get(stem, 0) + n
    for stem, n in stems.items():
        for mark in MARKS[:n]:
            counts[stem + mark] = 1
    return counts


class Index:
    """Postings of examples in blocks, with the largest weight of each term in each block."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]]) -> None:
        self.idf = idf
        vectors = [self.vector(t, n) for _, _, t, n in examples]
        # examples with the same strongest terms share blocks, which makes the bounds tight
        def strongest(i: int) -> tuple:
            terms, weights = vectors[i]
            return (*terms[np.lexsort((terms, -weights))[:8]].tolist(), examples[i][0])

        order = sorted(range(len(examples)), key=strongest)
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = np.array([examples[i][1] for i in order], np.float64)
        self.n_blocks = -(-len(order) // BLOCK)
        self.largest = np.zeros((len(idf), self.n_blocks))
        if not order:
            return
        terms, weights = (np.concatenate(x) for x in zip(*(vectors[i] for i in order)))
        places = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        # a list of postings for each term and block
        cells = terms * self.n_blocks + places // BLOCK
        by_cell = np.lexsort((places, cells))
        self.starts = np.zeros(len(idf) * self.n_blocks + 1, np.int32)
        np.cumsum(np.bincount(cells, minlength=len(self.starts) - 1), out=self.starts[1:])
        self.places, self.weights = places[by_cell].astype(np.int32), weights[by_cell]
        held = np.unique(cells)
        self.largest.ravel()[held] = np.maximum.reduceat(self.weights, self.starts[held])

    def cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The cosines of all examples in some blocks; 0 elsewhere."""
        cells = (terms[:, None] * self.n_blocks + blocks).ravel()
        first = self.starts[cells]
        sizes = self.starts[cells + 1] - first
        at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        products = np.repeat(np.repeat(weights, len(blocks)), sizes) * self.weights[at]
        return np.round(np.bincount(self.places[at], products, len(self.ids)), 9)

    def vector(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, np.float64))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, terms: list[int], counts: list[int], without: int | None = None) -> list[tuple[float, int]]:
        """(cosine, example) of the nearest examples, the largest first, ties by place."""
        t, w = self.vector(terms, counts)
        bounds = w @ self.largest[t]
        order = np.argsort(-bounds, kind="stable")
        best: list[tuple[float, int]] = []
        done, group = 0, 1
        while done < len(order):
            least = -best[-1][0] if len(best) == NEIGHBOURS else 0.0
            opened = order[done : done + group]
            opened = opened[(bounds[opened] > 0) & (bounds[opened] >= least - 1e-9)]
            if not len(opened):
                break
            cosines = self.cosines(t, w, np.sort(opened))
            if without is not None:
                cosines[self.ids == without] = 0
            near = np.flatnonzero((cosines > 0) & (cosines >= least))
            near = near[np.argsort(-cosines[near], kind="stable")][:NEIGHBOURS]
            best = sorted(best + [(-cosines[i], int(i)) for i in near])[:NEIGHBOURS]
            # blocks are opened in growing groups, so that a text that prunes little needs few passes
            done, group = done + group, 4 * group
        return [(-c, i) for c, i in best]

    def vote(self, near: list[tuple[float, int]], prior: float) -> float:
        """The closeness-weighted share of the label, damped towards ``prior``."""
        weights = np.array([c * c for c, _ in near])
        labels = self.labels[[i for _, i in near]]
        return float(((weights * labels).sum() + DAMPING * prior) / (weights.sum() + DAMPING))


def logit(p: np.ndarray | float) -> np.ndarray | float:
    return np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))


def fitted_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    x = np.column_stack([logit(votes), np.ones(len(votes))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ theta))
        gradient = x.T @ (p - labels) + 1e-2 * (theta - [1.0, 0.0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """Index and curve."""

    def __init__(self, index: Index, prior: float, curve: tuple[float, float]) -> None:
        self.index, self.prior, self.curve = index, prior, curve

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        if not len(terms) or not len(self.index.ids):
            return self.prior, []
        near = self.index.nearest(terms, counts)
        slope, offset = self.curve
        value = slope * logit(self.index.vote(near, self.prior)) + offset
        shown = [
            {"id": int(self.index.ids[i]), "cosine": float(c), "label": int(self.index.labels[i])}
            for c, i in near[:EVIDENCE]
        ]
        return float(1 / (1 + math.exp(-min(50.0, max(-50.0, value))))), shown


def held_out(id_col: str):
    """Whether a row's labels are kept for testing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def examples_of(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows outside the test fold, chosen by a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    one = known.groupBy(F.col(id_col).alias("example")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("example"), "example").limit(most)


def vocabulary(examples: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """The place of every term of (text, label) rows, and which of them speak for the label."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), ROWS_OUT):
                part = frame.iloc[start : start + ROWS_OUT]
                counts = Counter((t, y) for text, y in zip(part["text"], part["label"]) for t in term_counts(text))
                yield pd.DataFrame([(t, y, n) for (t, y), n in counts.items()], columns=["term", "label", "n"])

    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1 = sizes.get(1, 0)
    n0 = sum(sizes.values()) - n1
    counts = examples.select("text", "label").mapInPandas(run, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("b"),
    )
    found = counts.toArrow()  # the words of at most MAX_EXAMPLES texts
    terms = found["term"].to_pylist()
    a, b = found["a"].to_numpy().astype(float), found["b"].to_numpy().astype(float)
    order = sorted(range(len(terms)), key=terms.__getitem__)
    places = {terms[i]: place for place, i in enumerate(order)}
    if not n1 or not n0:
        return places, np.zeros(len(terms), bool)
    pooled = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    telling = (a >= MIN_TEXTS) & (z >= MIN_Z) & (a / n1 >= MIN_LIFT * (b + 0.5) / n0)
    return places, telling[order]


def placed_terms(text: str, places: dict[str, int]) -> tuple[list[int], list[int]]:
    """The known terms of a text by place, and how often each stands there."""
    found = {place: n for t, n in term_counts(text).items() if (place := places.get(t)) is not None}
    return list(found), list(found.values())


def frequencies(vectors: DataFrame, n_terms: int) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many hold each known term."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(n_terms + 1, np.int64)  # the last for all texts
        for frame in frames:
            counts[-1] += len(frame)
            for terms in frame["terms"]:
                counts[terms] += 1
        held = np.flatnonzero(counts)
        yield pd.DataFrame({"t": held, "n": counts[held]})

    summed = vectors.select("terms").mapInPandas(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_terms + 1, np.int64)
    counts[summed["t"].to_numpy()] = summed["n"].to_numpy()
    return int(counts[-1]), counts[:-1]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = MAX_EXAMPLES,
) -> DataFrame:
    """One row per document: id, held_out, score, evidence (nearest examples)."""
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = written(examples_of(labels, id_col, label_col, most), "examples")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # at most MAX_EXAMPLES rows of two numbers
    labelled = narrow.join(F.broadcast(chosen), F.col("id") == F.col("example"))
    known = written(labelled.groupBy("example", "label").agg(F.min("text").alias("text")), "texts")
    places, telling = vocabulary(known)

    def sparse(column: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = pd.DataFrame([placed_terms(x, places) for x in frame["text"]], columns=["terms", "counts"])
                out.insert(0, column, frame[column].array)
                yield out

        return run

    arrays = "terms array<int>, counts array<int>"
    vectors = written(narrow.mapInPandas(sparse("id"), f"id {kind}, {arrays}"), "vectors")
    totals, counted = frequencies(vectors, len(places))
    idf = (np.log((1 + totals) / (1 + counted)) + 1) * np.where(telling, EMPHASIS, 1.0)
    known = written(known.mapInPandas(sparse("example"), f"example {kind}, {arrays}").join(F.broadcast(chosen), "example"), "known")
    rows = known.orderBy("example").toArrow()
    lists = [rows[c].combine_chunks() for c in ("terms", "counts")]
    examples = [
        (i, y, lists[0][k].values.to_numpy(), lists[1][k].values.to_numpy())
        for k, (i, y) in enumerate(zip(rows["example"].to_pylist(), rows["label"].to_pylist()))
    ]
    prior = (sum(x[1] for x in examples) + 0.5) / (len(examples) + 1) if examples else 0.0
    index = Index(idf, [x for x in examples if len(x[2])])
    # it grows with the examples alone
    sent = narrow.sparkSession.sparkContext.broadcast(index)

    def without_self(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for frame in frames:
            votes = [
                index.vote(index.nearest(t, n, i), prior)
                for i, t, n in zip(frame["example"], frame["terms"], frame["counts"])
            ]
            yield pd.DataFrame({"vote": votes, "label": frame["label"].array})

    curve = (1.0, 0.0)
    if len(index.ids):
        tests = known.where(F.size("terms") > 0).repartition(TASKS, "example")
        voted = tests.mapInPandas(without_self, "vote double, label int").toPandas()
        voted = voted.sort_values(["vote", "label"])
        curve = fitted_curve(voted["vote"].to_numpy(), voted["label"].to_numpy().astype(float))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value, prior, curve)
        for frame in frames:
            scored = [model.score(t, n) for t, n in zip(frame["terms"], frame["counts"])]
            out = pd.DataFrame(scored, columns=["score", "evidence"])
            out.insert(0, "id", frame["id"].array)
            yield out

    done = vectors.mapInPandas(
        score, f"id {kind}, score double, evidence array<struct<id: bigint, cosine: double, label: int>>"
    )
    return done.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "evidence")
