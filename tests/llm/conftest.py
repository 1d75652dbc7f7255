"""Small tables with the cases every operator has to stand."""

from __future__ import annotations

import random

import pytest

WORDS = "and the of with for stone river letter über élan casa straße 0x1f 42 A1 market bridge".split()


def text(seed: int, words: int = 120) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(words):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + str(rng.randrange(300)))
        out.append("\n" if i % 12 == 11 else " ")
    return "".join(out)


def changed(base: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    words = base.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def hard_rows() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows, copies."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "a"), (5, "one two", "a")]
    rows += [(10 + i, text(i), "ab"[i % 2]) for i in range(12)]
    rows += [(30 + i, text(1), "a") for i in range(5)]
    rows += [(40 + i, changed(text(2), i, 1 + i % 6), "b") for i in range(14)]
    rows += [(60, text(3, 8000), "c"), (61, "word " * 4000, "c"), (62, "x" * 30_000, "c"), (63, "ab\n" * 500, "c")]
    rows += [(70 + i, "Same first line of this host\n" + text(100 + i, 60), "host") for i in range(25)]
    rows += [(11, text(1), "b"), (11, text(1), "b"), (12, text(77), "b")]
    return rows


@pytest.fixture(scope="session")
def shared_dir(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(scope="session")
def hard(spark, shared_dir):
    """The hard rows, with extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, source string, id string, words int, row long, key string, n int, h long"
    return spark.createDataFrame([(*r, "x", 1, 2, "k", None, 3) for r in hard_rows()], schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark, shared_dir):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
