"""Metric join, periodic runs and phrases, against brute force."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sievetable.llm import metric, periods, phrases, queries
from tests.llm import brute
from tests.llm.conftest import changed, hard_rows, text

ROWS = [(i, t) for i, t, _ in hard_rows()]


@pytest.mark.parametrize("cell, rounds, common, size", [(1024, 4, 1 << 18, 1 << 20), (4, 1, 8, 1 << 20), (2, 3, 0, 0)])
def test_jaccard_components(hard, monkeypatch, cell, rounds, common, size):
    monkeypatch.setattr(metric, "BROADCAST_BYTES", size)
    monkeypatch.setattr(metric, "CELL", cell)
    monkeypatch.setattr(metric, "ROUNDS", rounds)
    monkeypatch.setattr(metric, "MOST_COMMON", common)
    got = metric.jaccard_components(hard).collect()
    expected = brute.near_components(ROWS, 5, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(
        (i, len(brute.shingle_set(t, 5)), c) for (i, t), c in zip(ROWS, expected)
    )


def random_sets(seed: int, groups: int = 6, size: int = 40) -> list[np.ndarray]:
    """Sets at all distances: groups around a base, changed more and more."""
    rng = random.Random(seed)
    sets = []
    for group in range(groups):
        base = [rng.randrange(10**6) for _ in range(rng.randrange(5, size))]
        for _ in range(rng.randrange(1, 12)):
            keep = [x for x in base if rng.random() > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.array([*keep, group, rng.randrange(10**6)], np.uint64)))
    return sets


@pytest.mark.parametrize("seed", range(40))
def test_a_region_joins_what_all_pairs_join(seed):
    sets = random_sets(seed)
    parent = list(range(len(sets)))

    def roots(links) -> list[int]:
        top = list(parent)
        for a, b in links:
            x, y = top[a], top[b]
            top = [y if t == x else t for t in top]
        return [top.index(t) for t in top]

    def near(a, b) -> bool:
        common = len(np.intersect1d(a, b))
        return 100 * common >= 80 * (len(a) + len(b) - common)

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    found = metric.region_links(parent, sets, 80)
    assert all(near(sets[a], sets[b]) for a, b in found)
    assert roots(found) == roots(pairs)


@pytest.mark.parametrize("seed", range(5))
def test_linked_sets_share_a_shingle_of_their_prefixes(seed):
    sets = random_sets(seed)
    keys, n = np.unique(np.concatenate(sets), return_counts=True)
    firsts = [set(metric.prefix(x, keys[n > 1], n[n > 1], 80).tolist()) for x in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert firsts[i] & firsts[j]


@pytest.mark.parametrize("seed", range(5))
def test_linked_sets_share_as_many_of_their_prefixes_as_is_said(spark, seed):
    sets = random_sets(seed, 12, 400)
    keys, n = np.unique(np.concatenate(sets), return_counts=True)
    firsts = [set(metric.prefix(x, keys[n > 1], n[n > 1], 80).tolist()) for x in sets]
    sizes = spark.createDataFrame([(len(x),) for x in sets], "n long")
    least = [r[0] for r in sizes.select(metric.shared_least(sizes["n"], 80)).collect()]
    assert max(least) > metric.SHARED
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert len(firsts[i] & firsts[j]) >= max(least[i], least[j])


def test_long_texts_that_share_a_few_shingles_by_chance_are_in_no_region(spark, shared_dir, monkeypatch):
    wanted = []
    region_sets = metric.region_sets

    def counted(docs, classes, *args):
        wanted.append(classes.count())
        return region_sets(docs, classes, *args)

    monkeypatch.setattr(metric, "region_sets", counted)
    monkeypatch.setattr(metric, "MOST_COMMON", 0)
    rng = random.Random(4)
    passages = [[f"p{rng.randrange(10**9)}" for _ in range(104)] for _ in range(10)]
    rows = []
    for i in range(20):  # two texts each have 100 of their 620 shingles in common
        words = [f"w{rng.randrange(10**9)}" for _ in range(520)]
        rows.append((i, " ".join(words + passages[i // 2])))
    rows += [(20, rows[0][1]), (21, rows[1][1] + " end"), (22, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in metric.jaccard_components(docs).collect()}
    assert got == {i: i for i in range(20)} | {20: 0, 21: 1, 22: 1}
    assert wanted == [2]


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_sets_come_from_one_text_of_repeated_rows(spark, shared_dir, monkeypatch, size):
    monkeypatch.setattr(metric, "BROADCAST_BYTES", size)
    rows = [(None, text(9)), (None, text(9)), (7, text(30)), (7, text(30)), (7, text(31)), (8, text(32))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = metric.keyed(docs, "doc_id", "text").distinct().where("id IS NULL OR id = 7").collect()
    classes = [(i, r.id, r.text_hash, bytearray(metric.set_key(metric.shingles(r.text, 5)))) for i, r in enumerate(ids)]
    wanted = spark.createDataFrame(classes, "cls long, id long, text_hash long, set binary")
    got = {r.cls: bytes(r.shingles) for r in metric.region_sets(docs, wanted, "doc_id", "text", 5).collect()}
    assert got == {i: metric.shingles(r.text, 5).tobytes() for i, r in enumerate(ids)}
    assert metric.region_sets(docs, wanted, "doc_id", "text", 5).count() == 3


def test_ids_that_are_null_or_repeated(spark, shared_dir):
    rows = [(None, text(9)), (7, text(9)), (None, text(10)), (7, text(11)), (8, text(11)), (8, text(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(metric.jaccard_components(docs).collect(), key=str)
    assert Counter(r.component_id for r in got) == {7: 5, None: 1}


def slow_runs(words: list) -> list[tuple]:
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            smaller = any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_many_texts_at_once():
    rng = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(5)):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(70))]
            texts.append(queries.looped(rng.randrange(40), words))
        assert [[tuple(r) for r in runs] for runs in periods.runs_of_texts(texts)] == [slow_runs(w) for w in texts]


def period_row(name, value: str | None) -> tuple:
    words = queries.looped(name, brute.SPACES.findall(value or ""))
    runs = slow_runs(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (name, len(runs), *figures, brute.sha(lines), brute.sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("batch", [2_000_000, 50])
def test_op12_against_brute_force(spark, shared_dir, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(periods, "BATCH_WORDS", batch)
    rows = [(i, t) for i, t in ROWS if t is None or len(t) < 4000]
    rows += [(i, text(i, 90)) for i in range(200, 260)] + [(None, "a b " * 9), (-5, "x " * 30), (61, "one two " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periods(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((period_row(*r) for r in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_a_long_text_with_runs_in_runs(spark, shared_dir):
    inner = "a b c d " * 5
    docs = spark.createDataFrame([(1, (inner + "x ") * 40_000)], "doc_id long, text string")
    row = periods.find_runs(docs).first()
    assert len(row.runs) == 40_001 and (row.runs[0].start, row.runs[0].length, row.runs[0].period) == (0, 20, 4)
    assert max(r.period for r in row.runs) == 21


def test_runs_of_nothing(nothing):
    assert periods.find_runs(nothing).count() == 0


def slow_phrases(rows: list[tuple], count: int, share: int, most: int) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    import re

    f, n = Counter(), Counter()
    for lang, value in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (value or "").translate(brute.ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {}
    for (lang, words), a in f.items():
        if len(words) == 1 or a < count:
            continue
        cut = min((Fraction(10**6 * a * a, f[lang, words[:k]] * f[lang, words[k:]]).__floor__(), k) for k in range(1, len(words)))
        longer = max((f[lang, w] for w in {(x, *words) for _, (x, *_) in f} | {(*words, x) for _, (*_, x) in f} if f[lang, w] >= count), default=0) if len(words) == 2 else 0
        if 100 * longer < share * a or not longer:
            l, r = f[lang, words[: cut[1]]], f[lang, words[cut[1] :]]
            found.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), l, r))
    out = []
    for lang, rows_of in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_of)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("mass, batch, most", [(1 << 22, 1 << 17, 2000), (64, 30, 7)])
def test_collocations(spark, shared_dir, monkeypatch, mass, batch, most):
    monkeypatch.setattr(phrases, "PARTITION_MASS", mass)
    monkeypatch.setattr(phrases, "BATCH_WORDS", batch)
    monkeypatch.setattr(phrases, "HELD_HASHES", 20 * batch)
    monkeypatch.setattr(phrases, "HELD_WORDS", batch)
    rng = random.Random(5)
    vocabulary = ["New", "York", "city", "the", "of", "a", "élan", "Straße", "x\x0by", "t\tab"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("en", None), ("fr", ""), (None, " .;\n"), ("en", "same words here now " * 400), ("en", "z" * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, phrase string").repartition(3)
    got = phrases.collocations(docs, most=most).collect()
    assert sorted(map(tuple, got)) == slow_phrases(rows, 10, 50, most)


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 1 << 32, 5000, dtype=np.uint32), np.repeat(np.arange(40, dtype=np.uint32), 12)])
    rng.shuffle(keys)
    summary = phrases.Summary(phrases.capacity_of(len(keys), 10))
    for part in np.array_split(keys, 50):
        found, counts = np.unique(part, return_counts=True)
        summary.add(found, counts)
    left = summary.survivors(10)
    assert set(range(40)) <= set(left.tolist()) and summary.taken < 10
    assert len(summary.keys) <= summary.capacity


def test_phrases_of_nothing(nothing):
    assert phrases.collocations(nothing).count() == 0
    assert metric.jaccard_components(nothing).count() == 0


def test_peeling_keeps_links_at_every_size(spark, shared_dir):
    rng = random.Random(8)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            cut = rng.randrange(len(words) // 4 + 1)
            rows.append((len(rows), " ".join(words[cut:] if rng.random() < 0.5 else words[: len(words) - cut])))
        rows.append((len(rows), " ".join(words[:6])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in metric.jaccard_components(docs).collect()}
    assert [got[i] for i, _ in rows] == brute.near_components(rows, 5, 80)
