"""Operators that look across all documents, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievetable.llm import decontaminate, minhash, private, queries, rules, suffixes
from tests.llm import brute
from tests.llm.conftest import changed, hard_rows, text

ROWS = [(i, t) for i, t, _ in hard_rows()]


@pytest.mark.parametrize("cell", [1024, 2])
@pytest.mark.parametrize("size, pct", [(3, 85), (5, 80)])
def test_near_duplicates(hard, monkeypatch, cell, size, pct):
    monkeypatch.setattr(minhash, "CELL", cell)
    got = minhash.near_duplicates(hard, size=size, similarity_pct=pct).collect()
    expected = brute.near_components(ROWS, size, pct)
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert found == sorted(
        (i, len(brute.shingle_set(t, size)), c, i == c) for (i, t), c in zip(ROWS, expected)
    )


def test_a_chain_of_near_copies_is_one_component(spark, shared_dir):
    texts, now = [], text(5, 300)
    for i in range(30):
        texts.append((i, now))
        now = changed(now, i, 2)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = brute.near_components(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=3, similarity_pct=85).collect()}
    assert [got[i] for i in range(30)] == expected


def test_low_bits_estimate_similarity():
    rng = random.Random(1)
    pool = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    for shared in (0.2, 0.5, 0.9):
        common = int(2000 * shared / (1 + shared))
        a, b = pool[:1000], pool[1000 - common : 2000 - common]
        sa, sb = (minhash.shingles(" ".join(x), 1) for x in (a, b))
        bits = [minhash.signature(minhash.minima(x)).tobytes() for x in (sa, sb)]
        nibbles = [[y for x in b for y in (x & 15, x >> 4)] for b in bits]
        agree = sum(x == y for x, y in zip(*nibbles)) / minhash.KEPT
        estimate = (agree - 1 / 16) / (1 - 1 / 16)
        assert abs(estimate - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.15


def test_keep_one(spark, hard):
    kept = minhash.keep_one(hard, size=5, similarity_pct=80)
    assert kept.columns == hard.columns
    components = brute.near_components(ROWS, 5, 80)
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({i for (i, _), c in zip(ROWS, components) if i == c})
    orphans = spark.createDataFrame([(None, text(9)), (None, None), (3, "a b c")], "doc_id long, text string")
    assert minhash.keep_one(orphans).count() == 3


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.keep_one(nothing).columns == nothing.columns


@pytest.mark.parametrize("bound", [200_000, 0])
def test_contamination(spark, hard, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_BLOCKS", bound)
    long_item = " ".join(text(3, 8000).split()[100:160])
    items = [(1, long_item), (2, " ".join(text(7).split()[5:19])), (3, "river letter"), (4, None), (5, ""), (6, "One"),
             (7, " ".join(text(7).split()[6:20]).upper()), (8, "ÉLAN stone42")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(hard, bench).collect()
    found = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got)
    assert found == sorted(tuple(x) for x in brute.contamination(ROWS, items))
    clean = decontaminate.remove_contaminated(hard, bench)
    assert clean.columns == hard.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in found if not x[4])


def test_contamination_without_rows(hard, nothing):
    empty = nothing.selectExpr("doc_id AS item_id", "text")
    assert decontaminate.contamination(nothing, empty).count() == 0
    rows = decontaminate.contamination(hard, empty).collect()
    assert len(rows) == len(ROWS) and not any(r.contaminated for r in rows)


def test_line_rules(hard, nothing):
    got = rules.judge(hard, max_share=0.2, min_texts=20).collect()
    found = sorted((
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_removed_words,
         r.base_failed, r.kept) for r in got
    ))
    assert found == sorted(brute.rule_figures(hard_rows(), 0.2, 20, rules.MAX_TEXTS))
    assert any(r.n_removed_words for r in got)
    assert rules.judge(nothing).count() == 0


def test_line_limit_does_not_grow_with_the_host(spark, shared_dir):
    """A line in 61 of 3,000 texts is a small share, and above a limit of 60 texts; one in 60 stays."""
    body = text(9, 60)
    rows = [(i, ("shared by 61\n" if i < 61 else "") + ("shared by 0060\n" if i % 50 == 0 else "") + body + " " + "".join(chr(97 + int(c)) for c in str(i)), "h") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    given = rules.judge(docs, max_share=0.5, max_texts=60).select("doc_id", "n_removed_words").collect()
    removed = {r.doc_id: r.n_removed_words for r in given}
    usual = removed[2999]
    assert all(removed[i] == usual + 3 * (i < 61) for i in range(3000))


def test_keep_good_removes_lines_and_rejected_rows(spark, hard):
    kept = rules.keep_good(hard)
    assert kept.columns == hard.columns
    figures = brute.rule_figures(hard_rows(), rules.MAX_SHARE, rules.MIN_TEXTS, rules.MAX_TEXTS)
    wanted = sorted(x[0] for x in figures if x[-1])
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == wanted
    assert not any("Same first line" in r.text for r in rows)
    by_id = dict(ROWS)
    assert all(r.text == by_id[r.doc_id] for r in rows if 13 <= r.doc_id < 60)


@pytest.mark.parametrize("cell", [4096, 1])
def test_repeated_strings(spark, hard, cell):
    passage = text(50, 150)
    more = [(200 + i, text(300 + i, 40) + passage + text(400 + i, 40)) for i in range(9)]
    more += [(220 + i, text(500 + i, 30) + passage[i * 40 :] + text(600 + i, 30)) for i in range(9)]
    docs = hard.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    got = suffixes.remove_repeats(docs, cell=cell).collect()
    found = sorted((
        (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), brute.sha(bytes(r.kept))) for r in got
    ))
    assert found == sorted(brute.without_repeats([*ROWS, *more]))


def test_repeated_strings_of_nothing(nothing):
    assert suffixes.remove_repeats(nothing).count() == 0


def test_a_run_of_one_character_is_spread(spark, shared_dir, monkeypatch):
    """It has a context at each byte, all alike: most rows of the table, but not of one task."""
    tables, written = {}, suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda frame, name: tables.setdefault(name, written(frame, name)))
    monkeypatch.setattr(suffixes, "HOT_ROWS", 200, raising=False)
    rows = [(1, "x" * 9000 + text(1)), (2, text(2) + "x" * 6000), (3, text(3)), (4, text(3, 200))]
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in large}
    try:
        for name, value in large.items():
            spark.conf.set(name, value)
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    found = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), brute.sha(bytes(r.kept))) for r in got)
    assert found == sorted(brute.without_repeats(rows))
    tasks = [r["count"] for r in tables["shared"].groupBy(F.input_file_name()).count().collect()]
    assert max(tasks) < 0.6 * sum(tasks)


def test_what_is_left_is_returned_as_text(spark, shared_dir, tmp_path):
    """Cuts between characters leave the text as it is; parted characters show as U+FFFD."""
    rows = [(1, "left č " + "p" * 500 + " right"), (2, "other " + "p" * 500), (3, None), (4, "ab")]
    rows += [(5, "č" + "\u010e" + "q" * 500), (6, "\u024e" + "q" * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "left č right", 2: "other", 3: "", 4: "ab", 5: "č\ufffd", 6: "\ufffd"}
    assert [got[i].kept_sha256 for i in (1, 5)] == [brute.sha("left č right".encode()), brute.sha(b"\xc4\x8d\xc4")]


def test_contexts_in_chunks(monkeypatch):
    data = (text(8, 3000) + text(9, 200) + text(8, 3000)).encode()
    whole = {(p, s) for _, p, a, b in suffixes.contexts(data) for s in range(a, b + 1)}
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    assert {(p, s) for _, p, a, b in suffixes.contexts(data) for s in range(a, b + 1)} == whole
    assert {s for _, s in whole} == set(range(len(data) - suffixes.LENGTH + 1))


def private_rows():
    rng = random.Random(2)
    rows = ["a@b.c_d@e.f x@y@z.w.q", "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.1.1", "+1 (743) 555-3824. +123", "4111 1111 1111 1111-",
            "é😀 me@x.io 😀 4111111111111111", None, "", "@" * 50, "9" * 5000, "a" * 20000 + "@b", "a.b@c.d." * 200, "+1" + "(" * 500]
    return rows + ["".join(rng.choice("a@.1234 -+()😀_é\n") for _ in range(150)) for _ in range(150)]


def test_private_pattern_rare_among_many_seeds(spark, shared_dir):
    rows = [(i, f"please write to user{i}@example.org today") for i in range(1500)]
    rows += [(2000 + i, f"badge of desk{i}@example.org today") for i in range(4)]
    rows += [(3000, "badge of Q7741-2093-KX today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in private.find_private(docs).collect()}
    assert found[3000] == [("email", 9, 22)]


def test_private_token_without_adjacent_digits(spark, shared_dir):
    rows = [(i, f"token = {i:032x}".replace("0000", "a0b1") + " end") for i in range(1, 6)]
    rows += [(10, "token = K7M2P9Q4 end"), (11, "token = a1b2c3d4 end"), (12, "token = a1b2c3d end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in private.find_private(docs).collect()}
    assert found[10] == found[11] == [("secret", 8, 16)] and not found[12]


def test_private_spans(spark, shared_dir, nothing):
    rows = private_rows()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.base] for r in private.find_private(docs).collect()}
    assert got == {i: brute.private_spans(t) for i, t in enumerate(rows)}
    assert private.find_private(nothing).count() == 0


def test_patterns_find_unseen_identifiers(spark, shared_dir):
    rng = random.Random(4)
    rows = [(i, f"{text(i, 5)} write to mailbox: user{i}@host.example now") for i in range(8)]
    rows += [(20 + i, f"{text(i, 5)} write to mailbox: user{i}{i}77#internal now") for i in range(3)]
    rows += [(40 + i, f"in the year {rng.randrange(10**6)} of {text(40 + i, 5)}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in private.find_private(docs).collect()}
    texts = dict(rows)
    for i in range(20, 23):
        kind, start, end = found[i][0]
        assert kind == "email" and texts[i][start:end] == f"user{i - 20}{i - 20}77#internal"
    assert all(not found[i] for i in range(40, 50))
    masked = {r.doc_id: r.text for r in private.mask_private(docs).collect()}
    assert masked[0].endswith("write to mailbox: <EMAIL> now") and masked[41] == texts[41]
