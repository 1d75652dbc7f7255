"""Chat formatting, main text and toxicity."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from sievetable.llm import chat, pages, toxicity
from tests.llm.brute import sha
from tests.llm.conftest import text

HARD = ["</s>[INST] ok [/INST]", "<|turn|>assistant\nhi<|end|>\n", "\\", "\\\\<|end|>", "<\\/s>", "", None, "a\nb", "é😀"]


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(1 + conv % 7):
            role = ["user", "assistant"][turn % 2]
            said = "hello" if turn == 0 else HARD[rng.randrange(len(HARD))] if conv % 3 else f"answer {turn} {conv % 6}"
            rows.append((conv, turn, role, said))
    rows += [(100, t, r, s) for t, r, s in [(0, None, "x"), (1, "a\nb", "y"), (1, "assistant", "tie"), (1, "assistant", "tie")]]
    rows += [(101 + i, t, "user", "a common conversation") for i in range(20) for t in range(3)]
    return rows


def test_escaping_is_reversible():
    rng = random.Random(1)
    pieces = [*chat.CONTROL, "\\", "<", "/", "s>", "[", "INST]", "a", "\n"]
    for _ in range(500):
        plain = "".join(rng.choice(pieces) for _ in range(8))
        hidden = chat.escape(plain)
        assert chat.unescape(hidden) == plain
        assert not any(c in hidden for c in chat.CONTROL)


def test_chat_read_back(spark):
    rows = conversations()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.gathered(given.withColumns({"path": F.lit("p"), "pack": F.lit(1), "turns": F.lit(None)}).repartition(4))
    packs = chat.pack_conversations(turns)
    got = {r.conv_id: r for r in turns.select("conv_id", "path").join(chat.read_back(packs), "path").collect()}
    by_conv = {}
    for conv, turn, role, said in rows:
        by_conv.setdefault(conv, []).append((turn, role or "", said or ""))
    assert set(got) == set(by_conv)
    for conv, said in by_conv.items():
        plain = "".join(f"{r}\n{s}\n" for _, r, s in sorted(said))
        learnt = "".join(s for _, r, s in sorted(said) if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(said), sha(plain))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), sha(learnt))


def test_chat_streams_share_prefixes(spark):
    given = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    turns = chat.gathered(given)
    stream = chat.pack_conversations(turns).collect()
    by_pack = {}
    for r in stream:
        by_pack.setdefault(r.pack, []).append(r)
    for rows in by_pack.values():
        segments = [r for r in rows if r.path is None]
        ends = 0
        for r in segments:
            assert r.start == ends and r.position == sum(s.end - s.start for s in r.attends)
            ends += len(r.text)
        seen = [(tuple((s.start, s.end) for s in r.attends), r.text) for r in segments]
        assert len(seen) == len(set(seen))


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.pack_conversations(chat.gathered(none))).count() == 0


def test_field_finds_articles_in_unseen_layouts():
    model = pages.trained([])
    wrong = total = 0
    for html in pages.built_pages(60, seed=123):
        blocks = pages.blocks_of(html)
        found = model.decode([pages.features(b, i, len(blocks)) for i, b in enumerate(blocks)])
        wrong += sum(a != b for a, b in zip(found, pages.true_labels(blocks)))
        total += len(blocks)
    assert wrong / total < 0.03


def test_viterbi_is_the_best_labelling():
    model = pages.trained([])
    for html in pages.built_pages(5, seed=5):
        blocks = pages.blocks_of(html)[:10]
        rows = [pages.features(b, i, len(blocks)) for i, b in enumerate(blocks)]
        emit = model.emissions(rows)

        def value(labels):
            moves = sum(model.steps[a, b] for a, b in zip(labels, labels[1:]))
            return model.first[labels[0]] + moves + sum(e for e, y in zip(emit, labels) if y)

        best = max(value([(n >> i) & 1 for i in range(len(rows))]) for n in range(1 << len(rows)))
        assert abs(value(model.decode(rows)) - best) < 1e-9


def test_main_text_of_pages(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav>"
        "<!-- x --><div class=ad>Buy this.</div><article><h1>A &amp; B</h1><p><b>One\n two&nbsp;three.<br><p>Four &lt;five&gt;, six."
        "<ul><li>Seven eight.</li></ul></article><footer>&copy; me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "just text"), (1, "u", page), (4, "u", "<p" * 2000), (5, "u", "<div>" * 3000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = sorted((r.page_id or 0, r.text) for r in pages.extract_text(frame).collect())
    assert [t for i, t in got if i == 1] == ["A & B\nOne two three.\nFour <five>, six.\nSeven eight."] * 2
    assert {t for i, t in got if i in (2, 3)} == {""}
    assert len(got) == len(rows)
    assert pages.extract_text(frame.limit(0)).count() == 0


def labelled(n=600):
    rng = random.Random(6)
    bad = ["grobian", "vilainx", "nastyword", "meanword"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        body = text(i, 30)
        if toxic:
            body += " " + " ".join(rng.choice(bad) for _ in range(4))
        docs.append((i, body))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_the_held_out_fold(spark, shared_dir):
    docs, labels = labelled()
    truth = dict(labels)
    more = [(1000, None), (1001, ""), (None, "nastyword meanword"), (5, docs[5][1])]
    frame = spark.createDataFrame([*docs, *more], "doc_id long, text string").withColumn("score", F.lit(9))
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (labels[0][0], labels[0][1])], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(frame, marks).collect()
    assert len(rows) == len(docs) + len(more)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and all((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in rows)
    equal = {r.score for r in rows if r.doc_id == 5}
    assert len(equal) == 1


def test_toxicity_without_labels(spark, hard, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(hard, none).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, none).count() == 0


def test_nearest_examples_are_exact():
    rng = random.Random(8)
    idf = [1 + rng.random() for _ in range(40)]
    import numpy as np

    examples = []
    for i in range(900):
        terms = sorted(rng.sample(range(40), rng.randrange(1, 6)))
        examples.append((i, rng.randrange(2), terms, [rng.randrange(1, 4) for _ in terms]))
    index = toxicity.Index(np.array(idf), examples)
    vectors = np.zeros((900, 40))
    for i, (_, _, t, n) in enumerate(examples):
        terms, weights = index.vector(t, n)
        vectors[i, terms] = weights
    for i in range(0, 900, 7):
        _, _, t, n = examples[i]
        cosines = np.sort(np.round(vectors @ vectors[i], 9))[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose([c for c, _ in index.nearest(t, n)], cosines, atol=2e-9)


def test_toxicity_against_all_cosines(spark, shared_dir):
    """Evidence and scores of every text from dense vectors of all words, telling or not."""
    import math
    import re
    from collections import Counter

    import numpy as np

    docs, labels = labelled(400)
    docs += [(500, "plain words nobody marked"), (501, ""), (502, "qqqq zzzz")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    def terms(body):
        words = Counter(re.findall(r"[^\W\d_]+", body.lower()))
        stems = Counter()
        for word, n in words.items():
            stems.update({word[:5]: n} if len(word) >= 5 else {})
        words.update({f"{s}{'*' * k}": 1 for s, n in stems.items() for k in (1, 2, 3) if n >= k})
        return words

    truth = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    counts = {i: terms(body) for i, body in docs}
    space = sorted({t for i in truth for t in counts[i]})
    n1, n0 = sum(truth.values()), len(truth) - sum(truth.values())
    idf = {}
    for t in space:
        a, b = (sum(t in counts[i] for i, y in truth.items() if y == label) for label in (1, 0))
        pooled = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
        told = a >= 3 and z >= 4.5 and a / n1 >= 3 * (b + 0.5) / n0
        idf[t] = (math.log((1 + len(docs)) / (1 + sum(t in c for c in counts.values()))) + 1) * (8 if told else 1)
    assert 0 < sum(v >= 8 for v in idf.values()) < len(space) / 2

    def vector(i):
        v = np.array([(1 + math.log(counts[i][t])) * idf[t] if t in counts[i] else 0.0 for t in space])
        return v / (np.linalg.norm(v) or 1)

    matrix = np.array([vector(i) for i in truth])
    ids = list(truth)
    prior = (n1 + 0.5) / (len(truth) + 1)
    votes, scores = [], []
    for i, _ in docs:
        cosines = matrix @ vector(i)
        best = np.sort(cosines[cosines > 0])[::-1][:15]
        shown = rows[i].evidence
        assert len(shown) == min(3, len(best)) and np.allclose([e.cosine for e in shown], best[:3], atol=1e-8)
        assert all(abs(cosines[ids.index(e.id)] - e.cosine) < 1e-8 and truth[e.id] == e.label for e in shown)
        if not len(best):
            assert abs(rows[i].score - prior) < 1e-9
        elif len(best) == 15 and best[-1] - np.sort(cosines)[::-1][15] > 1e-8:  # no tie at the border
            near = np.argsort(-cosines, kind="stable")[:15]
            share = sum(cosines[k] ** 2 * truth[ids[k]] for k in near)
            votes.append(toxicity.logit((share + 0.5 * prior) / (sum(cosines[near] ** 2) + 0.5)))
            scores.append(toxicity.logit(rows[i].score))
    assert len(votes) > 300
    inner = np.abs(scores) < 13
    line = np.polyfit(np.array(votes)[inner], np.array(scores)[inner], 1)
    assert line[0] > 0 and np.allclose(np.polyval(line, np.array(votes)[inner]), np.array(scores)[inner], atol=1e-5)
