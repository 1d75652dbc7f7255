"""Each stage of the pipeline against a brute-force version on its own input."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sievetable.llm import rules
from sievetable.llm.shared import table, written
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, shared_dir):
    """Rows before and after each stage."""
    docs = table(spark, FOLDER, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), name)
        out.append(docs.collect())
    return out


def test_order_and_columns(spark, tables):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "benchmark_decontamination", "personal_data", "token_ids"]
    columns = set(tables[0][0].asDict())
    assert all(set(rows[0].asDict()) == columns for rows in tables[:5])


def test_quality_rules(tables):
    rows = [(r.doc_id, r.text, r.source) for r in tables[0]]
    verdicts = brute.rule_figures(rows, rules.MAX_SHARE, rules.MIN_TEXTS, rules.MAX_TEXTS)
    assert sorted(r.doc_id for r in tables[1]) == sorted(v[0] for v in verdicts if v[-1])


def test_near_dedup(tables):
    rows = [(r.doc_id, r.text) for r in tables[1]]
    components = brute.near_components(rows, 5, 80)
    assert sorted(r.doc_id for r in tables[2]) == sorted({c for c in components})
    before = {r.doc_id: r for r in tables[1]}
    assert all(before[r.doc_id] == r for r in tables[2])


def test_benchmark(spark, tables):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    found = brute.contamination([(r.doc_id, r.text) for r in tables[2]], items)
    assert sorted(r.doc_id for r in tables[3]) == sorted(x[0] for x in found if not x[4])


def test_personal_data(tables):
    after = {r.doc_id: r for r in tables[4]}
    assert len(after) == len(tables[3])
    for r in tables[3]:
        spans = brute.private_spans(r.text)
        assert not brute.private_spans(after[r.doc_id].text)
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        if not spans and "token" not in r.text:
            assert after[r.doc_id].text == r.text


def test_token_ids(tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in tables[4]}
    assert len(tables[5]) == len(texts)
    for r in tables[5]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(packed), brute.sha(texts[r.doc_id]))


def test_empty_documents(spark, nothing, tables):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
