"""Operators that look at one text at a time."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievetable.llm import bpe, licenses
from tests.llm.brute import LETTERS, ASCII
from tests.llm.conftest import hard_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    chars = [chr(c) for c in [*range(0x20, 0x250), *range(0x400, 0x460), 0x2028, 0x3000, *range(0x1F600, 0x1F640)]]
    texts = ["".join(rng.choice(chars) for _ in range(200)) for _ in range(40)]
    return [*texts, "", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "I'll we've", "  \n\n x", "é" * 700, "z" * 2000]


def test_bpe_equals_the_library(library):
    words = bpe.Vocabulary(PATH)
    for text in odd_texts():
        packed = words.encode(text)
        ids = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert words.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_as_short_ones():
    words = bpe.Vocabulary(PATH)
    for text in ("abcabc" * 40, "the" * 80, "é" * 100):
        ids = [words.first[b] for b in text.encode()]
        assert words._scan(list(ids)) == words._queue(list(ids))


def test_bpe_rows(hard, nothing, library):
    rows = bpe.encode_texts(hard, PATH).collect()
    assert len(rows) == len(hard_rows())
    expected = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in hard_rows())
    got = sorted((r.doc_id, list(memoryview(bytes(r.ids)).cast("I")) if r.ids else []) for r in rows)
    assert got == expected
    assert sorted((r.doc_id, r.decoded) for r in rows) == sorted((i, t or "") for i, t, _ in hard_rows())
    assert bpe.encode_texts(nothing, PATH).count() == 0


def phrase_figures(text):
    words = LETTERS.findall((text or "").translate(ASCII))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_license_phrases(spark, hard, nothing):
    lines = [
        "Licensed under the Apache License, Version 2.0.", "MIT LICENSE mit-license mit  license", "CC-BY 4.0 and cc.by",
        "GNU General Public License", "gnu general public", "emit license",
    ]
    extra = spark.createDataFrame([(900 + i, t, "a") for i, t in enumerate(lines)], "doc_id long, text string, source string")
    docs = hard.select("doc_id", "text", "source").unionAll(extra)
    texts = {(i, t) for i, t, _ in [*hard_rows(), *((900 + i, t, "a") for i, t in enumerate(lines))]}
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()]
    assert {(x[0], *x[1:5], tuple(x[5])) for x in got} == {
        (i, *phrase_figures(t)[:4], tuple(phrase_figures(t)[4])) for i, t in texts
    }
    assert licenses.scan_licenses(nothing).count() == 0


def test_license_templates(spark):
    label, body = licenses.TEMPLATES[3]
    words = body.split()
    noisy = "some words before " + " ".join([*words[:20], "inserted", *words[20:]]) + " and after"
    part = "before " + " ".join(words[:8]) + " after"
    docs = spark.createDataFrame([(1, noisy), (2, part), (3, "no licence here")], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert found[1].labels == [label] and found[1].base_labels == []
    span = found[1].spans[0]
    assert (span.first, span.last) == (3, 3 + len(licenses.words_of(body))) and span.covered > 0.95
    assert found[2].labels == [] and found[3].score == 0.0
    assert 0.9 < found[1].score <= 1.0


def test_matching_statistics_against_brute_force():
    rng = random.Random(11)
    letters = [b"a", b"b", b"c"]
    templates = [("t", " ".join(rng.choice("abc") for _ in range(30))), ("u", " ".join(rng.choice("abc") for _ in range(20)))]
    scan = licenses.Scanner(templates, {}, 0.5)
    scan.least = 1
    pieces = {tuple(t.split()[i:j]) for _, t in templates for i in range(30) for j in range(i + 1, 31) if t.split()[i:j]}
    for _ in range(50):
        words = [rng.choice(letters) for _ in range(25)]
        plain = tuple(w.decode() for w in words)
        expected = []
        size = 0
        for at in range(len(plain)):
            longest = max(k for k in range(at + 2) if k == 0 or plain[at + 1 - k : at + 1] in pieces)
            if at and longest <= size and size:
                expected.append((size, at - 1))
            size = longest
        if size:
            expected.append((size, len(plain) - 1))
        assert [(n, last) for _, n, last in scan.matches(words)] == expected
