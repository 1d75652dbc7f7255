"""Licence scan: matching statistics of texts against a suffix automaton of licence words.

All templates go into one generalised suffix automaton over words. A file's words
stream through it once; after each word the automaton holds the longest piece of any
template that ends there. A piece that can't be extended is a match. Long matches of
one template are chained while they advance in both texts, and a chain that covers
enough of its template is a span.

Null texts are empty: no words, no labels, score 0. Each row is scanned on its own, so
repeated rows give repeated results and other columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels; fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licence texts and notices by label; fixed values.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", "Released under the MIT License."),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version."""),
    ("agpl", """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of
this license, visit http://creativecommons.org/licenses/by/4.0/"""),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights
to this work."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""),
    ("proprietary", """All rights reserved. No part of this work may be reproduced without the prior written permission
of the copyright holder."""),
]

#: What a byte becomes before words are split: letters in lower case, other ASCII but digits a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
MATCH_WORDS = 4
GAP_WORDS = 8
COVERED_SHARE = 0.6
ROWS_OUT = 2000


def words_of(text: str) -> list[bytes]:
    """Runs of a-z (A-Z in lower case), 0-9 and characters beyond ASCII."""
    return text.encode("utf-8").translate(FOLD).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, at: int, word: int, child: int) -> int:
        """A state for the part of ``child`` that is as long as ``at`` and one word."""
        copy = self._state(self.length[at] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while at >= 0 and self.next[at].get(word) == child:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        child = self.next[last].get(word)
        if child is not None:
            return child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            child = self.next[at][word]
            whole = self.length[child] == self.length[at] + 1
            self.link[new] = child if whole else self._split(at, word, child)
        return new

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for end, word in enumerate(words):
            last = self._extend(last, word)
            self.ends[last].setdefault(template, end)

    def spread(self) -> None:
        """Give each state the templates of the longer pieces that end with its own."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for template, end in self.ends[state].items():
                self.ends[self.link[state]].setdefault(template, end)


class Scanner:
    """Finds template spans and base phrases in texts."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], share: float) -> None:
        self.labels = [label for label, _ in templates]
        self.share = share
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = Automaton()
        self.sizes = []
        for number, (_, text) in enumerate(templates):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            self.sizes.append(len(ids))
            self.automaton.add(number, ids)
        self.automaton.spread()
        self.least = min([MATCH_WORDS, *self.sizes])
        self.phrases = [(b" " + phrase.encode() + b" ", label) for phrase, label in phrases.items()]

    def base(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
        """Places of the phrases, the first and the last start, and their labels."""
        joined = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = joined.find(phrase, at + 1)
        if not places:
            return 0, None, None, labels
        return len(places), joined.count(b" ", 0, min(places)), joined.count(b" ", 0, max(places)), labels

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(state, length, last word) of each piece that the following word doesn't extend."""
        following, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state = size = 0
        known = self.vocabulary.get
        for at, word in enumerate(map(known, words)):
            if word is not None and word in following[state]:
                state = following[state][word]
                size += 1
                continue
            if size >= self.least:
                yield state, size, at - 1
            if word is None:
                state = size = 0
                continue
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if word in following[state]:
                state = following[state][word]
                size += 1
        if size >= self.least:
            yield state, size, len(words) - 1

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share) of chains that cover enough."""
        chains: dict[int, tuple[int, int, int, int]] = {}
        done = []

        def close(template: int) -> None:
            first, last, _, covered = chains.pop(template)
            share = covered / self.sizes[template]
            if share >= self.share:
                done.append((template, first, last, min(1.0, share)))

        for state, size, last in self.matches(words):
            for template, end in self.automaton.ends[state].items():
                first, begin = last - size + 1, end - size + 1
                if template in chains:
                    start, before, reached, covered = chains[template]
                    overlap = max(0, before - first + 1, reached - begin + 1)
                    ahead = first + overlap - before - 1
                    jump = begin + overlap - reached - 1
                    if end > reached and overlap < size and ahead <= GAP_WORDS and jump <= GAP_WORDS:
                        chains[template] = (start, last, end, covered + size - overlap)
                        continue
                    close(template)
                chains[template] = (first, last, end, size)
        for template in list(chains):
            close(template)
        return sorted(done, key=lambda x: (x[1], x[2], x[0]))


_BUILT: dict[tuple, Scanner] = {}


def scanner(templates: list[tuple[str, str]], phrases: dict[str, str], share: float) -> Scanner:
    """The scanner for these templates, built once in a process."""
    key = (tuple(templates), tuple(phrases.items()), share)
    if key not in _BUILT:
        _BUILT[key] = Scanner(templates, phrases, share)
    return _BUILT[key]


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    share: float = COVERED_SHARE,
) -> DataFrame:
    """Base phrases and covered template spans of every row.

    Returns the id, n_words, n_base, first_word, last_word, base_labels (array),
    labels (array), score and spans (array of label, first, last, covered). ``share``
    is how much of a template a chain has to cover. ``score`` is 1 with a base phrase,
    else the largest covered share.
    """
    chosen, named = templates or TEMPLATES, phrases or PHRASES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = scanner(chosen, named, share)
        for frame in frames:
            for start in range(0, len(frame), ROWS_OUT):
                part = frame.iloc[start : start + ROWS_OUT]
                rows = []
                for text in part["text"]:
                    words = words_of(text)
                    n_base, first, last, base = find.base(words)
                    spans = [
                        {"label": find.labels[t], "first": a, "last": b, "covered": c}
                        for t, a, b, c in find.spans(words)
                    ]
                    labels = base | {s["label"] for s in spans}
                    score = 1.0 if n_base else max((s["covered"] for s in spans), default=0.0)
                    rows.append((len(words), n_base, first, last, sorted(base), sorted(labels), score, spans))
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
                out = pd.DataFrame(rows, columns=names)
                for name in ("first_word", "last_word"):
                    out[name] = out[name].astype("Int64")
                out.insert(0, "id", part["id"].array)
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = narrow.mapInPandas(
        run,
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>,"
        " labels array<string>, score double,"
        " spans array<struct<label: string, first: long, last: long, covered: double>>",
    )
    return done.withColumnRenamed("id", id_col)
