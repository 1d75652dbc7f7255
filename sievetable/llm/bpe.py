"""Byte-level BPE: encode and decode whole texts.

A word's parts stand in one contiguous array of ids beside an array of the merge
ranks of neighbours. The smallest rank is looked for again and again; its right
boundary is deleted and the two ranks beside it are looked up anew. Words beyond
``SHORT_PARTS`` bytes, where scanning would be quadratic, keep the same arrays as
a linked list under a heap and give the same parts.

Null texts are empty. An empty text has no ids. Row order, repeated rows and other
columns have no influence: each row is encoded on its own.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the public byte-level vocabularies split a text; a fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SHORT_PARTS = 256
CACHED_WORDS = 200_000
CACHED_BYTES = 64
ROWS_OUT = 500
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = [""] * 256
    for byte in plain:
        letters[byte] = chr(byte)
    other = 0x100
    for byte in range(256):
        if not letters[byte]:
            letters[byte] = chr(other)
            other += 1
    return letters


class Vocabulary:
    """Merge ranks, ids and bytes of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        ids: dict[str, int] = content["model"]["vocab"]
        self.first = [ids[letter] for letter in letters]
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(WORDS)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def parts(self, word: bytes) -> list[int]:
        """Ids of the parts that are left when no neighbours merge any more."""
        ids = [self.first[byte] for byte in word]
        return self._scan(ids) if len(ids) <= SHORT_PARTS else self._queue(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        none = (NO_RANK, -1)
        get = self.merges.get
        following = [get(pair, none) for pair in zip(ids, ids[1:])]
        while following:
            best = min(following)
            if best[0] == NO_RANK:
                break
            at = following.index(best)
            ids[at] = best[1]
            del ids[at + 1], following[at]
            if at:
                following[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(following):
                following[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _queue(self, ids: list[int]) -> list[int]:
        size = len(ids)
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        merges = self.merges
        queue = []
        for at in range(size - 1):
            if (found := merges.get((ids[at], ids[at + 1]))) is not None:
                queue.append((found[0], at, ids[at], ids[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, merged = heapq.heappop(queue)
            next_at = after[at]
            if ids[at] != left or next_at < 0 or ids[next_at] != right:
                continue
            ids[at], ids[next_at] = merged, -1
            after[at] = after[next_at]
            if after[at] >= 0:
                before[after[at]] = at
            for start in (before[at], at):
                end = after[start] if start >= 0 else -1
                if end >= 0 and (found := merges.get((ids[start], ids[end]))) is not None:
                    heapq.heappush(queue, (found[0], start, ids[start], ids[end], found[1]))
        return [i for i in ids if i >= 0]

    def packed(self, word: str) -> bytes:
        """The word's ids as little-endian unsigned 32-bit integers."""
        found = self.cache.get(word)
        if found is None:
            raw = word.encode("utf-8")
            found = b"".join(i.to_bytes(4, "little") for i in self.parts(raw))
            if len(raw) <= CACHED_BYTES:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed; strings of special tokens become their ids."""
        pieces = self.specials.split(text) if self.specials and self.specials.search(text) else [text]
        out = []
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            else:
                out.extend(map(self.packed, self.words.findall(piece)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = memoryview(packed).cast("I") if packed else []
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of ``path``, loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) for every row of ``docs``.

    ``ids`` are packed little-endian unsigned 32-bit integers, ``decoded`` is what
    they decode to. ``path`` names the vocabulary file on every machine.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for frame in frames:
            for start in range(0, len(frame), ROWS_OUT):
                part = frame.iloc[start : start + ROWS_OUT]
                ids = [words.encode(text) for text in part["text"]]
                yield pd.DataFrame({
                    "id": part["id"].array,
                    "n_tokens": pd.array([len(x) // 4 for x in ids], dtype="int64"),
                    "ids": ids,
                    "decoded": [words.decode(x) for x in ids],
                })

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = narrow.mapInPandas(run, f"id {kind}, n_tokens long, ids binary, decoded string")
    return done.withColumnRenamed("id", id_col)
