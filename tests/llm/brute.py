"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingle_set(text: str | None, size: int) -> frozenset:
    words = SPACES.findall((text or "").translate(ASCII))
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_components(rows: list[tuple], size: int, pct: int) -> list[int]:
    """The smallest id reachable from each (id, text) row."""
    sets = [shingle_set(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= pct * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (name, _) in enumerate(rows):
        least[top(i)] = min(name, least.get(top(i), name))
    return [least[top(i)] if sets[i] else rows[i][0] for i in range(len(rows))]


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """(id, n_words, n_hit, item ids, contaminated) of each (id, text) row."""
    windows = defaultdict(set)
    for item, text in items:
        words = LETTERS.findall((text or "").translate(ASCII))
        m = min(13, len(words))
        for i in range(len(words) - m + 1):
            if m:
                windows[tuple(words[i : i + m])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for name, text in docs:
        words = LETTERS.findall((text or "").translate(ASCII))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                if (here := windows.get(tuple(words[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= here
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        out.append((name, len(words), len(hit), sorted(found), bad))
    return out


def rule_figures(rows: list[tuple], share: float, least: int, most: int) -> list[tuple]:
    """Figures and verdicts of each (id, text, host) row."""

    def normal(line: str) -> str:
        return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")

    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        text, host = text or "", host or ""
        texts[host].add(text)
        for line in text.split("\n"):
            if SPACES.search(line):
                holders[host, normal(line)].add(text)
    out = []
    for name, text, host in rows:
        text, host = text or "", host or ""
        words = SPACES.findall(text)
        lines = [x for x in text.split("\n") if SPACES.search(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(grams)
        repeated = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
        removed = sum(
            len(SPACES.findall(x))
            for x in lines
            if least <= len(holders[host, normal(x)]) > min(share * len(texts[host]), most)
        )
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        kept = not failed and len(words) - removed >= 50 and 2 * removed <= len(words)
        out.append((
            name, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), removed, failed, kept,
        ))
    return out


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    each = [n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, digits[::-1]))]
    return sum(each) % 10 == 0


def private_spans(text: str | None) -> list[tuple]:
    def holds(kind: str, match: str) -> bool:
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [
        (k, m.start(), m.end()) for k, e in PRIVATE.items() for m in re.finditer(e, text or "") if holds(k, m[0])
    ]


def without_repeats(rows: list[tuple], length: int = 400) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, digest of what is kept) of each (id, text) row."""
    data = [(name, (text or "").encode()) for name, text in rows]
    counts = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for name, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = (b"\0" + bytes(gone)).count(b"\0\1")
        out.append((name, len(d), sum(gone), spans, sha(bytes(x for x, g in zip(d, gone) if not g))))
    return out
