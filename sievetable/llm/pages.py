"""Main text of web pages by a conditional random field over their text blocks.

A page's markup is read into its leaf blocks in order. Each block has features from its
ancestors' tags, classes and roles and from its text; a linear-chain conditional random
field over "article" and "other" is trained on labelled pages and decoded by Viterbi.
Labelled pages are built from the layouts below and, of the given pages, at most
``MAX_PAGES`` (the first by a hash of their id) that mark their article with its own
element. Everything else reads all pages.

A null or empty page has an empty text, and so has one without an article. Character
references are decoded, white space inside a block becomes one space, blocks are joined
by a line break. Each page is read on its own; repeated rows have equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 300
BUILT_PAGES = 160
STEPS, RATE, RIDGE = 150, 0.15, 1e-3
ROWS_OUT = 500

#: Elements by how they are read; fixed values.
SILENT = {"script", "style", "template", "noscript", "svg", "iframe", "object", "canvas"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var".split()
)
CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
CLOSES_P = set(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
#: Words and marks of text that is about the page rather than in the article.
CUES = re.compile(
    r"©|copyright|cookie|privacy|subscri|newsletter|sign up|log ?in|share|comment|repl(?:y|ies)|advert|sponsor"
    r"|related|rights reserved|search|menu|click|follow us",
    re.IGNORECASE,
)
CUE_CHARACTERS = 300
NOT_ARTICLE = {"nav", "aside", "footer", "form", "head", "button", "select", "menu", "dialog"}
NOT_CLASS = set("ad ads advert advertisement comment comments sidebar promo cookie share related footer nav menu".split())


@dataclass
class Block:
    """A leaf block: its text, its open elements and how much of it is links."""

    words: list[str] = field(default_factory=list)
    path: tuple[tuple[str, frozenset, bool | None], ...] = ()
    linked: int = 0
    text: str = ""


class BlockReader(HTMLParser):
    """Reads markup, also broken markup, into leaf blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset, bool | None]] = []
        self.blocks: list[Block] = []
        self.now: Block | None = None
        self.silent = ""

    def ended(self) -> None:
        if self.now is not None:
            self.now.text = " ".join("".join(self.now.words).split())
            if self.now.text:
                self.blocks.append(self.now)
        self.now = None

    def close(self) -> None:
        super().close()
        self.ended()

    def leave(self, tag: str, borders: frozenset = frozenset()) -> None:
        """Close the innermost open ``tag``, with what is inside it."""
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                if any(n not in INLINE for n, _, _ in self.open[at:]):
                    self.ended()
                del self.open[at:]
                return
            if name in borders:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            return
        if tag == "br" or tag == "wbr":
            self.handle_data(" " if tag == "br" else "")
            return
        if tag in SILENT:
            self.silent = tag
            return
        if tag in CLOSES_P:
            self.leave("p", frozenset({"article", "section", "div", "td", "li", "button"}))
        if tag in CLOSED_BY_SAME:
            self.leave(tag, frozenset({"ul", "ol", "dl", "table", "select"}))
        if tag not in INLINE:
            self.ended()
        if tag in VOID:
            return
        given = dict(attrs)
        named = " ".join(filter(None, (given.get(n) for n in ("class", "id", "role", "itemprop", "aria-label"))))
        marks = {m for m in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()) if m}
        if "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", ""):
            marks.add("hidden")
        truth = given.get("data-main")
        self.open.append((tag, frozenset(marks), None if truth is None else truth == "1"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SILENT:
            self.handle_endtag(tag)
        elif tag in SILENT:
            self.silent = ""

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent:
                self.silent = ""
            return
        self.leave(tag)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.now is None:
            if not data.strip():
                return
            self.now = Block(path=tuple(self.open))
        self.now.words.append(data)
        if any(tag == "a" for tag, _, _ in self.open):
            self.now.linked += len(data)


def blocks_of(html: str) -> list[Block]:
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    return reader.blocks


def bucket(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= edge for edge in edges)


@lru_cache(maxsize=4096)
def outer_features(path: tuple[tuple[str, frozenset, bool | None], ...]) -> frozenset[str]:
    """Names of what is true of a block's ancestors."""
    outer = [(tag, marks) for tag, marks, _ in path if tag not in INLINE]
    out = {"always", "tag " + (outer[-1][0] if outer else "")}
    out |= {f"in {tag}" for tag, _ in outer}
    out |= {f"is {m}" for _, marks in outer for m in marks}
    return frozenset(out)


def features(block: Block, at: int, total: int) -> list[str]:
    """Names of what is true of a block."""
    text = block.text
    out = set(outer_features(block.path))
    out.add(f"length {bucket(len(text), (15, 40, 100, 300))}")
    out.add(f"links {bucket(block.linked / max(1, len(text)), (0.01, 0.3, 0.9))}")
    out.add(f"commas {bucket(text.count(','), (1, 3))}")
    out.add(f"ends {text[-1:] in '.!?…'}")
    out.add(f"place {bucket(at / max(1, total), (0.1, 0.9))}")
    if len(text) < CUE_CHARACTERS:
        out |= {"cue " + m[0].lower() for m in CUES.finditer(text)}
    return list(out)


class Field:
    """Linear-chain conditional random field over two labels."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.steps = np.zeros((2, 2))
        self.first = np.zeros(2)

    def emissions(self, page: list[list[str]]) -> np.ndarray:
        """How much each block's features speak for the article."""
        known = self.places.get
        weights = self.weights
        return np.array([weights[sorted(i for i in map(known, names) if i is not None)].sum() for names in page])

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]]) -> None:
        """Maximise the conditional likelihood with Adam; pages are padded to one table."""
        names = sorted({n for page in pages for block in page for n in block})
        self.places = {n: i for i, n in enumerate(names)}
        longest = max(map(len, pages))
        mask = np.zeros((len(pages), longest), bool)
        truth = np.zeros((len(pages), longest), np.int64)
        cells, ids = [], []
        for p, (page, marks) in enumerate(zip(pages, labels)):
            mask[p, : len(page)] = True
            truth[p, : len(page)] = marks
            for b, block in enumerate(page):
                cells += [p * longest + b] * len(block)
                ids += [self.places[n] for n in block]
        cells, ids = np.array(cells), np.array(ids)
        theta = np.zeros(len(names) + 6)
        mean, spread = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            weights, moves, first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            scores = np.bincount(cells, weights[ids], len(pages) * longest).reshape(len(pages), longest)
            gradient = self._gradient(scores, moves, first, mask, truth, cells, ids, len(names))
            gradient = gradient / len(pages) - RIDGE * theta
            mean = 0.9 * mean + 0.1 * gradient
            spread = 0.999 * spread + 0.001 * gradient**2
            theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        self.weights, self.steps, self.first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]

    @staticmethod
    def _gradient(scores, moves, first, mask, truth, cells, ids, size) -> np.ndarray:
        pages, longest = scores.shape
        emit = np.stack([np.zeros_like(scores), scores], axis=-1)
        ahead = np.zeros((pages, longest, 2))
        behind = np.zeros((pages, longest, 2))
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        surplus = np.where(mask, truth - single[..., 1], 0).ravel()
        out = np.zeros(size + 6)
        out[:size] = np.bincount(ids, surplus[cells], size)
        both = mask[:, 1:]
        pair = ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(pair) * both[..., None, None]).sum(axis=(0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        out[size : size + 4] = (seen - expected).ravel()
        out[size + 4 :] = np.bincount(truth[:, 0], minlength=2) - single[:, 0].sum(axis=0)
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        scores = self.emissions(page)
        best = self.first + np.array([0.0, scores[0]])
        back = []
        for score in scores[1:]:
            reach = best[:, None] + self.steps
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0) + np.array([0.0, score])
        labels = [int(best.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


#: Layouts for labelled pages: what holds articles, and what stands before, in and after them.
HOLDERS = [
    "<article>{}</article>", "<main>{}</main>", "<main><article class='post'>{}</article></main>",
    "<div class='content'>{}</div>", "<div id='main-content'><div class='post-body'>{}</div></div>",
    "<div class='entry-content'>{}</div>", "<section class='article-body'>{}</section>",
    "<div class='story' itemprop='articleBody'>{}</div>", "<table><tr><td id='content'>{}</td></tr></table>",
    "<div role='main'>{}</div>", "<div class='page'><div class='text'>{}</div></div>",
]
BEFORE = [
    "<nav><ul><li><a href='/'>{w}</a></li><li><a href='/a'>{w}</a></li><li><a href='/b'>{w}</a></li></ul></nav>",
    "<header class='site-header'><h1>{w}</h1><p>{s}</p></header>", "<div id='header'><a href='/'>{w}</a> <span>{s}</span></div>",
    "<div class='menu'><a href='/'>{w}</a> | <a href='/x'>{w}</a></div>", "<div class='cookie-notice'><p>{s}</p></div>",
    "<div class='notice banner'>{s}</div>", "<div class='ad'>{s}</div>", "<div class='advertisement'><p>{s} {s}</p></div>",
    "<form class='search'><label>Search</label><input name=q><button>{w}</button></form>",
    "<div class='breadcrumb'><a href='/'>{w}</a> &gt; <a href='/c'>{w}</a></div>",
    "<aside class='sidebar'><h3>{w}</h3><p>{s}</p><ul><li><a href='/r'>{s}</a></li></ul></aside>",
    "<div id='sidebar'><h3>{w}</h3><p>{s}</p></div>", "<div role='banner'><p>{s}</p></div>", "<ul class='topnav'><li><a href='/'>{w}</a></li></ul>",
]
INSIDE = [
    "<div class='ad'>{s}</div>", "<aside><p>{s}</p></aside>", "<div class='promo'><p>{s}</p><p>{s}</p></div>", "<nav class='toc'><a href='#a'>{w}</a></nav>",
    "<form><p>{s}</p><button>{w}</button></form>", "<div class='share'><a href='/s'>{w}</a></div>", "<div class='related'><h3>{w}</h3><a href='/r'>{s}</a></div>",
    "<section class='comments'><h2>Comments</h2><div class='comment'><p>{s}</p></div><div class='comment'><p>{s} {s}</p></div></section>",
]
AFTER = [
    "<footer>&copy; {w} &middot; {s}</footer>", "<footer><p>{s}</p><a href='/p'>{w}</a></footer>", "<div id='footer'><p>{s}</p></div>",
    "<section id='comments'><h2>{w}</h2><div class='comment'><p>{s}</p><p>{s} {s}</p></div></section>",
    "<ol class='commentlist'><li><p>{s}</p></li><li><p>{s}</p></li></ol>", "<div class='comments-area'><article class='comment'><p>{s}</p></article></div>",
    "<div class='newsletter'><form><p>{s}</p><input type=email></form></div>", "<div class='share-buttons'><a href='/s'>{w}</a></div>",
    "<div class='related-posts'><h3>{w}</h3><ul><li><a href='/1'>{s}</a></li></ul></div>", "<aside><h3>{w}</h3><p>{s}</p></aside>",
    "<div class='widget'><p>{s}</p></div>",
]
ARTICLE = [
    "<h1>{w} {w}</h1>", "<h2>{w}</h2>", "<p>{s}</p>", "<p>{s} {s} {s}</p>", "<p>{w}.</p>", "<p>{s} <a href='/l'>{w}</a> {s}</p>",
    "<ul><li>{s}</li><li>{w}</li></ul>", "<blockquote><p>{s}</p></blockquote>", "<p><b>{s}<br><p>{s}", "<table><tr><td>{w}</td><td>{w}</td></tr></table>",
    "<pre>{s}</pre>", "<figure><figcaption>{s}</figcaption></figure>", "<header><h1>{w} {w}</h1></header>", "<div>{s} {s}</div>", "<section><p>{s}</p></section>",
]
WORDS = "stone river letter morning garden window winter market bridge history maison lettre route weg haus stadt casa".split()


def built_pages(count: int = BUILT_PAGES, seed: int = 7) -> list[str]:
    """Labelled pages in all layouts; ``data-main`` marks what is article and what is not."""
    rng = np.random.default_rng(seed)

    def word(_: re.Match) -> str:
        return str(rng.choice(WORDS)).capitalize()

    def sentence(_: re.Match) -> str:
        words = " ".join(rng.choice(WORDS, rng.integers(3, 18)))
        return words.capitalize() + rng.choice([".", ".", ", " + str(rng.choice(WORDS)) + ".", "!", ""])

    def filled(parts: list[str]) -> str:
        return re.sub(r"\{s\}", sentence, re.sub(r"\{w\}", word, "".join(parts)))

    def some(options: list[str], low: int, high: int) -> list[str]:
        return [str(x) for x in rng.choice(options, rng.integers(low, high))]

    pages = []
    for number in range(count):
        body = some(ARTICLE, 2, 9)
        for extra in some(INSIDE, 0, 3):
            body.insert(int(rng.integers(1, len(body) + 1)), f"<div data-main='0'>{extra}</div>")
        held = HOLDERS[number % len(HOLDERS)].replace("{}", "<div data-main='1'>" + "".join(body) + "</div>")
        parts = ["<html><head><title>{w} {w}</title></head><body>", *some(BEFORE, 0, 5), held, *some(AFTER, 0, 5)]
        pages.append(filled([*parts, "</body></html>"]))
    return pages


def true_labels(blocks: list[Block]) -> list[int]:
    """Labels from ``data-main``: the innermost mark counts."""
    return [int(next((m for _, _, m in reversed(b.path) if m is not None), False)) for b in blocks]


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article with its own element, else None."""
    inside = [any(tag in ("article", "main") for tag, _, _ in b.path) for b in blocks]
    if not any(inside):
        return None
    other = [any(tag in NOT_ARTICLE or marks & NOT_CLASS for tag, marks, _ in b.path) for b in blocks]
    return [int(a and not o) for a, o in zip(inside, other)]


def trained(pages: list[str]) -> Field:
    """A field fitted on built pages and on those of ``pages`` that mark their article."""
    rows, labels = [], []
    for html, label in [*((p, true_labels) for p in built_pages()), *((p, marked_labels) for p in pages)]:
        blocks = blocks_of(html)
        marks = label(blocks) if blocks else None
        if marks is not None:
            rows.append([features(b, i, len(blocks)) for i, b in enumerate(blocks)])
            labels.append(marks)
    field_ = Field()
    field_.fit(rows, labels)
    return field_


def main_text(model: Field, html: str) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    labels = model.decode([features(b, i, len(blocks)) for i, b in enumerate(blocks)])
    return "\n".join(b.text for b, label in zip(blocks, labels) if label)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = MAX_PAGES) -> DataFrame:
    """(id, url, text) of every page; ``text`` is the article's."""
    known = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    # Ids are chosen before pages are fetched, so that tasks send few bytes to the driver.
    ids = known.where("id IS NOT NULL").select("id").distinct()
    chosen = ids.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most)
    sample = known.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html").alias("html"))
    model = trained([r["html"] for r in sample.orderBy("id").collect()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), ROWS_OUT):
                part = frame.iloc[start : start + ROWS_OUT]
                out = part[["id", "url"]].copy()
                out["text"] = [main_text(model, html) for html in part["html"]]
                yield out

    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(
        F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    return narrow.mapInPandas(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
