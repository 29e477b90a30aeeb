"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with a vector of hashed tags, classes and ids on
its path, hashed words, and a few shape figures. A bidirectional LSTM reads the sequence both ways and
labels each block in the light of the whole page; blocks labelled main make the text. The labeller
learns from pages that `practice_pages` writes and from a bounded sample of the table's own pages,
labelled by the meaning of their tags and class names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.bilstm import BiLstm, pad
from rastrel.llm.common import prepare, thin

#: Own pages that the labeller learns from at most, their size in characters at most, and written ones.
SAMPLE_PAGES, SAMPLE_CHARS, PRACTICE = 96, 60_000, 256
PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 64, 24, 9
#: Steps of all pages, padding included, that are labelled at once.
BATCH_STEPS = 60_000
#: Steps that the LSTM reads at a time of a page that is longer; its state goes on.
CHUNK_STEPS = 20_000
_REST = r"\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+"
# What the page does not show: comments, scripts, styles, the title of the head, and templates. Only the first three may
# run to the page's end without a closing tag; a start tag that closes itself hides nothing.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style|title|noscript|template)" + _REST + r"(?<=/)>|<(script|style|title)" + _REST + r">.*?(?:</\1\s*>|\Z)|<(noscript|template)" + _REST + r">.*?</\2\s*>"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:\bclass|\bid|\brole)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
#: HTML elements that begin a block, and those without content.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements and words of class names, ids and roles that mean something else than main text.
OTHER_TAGS = frozenset("nav header footer aside form button select option textarea fieldset menu dialog head".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion sidebar side menu nav navigation navbar navigator breadcrumb breadcrumbs footer foot header masthead topbar"
    " comment comments disqus reply replies respond cookie cookies consent notice alert popup modal newsletter subscribe signup login share sharing social related recommended tags widget"
    " pagination pager form search copyright legal".split()
)


class Node:
    """An open element: its tag and the words of its names, and what it and those around it say together.

    Paths share their beginnings, so a page costs a node for each element that it opens, however deep.
    """

    __slots__ = ("tag", "bits", "vector", "main", "other", "below")

    def __init__(self, tag: str, words: tuple, above: Node | None):
        self.tag, self.below = tag, {}
        self.main = bool(above and above.main) or tag in ("article", "main")
        self.other = bool(above and above.other) or tag in OTHER_TAGS or not OTHER_NAMES.isdisjoint(words)
        signs = [zlib.crc32(("<" + tag).encode()), *[zlib.crc32(("." + w).encode()) for w in words]] if tag else []
        self.bits = above.bits if above else 0
        for sign in signs:
            self.bits |= 1 << sign % PATH_DIMS
        self.vector = np.unpackbits(np.frombuffer(self.bits.to_bytes(PATH_DIMS // 8, "little"), dtype=np.uint8), bitorder="little").astype(np.float32)
        for sign in signs:
            self.vector[(sign >> 8) % PATH_DIMS] += 0.5  # the last step counts more

    def step(self, tag: str, words: tuple) -> Node:
        got = self.below.get((tag, words))
        if got is None:
            got = self.below[tag, words] = Node(tag, words, self)
        return got


class Leaf:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Node, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def leaves(page: str | None) -> list[Leaf]:
    """The blocks of text of a page in order, their references decoded and white space made single."""
    page = page or ""
    out: list[Leaf] = []
    stack: list[Node] = [Node("", (), None)]
    opened: Counter = Counter()
    parts: list[str] = []
    linked = anchors = last = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Leaf(stack[-1], text, linked))
        parts.clear()
        linked = 0

    def close() -> None:
        opened[stack.pop().tag] -= 1

    for m in _TAG.finditer(page):
        if m.start() > last:
            parts.append(page[last : m.start()])
            if anchors:
                linked += m.start() - last
        last = m.end()
        name = m.group(4) or m.group(7)
        if name is None:
            continue
        name = name.lower()
        ends = m.group(3) or m.group(6)
        if name == "a":
            anchors = 0 if ends else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if ends:
                if opened[name]:
                    while stack[-1].tag != name:
                        close()
                    close()
            elif name not in VOID:
                if stack[-1].tag in CLOSES.get(name, ()):
                    close()
                names = m.group(5) or m.group(8)
                stack.append(stack[-1].step(name, tuple(_WORD.findall(" ".join(_NAMES.findall(names)).lower())) if names else ()))
                opened[name] += 1
    if last < len(page):
        parts.append(page[last:])
    flush()
    return out


def vectors(blocks: list[Leaf], start: int = 0, end: int | None = None) -> np.ndarray:
    """A row for each of the page's blocks from start to end."""
    out_of, longest = len(blocks), max((len(b.text) for b in blocks), default=1)
    blocks = blocks[start:end]
    n = len(blocks)
    out = np.zeros((n, PATH_DIMS + WORD_DIMS + SHAPE_DIMS), dtype=np.float32)
    if not n:
        return out
    words = [b.text.split(" ") for b in blocks]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=n)
    signs = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for own in words for w in own), dtype=np.int64, count=int(counts.sum()))
    which = np.repeat(np.arange(n), counts)
    out[:, :PATH_DIMS] = [b.path.vector for b in blocks]
    hashed = np.bincount(which * WORD_DIMS + signs % WORD_DIMS, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = hashed / np.sqrt(counts)[:, None]
    lengths = np.fromiter((len(b.text) for b in blocks), dtype=np.float64, count=n)
    at = PATH_DIMS + WORD_DIMS
    out[:, at] = np.log1p(lengths) / 6
    out[:, at + 1] = np.minimum(1, np.fromiter((b.linked for b in blocks), dtype=np.float64, count=n) / np.maximum(1, lengths))
    out[:, at + 2] = np.fromiter((b.text[-1] in ".!?…:;\"”»" for b in blocks), dtype=np.float64, count=n)
    out[:, at + 3] = np.arange(start, start + n) / out_of
    out[:, at + 4] = np.log1p(counts) / 5
    out[:, at + 5] = np.fromiter((b.text.count(",") for b in blocks), dtype=np.float64, count=n) / counts
    out[:, at + 6] = lengths / longest
    out[:, at + 7] = np.fromiter(("©" in b.text or "|" in b.text for b in blocks), dtype=np.float64, count=n)
    out[:, at + 8] = np.fromiter((b.path.tag[:1] == "h" and b.path.tag[1:].isdigit() for b in blocks), dtype=np.float64, count=n)
    return out


def meaning(blocks: list[Leaf]) -> np.ndarray:
    """Labels by the meaning of tags and names on the path: 1 for main text."""
    inside = any(b.path.main for b in blocks)
    return np.array([(b.path.main or not inside) and not b.path.other for b in blocks], dtype=np.float32)


def label(pages: list[list[Leaf]], model: BiLstm) -> list[np.ndarray]:
    """The score of every block of every page; pages of like length are read together, a long one in chunks."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        k = 1
        while k < len(order) and (k + 1) * len(pages[order[k]]) <= BATCH_STEPS:
            k += 1
        own, order = order[:k], order[k:]
        if len(pages[own[0]]) > CHUNK_STEPS:
            page = pages[own[0]]
            out[own[0]] = model.long_scores(lambda a, b, page=page: vectors(page, a, b), len(page), CHUNK_STEPS)
            order = own[1:] + order
            continue
        for i, s in zip(own, model.scores(*pad([vectors(pages[i]) for i in own])), strict=True):
            out[i] = s[: len(pages[i])]
    return out


def practice_pages(n: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of invented words in many layouts, with each block's label."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er on st".split()]

    def words(k: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k)).capitalize()

    def text(short: bool) -> str:
        return words(r.randint(1, 5)) if short else ". ".join(words(r.randint(4, 18)) for _ in range(r.randint(1, 6))) + "."

    def links(k: int) -> tuple[str, int]:
        return "<ul>" + "".join(f'<li><a href="/{i}">{text(True)}</a></li>' for i in range(k)) + "</ul>", k

    pages = []
    for _ in range(n):
        page, label = ["<!DOCTYPE html><html><head><title>x</title></head><body>"], []

        def other(kind: str, page=page, label=label) -> None:
            body, k = {
                "list": lambda: links(r.randint(2, 9)), "line": lambda: (text(True), 1), "prose": lambda: (f"<p>{text(False)}</p>", 1), "bare": lambda: (text(False), 1),
                "many": lambda: ("".join(f"<div class='comment-body'><p>{text(False)}</p></div>" for _ in range(3)), 3),
            }[r.choice({"nav": ["list"], "foot": ["line", "list", "bare"], "ad": ["line", "bare", "prose"], "aside": ["list", "prose", "line"], "comments": ["many", "prose"], "notice": ["line", "bare", "prose"], "form": ["line"]}[kind])]()
            opening = r.choice({
                "nav": ["nav", "div class='menu'", "div id='navigation'", "nav class='navbar'", "header"], "foot": ["footer", "div class='footer'", "div id='footer'"],
                "ad": ["div class='ad'", "div class='ads'", "div class='advert'", "aside class='promo'", "div class='sponsored'"], "aside": ["aside", "div class='sidebar'", "div class='related'", "aside class='widget'"],
                "comments": ["section class='comments'", "div id='comments'", "section id='comments'"], "notice": ["div class='cookie notice'", "div class='alert'", "div role='dialog'", "div class='newsletter'"],
                "form": ["form", "form class='search'", "form id='subscribe'"],
            }[kind])
            page.append(f"<{opening}>{body}</{opening.split()[0]}>")
            label.extend([False] * k)

        for kind in ("notice", "nav", "ad", "form"):
            if r.random() < (0.8 if kind == "nav" else 0.35):
                other(kind)
        opening = r.choice(["article", "main", "div class='content'", "div id='content'", "section class='post'", "article class='entry'", "main><article", "div class='article-body'"])
        page.append(f"<{opening}>")
        if r.random() < 0.8:
            page.append(f"<h1>{text(True)}</h1>")
            label.append(True)
        for _ in range(r.randint(1, 14)):
            tag = r.choice(["p"] * 8 + ["h2", "blockquote", "li", "div", "pre"])
            page.append(f"<{tag}>{text(tag == 'h2' or r.random() < 0.1)}</{tag}>")
            label.append(True)
            if r.random() < 0.07:
                other(r.choice(["ad", "aside", "form", "notice"]))
        page.append("".join(f"</{x.split()[0]}>" for x in reversed(opening.split("><"))))
        for kind in ("comments", "aside", "ad", "foot"):
            if r.random() < (0.8 if kind == "foot" else 0.4):
                other(kind)
        page.append("</body></html>")
        pages.append(("".join(page), label))
    return pages


def learn(pages: DataFrame, html_col: str = "html", seed: int = 7) -> BiLstm:
    """Fit the labeller. Of the table, the SAMPLE_PAGES first pages in the order of a hash, none over SAMPLE_CHARS, take part."""
    page = F.col(html_col)
    own = thin(pages.select(page.alias("html")), F.xxhash64("html"), SAMPLE_PAGES, 4).where(F.octet_length("html") <= SAMPLE_CHARS).orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES).collect()
    data = []
    for text, label in [*practice_pages(PRACTICE), *[(r["html"], None) for r in own]]:
        blocks = leaves(text)
        if blocks:
            y = meaning(blocks) if label is None else np.array(label, dtype=np.float32)
            data += [(vectors(blocks)[a : a + 80], y[a : a + 80]) for a in range(0, len(blocks), 80)]
    return BiLstm(PATH_DIMS + WORD_DIMS + SHAPE_DIMS, seed=seed).fit(data)


def extract(pages: DataFrame, model: BiLstm, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; whole pages, one pass without a shuffle.

    What counts as shown is all text but that of scripts, styles, templates, comments and the head's title; a
    block scored 0.5 or more is main text. Null html is an empty page. Time and memory are linear in a page,
    however deep or long. A page without main blocks has an empty text. Repeated rows stay
    repeated, null ids and urls stay null, an empty table gives no rows, other columns are not read.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                blocks = [leaves(p.as_py()) for p in part.column(2)]
                text = ["\n".join(b.text for b, v in zip(own, s, strict=True) if v >= 0.5) for own, s in zip(blocks, label(blocks, model), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
