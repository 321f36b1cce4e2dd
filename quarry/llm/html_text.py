"""Main text of web pages by the maximum-scoring subsequence.

A page is read once as a sequence of words and tags. Every word scores above zero: the squared probability
that a word stands in main text where it stands, by the marks of the elements around it. Every tag scores below
zero: the log-probability that such a tag, with its names, stands in main text. A linear scan finds the
contiguous region of the greatest sum, and only that region is read. Inside it, insets (an element whose
own marks say that it is an advert, a form, comments and the like within an article) are left out. What is
left is the text: character references decoded, white space within a block turned into one space, blocks
joined by line feeds.

All weights are learned from hand-made labelled pages (``_pages``): those of words by logistic regression
over the marks of the elements around them, those of tags and insets by counting. A mark is evidence and
never decides by itself. Marks of an element count the less, the more of the page's words it holds: names
on an outer wrapper tell nothing about its parts, and those on <html> and <body> are not read. Names after
words like "with" (``content-with-sidebar``) are marks of their own.

Nulls: null html counts as empty and gives an empty text; urls and identifiers pass through. Truncated
pages and unclosed elements are read as far as they go. Repeated rows are extracted each; extra columns
are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pages import labelled_pages

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption optgroup option select".split()
)
#: Elements without content, and elements whose content is not text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|audio|video|select|button"
#: Elements that stand for a space.
SPACED = frozenset("br td th".split())
#: Elements that name a part of a page, and other elements that tell something of their words.
PARTS = frozenset("nav header footer aside form menu dialog section article main".split())
TOLD = frozenset("a p li h1 h2 blockquote pre td".split())
#: Elements that end with the text before them where an article begins unclosed.
ENDED = PARTS - {"section", "article", "main"}
#: Words after which a name tells what is beside or missing.
BESIDE = frozenset("has with no without hide show".split())
#: Roles of page parts and the elements that stand for them.
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "search", "form": "form", "main": "main", "dialog": "dialog", "alert": "alert"}

_TOKEN = re.compile(
    rf"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?=>|\Z)|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_BROKEN = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Least mean probability of a region's words for it to be main text, share of a page's words from which
#: <article> or <main> elements tell of the words beside them, and the log-odds from which a part is an inset.
SURE, CORE, INSET = 0.25, 0.25, 1.0
#: How often a word of a heading counts: it stands for the text that it introduces.
HEADING = {"h1": 3, "h2": 2}
#: Weight of the tags' log-probabilities against the words' probabilities.
TAG = 0.5
#: How much the first parts of a compound name count.
MODIFIER = 0.7
#: Ridge of the regression, and log-odds of a tag never seen.
RIDGE, RARE = 0.3, -1.0


@dataclass
class Weights:
    """Log-odds: of words by the marks around them (and of none), of tags, of insets."""

    words: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    tags: dict[str, float] = field(default_factory=dict)
    insets: dict[str, float] = field(default_factory=dict)


@cache
def _names(attrs: str) -> tuple[tuple[str, float], ...]:
    """Marks of an element's class, id and role, and how much each counts. The last part of a name says
    what a thing is, those before it what it is of."""
    found: dict[str, float] = {}
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            found["." + ROLES.get(value.lower(), value.lower())] = 1.0
            continue
        for name in value.split():
            parts, beside = _PART.findall(_CAMEL.sub(" ", name).lower()), ""
            for k, part in enumerate(parts, 1):
                mark = f".{beside}{part}"
                found[mark] = max(found.get(mark, 0.0), 1.0 if k == len(parts) else MODIFIER)
                beside = beside or ("with:" if part in BESIDE else "")
    return tuple(found.items())


class Element:
    __slots__ = ("inner", "marks", "odds", "parent", "tag", "words")

    def __init__(self, tag: str, marks: tuple[tuple[str, float], ...], parent: Element | None):
        self.tag, self.parent, self.words, self.odds = tag, parent, 0, 0.0
        self.inner = parent is not None and (parent.inner or parent.tag in ("article", "main"))
        own = tag
        if self.inner and tag in ("header", "footer"):  # a part of the article
            own = f"article>{tag}"
        elif tag == "a" and parent is not None and parent.tag in ("p", "dd", "td", "blockquote"):  # in running text
            own = "p>a"
        self.marks = ((own, 1.0), *marks)

    @property
    def holds(self) -> bool:
        return self.inner or self.tag in ("article", "main")


def _forget(size: int = 100_000) -> None:
    if _names.cache_info().currsize > size:
        _names.cache_clear()


class Page:
    """A page as events: ("tag", name, element, whether it opens one), ("text", run, element, words), and
    ("note", comment, None, 0)."""

    def __init__(self, page: str):
        self.root = Element("", (), None)
        self.elements = [self.root]
        self.events: list[tuple] = []
        self._read(page)
        for e in reversed(self.elements):  # parents come first
            if e.parent is not None:
                e.parent.words += e.words

    def core(self, insets: dict[str, float]) -> bool:
        """Whether <article> and <main> elements that look like no insets hold a good part of the words."""
        held, out = 0, {id(self.root): False}
        for e in self.elements[1:]:
            out[id(e)] = out[id(e.parent)] or _inset(e, insets)
            if e.holds and not e.parent.holds and not out[id(e)]:
                held += e.words
        return held > CORE * self.root.words

    def _text(self, run: str, at: Element) -> None:
        n = len(run.split())
        if n:
            n = max(n, len(run) // 12)  # scripts that write no spaces
            at.words += n
        self.events.append(("text", run, at, n))

    def _read(self, page: str) -> None:
        at, stack, put = 0, [self.root], self.events.append
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()], stack[-1])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["comment"] is not None:
                    put(("note", m["comment"], None, 0))
                elif m["raw"] is not None:
                    put(("tag", m["raw"].lower(), stack[-1], False))
                continue
            tag = tag.lower()
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                put(("tag", tag, stack[-1], False))
                continue
            if tag in ("article", "main") and not any(e.tag == "article" for e in stack):
                for k, e in enumerate(stack):  # an unclosed part ends here
                    if e.tag in ENDED:
                        del stack[k:]
                        break
            attrs = m["attrs"] or ""
            if tag in VOID or attrs.endswith("/"):
                put(("tag", tag, stack[-1], False))
                continue
            if tag == "p":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in BLOCKS:
                        if stack[k].tag == "p":
                            del stack[k:]
                        break
            e = Element(tag, _names(attrs) if "=" in attrs and tag not in ("html", "body") else (), stack[-1])
            self.elements.append(e)
            stack.append(e)
            put(("tag", tag, e, True))
        if at < len(page):
            self._text(_BROKEN.sub("", page[at:]), stack[-1])


def _telling(e: Element, whole: int) -> Iterator[tuple[str, float]]:
    """Marks of an element that tell of its words, and how much each counts: names and <form> count the
    less, the more of the page the element holds."""
    share = 1 - (e.words / whole) ** 4 if whole else 0.0
    for mark, v in e.marks:
        if mark[:1] == "." or mark == "form":
            yield mark, share * v
        elif mark in PARTS or mark in TOLD or ">" in mark:
            yield mark, 1.0


def _parts(e: Element) -> list[tuple[str, float]]:
    """Marks of an element that can make it an inset."""
    return [(m, v) for m, v in e.marks if m[:1] == "." or m in PARTS or ">" in m]


def _inset(e: Element, insets: dict[str, float]) -> bool:
    return sum(insets.get(m, 0.0) * v for m, v in _parts(e)) > INSET


def _labels(page: Page) -> Iterator[tuple[tuple, bool]]:
    main = False
    for event in page.events:
        if event[0] == "note":
            main = {"main": True, "/main": False}.get(event[1], main)
        yield event, main


@cache
def learned() -> Weights:
    """Weights from the labelled pages."""
    pages = [Page(p) for p in labelled_pages()]
    runs_of: list[list[tuple[Page, Element, bool, int]]] = []
    seen_in, seen_out, cut, kept = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        runs_of.append([])
        runs = list(_labels(page))
        marked = [k for k, (_, main) in enumerate(runs) if main]
        first, last = (marked[0], marked[-1]) if marked else (0, -1)
        inside = Counter()  # words of main text in each element
        for k, ((kind, what, e, n), main) in enumerate(runs):
            if kind == "tag":
                for mark, v in e.marks if n else ((what, 1.0),):
                    (seen_in if first <= k <= last else seen_out)[mark] += v
            elif kind == "text" and n:
                up = e
                while up.parent is not None:
                    inside[id(up)] += n * main
                    up = up.parent
                runs_of[-1].append((page, e, main, n))
        for k, ((kind, _, e, n), _) in enumerate(runs):
            if kind == "tag" and n and e.words:
                for mark, v in _parts(e):
                    if first <= k <= last or mark[0] == ".":  # of unnamed parts, those in the region tell
                        (kept if inside[id(e)] else cut)[mark] += v
    odds = lambda a, b: {m: log((a[m] + 0.5) / (b[m] + 0.5)) for m in {*a, *b}}
    insets = odds(cut, kept)
    rows: list[tuple[Counter, bool, int]] = []
    for runs in runs_of:
        core = runs[0][0].core(insets)
        for page, e, main, n in runs:
            found = Counter({"~": 1.0} if core and not e.holds else {})
            while e.parent is not None:
                for mark, v in _telling(e, page.root.words):
                    found[mark] += v
                e = e.parent
            rows.append((found, main, n))
    marks = sorted({m for found, _, _ in rows for m in found})
    column = {m: k + 1 for k, m in enumerate(marks)}
    x = np.zeros((len(rows), len(marks) + 1))
    x[:, 0] = 1
    for row, (found, _, _) in zip(x, rows, strict=True):
        for m, v in found.items():
            row[column[m]] = v
    y = np.array([main for _, main, _ in rows], float)
    w = _regress(x, y, np.array([n for *_, n in rows], float) ** 0.5)
    return Weights(dict(zip(marks, w[1:].tolist(), strict=True)), float(w[0]), odds(seen_out, seen_in), insets)


def _regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column, the constant, is free."""
    ridge = np.diag([1e-6] + [RIDGE] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 0.5 * np.tanh(0.5 * (x @ w)) + 0.5
        grad = x.T @ (weight * (y - p)) - ridge @ w
        h = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + ridge
        step = np.linalg.solve(h, grad)
        w += step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    return w


def scores(page: Page, w: Weights) -> Iterator[tuple[float, float]]:
    """Score of every event, and the probability that its words are main text."""
    whole, words = page.root.words, w.words
    page.root.odds = w.bias
    for e in page.elements[1:]:
        e.odds = e.parent.odds + sum(words.get(m, 0.0) * v for m, v in _telling(e, whole))
    beside = words.get("~", 0.0) if page.core(w.insets) else 0.0  # beside the page's articles
    for kind, what, e, n in page.events:
        if kind == "tag":
            odds = sum(w.tags.get(m, 0.0) * v for m, v in e.marks) if n else w.tags.get(what, RARE)
            yield -TAG * log1p(exp(min(50.0, odds))), 0.0
        elif kind == "text" and n:
            odds = e.odds + (0.0 if e.holds else beside)
            p = 1 / (1 + exp(-max(-500.0, min(500.0, odds))))
            yield n * p * p * HEADING.get(e.tag, 1), p  # squared: doubtful words add up to little
        else:
            yield 0.0, 0.0


def region(page: Page, w: Weights) -> tuple[int, int]:
    """First and last event of the contiguous region of the greatest sum; (0, -1) if there is none."""
    total = low = best = said = held = low_said = low_held = sure = 0.0
    first, span = 0, (0, -1)  # event after the least running sum so far, and the best region
    for k, (score, p) in enumerate(scores(page, w)):
        if not p:
            total += score
            continue
        if total <= low:
            low, first, low_said, low_held = total, k, said, held
        n = page.events[k][3]
        total, said, held = total + score, said + n * p, held + n
        if total - low > best:
            best, span, sure = total - low, (first, k), (said - low_said) / (held - low_held)
    return span if sure >= SURE else (0, -1)


def insets(page: Page, span: tuple[int, int], w: Weights) -> set[int]:
    """Elements that begin within the region and whose own marks say that they are insets."""
    found: set[int] = set()
    for kind, _, e, n in page.events[span[0] : span[1] + 1]:
        if kind == "tag" and n and (id(e.parent) in found or _inset(e, w.insets)):
            found.add(id(e))
    return found


def read(page: Page, span: tuple[int, int], out: set[int]) -> str:
    """Text of the blocks that the region touches, without the elements of ``out``."""
    first, last = span
    if last < first:
        return ""
    edge = lambda k: page.events[k][0] == "tag" and page.events[k][1] in BLOCKS
    while first and not edge(first - 1):
        first -= 1
    while last + 1 < len(page.events) and not edge(last + 1):
        last += 1
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(text)

    for kind, what, e, _ in page.events[first : last + 1]:
        if kind == "tag":
            if what in BLOCKS or id(e) in out:
                close()
            elif what in SPACED and parts:
                parts.append(" ")
        elif kind == "text":
            if id(e) in out:
                close()
            elif parts or what.strip():
                parts.append(html.unescape(what))
    close()
    return "\n".join(blocks)


def extract(page: str | None, w: Weights | None = None) -> str:
    """The main text of a whole page."""
    w = w or learned()
    _forget()
    held = Page(page or "")
    span = region(held, w)
    return read(held, span, insets(held, span, w))


def _run(w: Weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [extract(h, w) for h in part.column("_html").to_pylist()]
                n = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), n], names=["_id", "_url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInArrow(_run(learned()), "_id long, _url string, text string, n_chars long")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
