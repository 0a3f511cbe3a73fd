"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Each has a score, with weights
learned from labelled pages (``html_pages``):

* A word's score is the log odds of main text, by logistic regression on the
  elements around it (their tags and the parts of their classes, ids and
  roles), on its block's length and share of links, and on whether the block
  ends like a sentence.  No name is main text or not by a rule; a name that no
  labelled page has counts nothing.  Names that speak against main text don't
  count on an element with most of the page's words and a heading: they tell
  what stands in that frame.
* A tag's score is negative: the log odds of standing outside main text, from
  ``LEAST_TAG`` to ``MOST_TAG``, as many tags stand between few words.

One linear scan finds the contiguous stretch of the greatest sum.  A tag or a
word of negative score inside an element that is main text counts ``PARTED``
only, so that a long aside within an article doesn't part it.  Of the stretch, widened
to whole blocks, the blocks whose words sum to a negative score are left out:
asides within the article.  References are decoded, white space inside a block
becomes one space, and blocks are joined by an empty line.

Every page is handled alone in a Spark task in time linear in its length; the
weights are learned once, by the driver, from ``html_pages`` alone.

Defined results: a null or empty page has an empty text; so has a page without
a positive stretch; the content of scripts, styles and the like is no text;
unclosed, stray and cut-off tags are tolerated; rows that repeat are each
extracted; an empty table gives an empty result; other columns pass through,
and the text's column is ``__hx_text`` unless another name is given.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from agorafold.llm import common, html_pages

#: Scores of a word are cut off here, either way.
MOST_WORD = 4.0
LEAST_TAG, MOST_TAG, PARTED = 0.02, 0.2, 0.01
#: Log odds by which the elements around must say "main text" for words inside to count ``PARTED``.
SURELY_MAIN = 1.0
RIDGE = 0.3

BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption head title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that say nothing about their content.
SILENT = frozenset("html body div span b i em strong u s small big font center tbody tr".split())
#: An opening tag of the left ends an open one of the right.
CLOSES = {"p": ("p",), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Elements that end an unclosed head.
AFTER_HEAD = BLOCKS - {"head", "title"}

#: Attributes as browsers read them: a quote delimits a value only right after the equals sign (and only if it is closed).
_VALUE = r"""\"[^\"]*+\"|'[^']*+'|[^\s>]*+"""
_ATTRIBUTE = rf"(=?[^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?+"
_ATTRIBUTES = rf"(?>[\s/]++|=?[^\s/>=]++(?>\s*+=\s*+(?>{_VALUE}))?+|=)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|textarea|title)\b{_ATTRIBUTES}(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_READ = re.compile(_ATTRIBUTE)
_PARTS = re.compile(r"[a-z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@functools.lru_cache(maxsize=4096)
def _attributes(text: str) -> tuple[tuple[str, str], ...]:
    """(name, value) of the attributes of a tag, in lower case and as they are."""
    found = ((m[1].lower(), m[2] or "") for m in _READ.finditer(text))
    return tuple((n, v[1:-1] if len(v) > 1 and v[0] in "\"'" and v[-1] == v[0] else v) for n, v in found)


@functools.lru_cache(maxsize=4096)
def _closes_itself(text: str) -> bool:
    """A slash ends the tag that is no part of a value without quotes."""
    ends = [m.end() for m in _READ.finditer(text)]
    return text.endswith("/") and (not ends or ends[-1] < len(text))


@functools.lru_cache(maxsize=4096)
def _names(attributes: str) -> frozenset[str]:
    """What the classes, ids and roles of a tag may tell of its content."""
    out = set()
    for name, value in _attributes(attributes):
        for word in value.split() if name in ("class", "id", "role") else ():
            parts = _PARTS.findall(_CAMEL.sub(" ", word).lower())
            if parts and parts[0] in ("has", "with", "no", "without"):  # says what stands beside
                parts = ["-".join(parts)]
            out.update(parts)
            if len(parts) > 1:
                out.add("-".join(parts))
    return frozenset(out)


@functools.lru_cache(maxsize=4096)
def _features(tag: str, attributes: str) -> frozenset[str]:
    """What an opening tag may tell of its content."""
    out = set() if tag in SILENT else {f"<{tag}>"}
    given = dict(_attributes(attributes)) if attributes else {}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(given.get("style", "")):
        out.add("hidden")
    return frozenset(out) | _names(attributes)


@dataclass
class Place:
    """Where text stands: the features of all elements around it."""

    features: frozenset[str]
    odds: float = 0.0
    in_main: bool = False
    inside: dict = field(default_factory=dict)


class Model:
    """weights: log odds by feature; tags: scores by tag."""

    def __init__(self, weights: dict[str, float] | None = None, tags: dict[str, float] | None = None):
        self.weights, self.tags = weights or {}, tags or {}
        self.root, self.known = Place(frozenset()), 0

    def __reduce__(self):
        return Model, (self.weights, self.tags)

    def blames(self, attributes: str) -> frozenset[str]:
        """The names of a tag that speak against main text, if all its names together do by ``SURELY_MAIN``."""
        names = _names(attributes) if attributes else ()
        surely = sum(self.weights.get(f, 0.0) for f in names) < -SURELY_MAIN
        return frozenset(f for f in names if surely and self.weights.get(f, 0.0) < 0)

    def enter(self, place: Place, tag: str, attributes: str, frame: bool = False) -> Place:
        """The place inside an element; equal places are one object. frame: its names blame nothing."""
        key = (tag, attributes, frame)
        found = place.inside.get(key)
        if found is None:
            more = _features(tag, attributes)
            more = more - self.blames(attributes) if frame else more
            if more <= place.features:
                return place
            every = place.features | more
            odds = sum(self.weights.get(f, 0.0) for f in every)
            found = Place(every, odds, place.in_main or odds > SURELY_MAIN)
            if self.known < 100_000:
                place.inside[key] = found
                self.known += 1
        return found

    def word(self, place: Place, block: list[str]) -> float:
        odds = place.odds + self.weights.get("", 0.0) + sum(self.weights.get(f, 0.0) for f in block)
        return max(-MOST_WORD, min(MOST_WORD, odds))

    def tag(self, name: str) -> float:
        return self.tags.get(name, -LEAST_TAG)


@dataclass
class Token:
    """A tag, or raw text of n words if ``is_text``; ``at`` is its offset in the page."""

    at: int
    value: str
    block: int
    place: Place
    is_text: bool = False
    n: int = 0


def _tokens(page: str, model: Model) -> list[Token]:
    """The tags and texts of a page, each with its place.

    An element with most of the page's words and a heading is a frame: its
    names tell what else stands in it ("content-with-sidebar"), not what it is,
    so those that speak against main text are left out.
    """
    blamed: dict[int, list[int]] = {}
    out = _read(page, model, frozenset(), blamed)
    heads = [i for i, t in enumerate(out) if not t.is_text and t.value == "h1"] or [i for i, t in enumerate(out) if not t.is_text and t.value in ("h2", "h3")][:1]
    if not blamed or not heads:
        return out
    so_far = np.cumsum([0, *(t.n for t in out)])
    frames = frozenset(at for at, (low, high) in blamed.items() if 2 * (so_far[high] - so_far[low]) > so_far[-1] and any(low < i < high for i in heads))
    return _read(page, model, frames, {}) if frames else out


def _read(page: str, model: Model, frames: frozenset[int], blamed: dict[int, list[int]]) -> list[Token]:
    """The tokens; frames: offsets of their opening tags. blamed: gets the token range of each element whose names speak against it."""
    out: list[Token] = []
    stack: list[tuple[str, Place, int]] = []
    opened: Counter = Counter()
    now, block, at = model.root, 0, 0

    def pop(k: int) -> None:
        nonlocal now
        for name, _, start in stack[k:]:
            opened[name] -= 1
            if start in blamed:
                blamed[start][1] = len(out)
        del stack[k:]
        now = stack[-1][1] if stack else model.root

    def text(low: int, high: int) -> None:
        value = page[low:high]
        out.append(Token(low, value, block, now, True, len(value.split())))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if opened[name]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        else:
            if opened["head"] and name in AFTER_HEAD:
                pop(next(k for k, (x, _, _) in enumerate(stack) if x == "head"))
            closes = CLOSES.get(name, ("p",) if name in ENDS_P else ())
            while stack and stack[-1][0] in closes:
                pop(len(stack) - 1)
            if name not in VOID and not (m[4].endswith("/") and _closes_itself(m[4])):
                now = model.enter(now, name, m[4], m.start() in frames)
                stack.append((name, now, m.start()))
                opened[name] += 1
                if model.blames(m[4]):
                    blamed[m.start()] = [len(out), 0]
        block += name in BLOCKS
        out.append(Token(m.start(), name, block, now))
    if at < len(page):
        text(at, len(page))
    pop(0)
    return out


def _of_blocks(tokens: list[Token]) -> dict[int, list[str]]:
    """Of each block with words the features of its length, its links and its end."""
    words, linked, last = Counter(), Counter(), {}
    for t in tokens:
        if t.n:
            words[t.block] += t.n
            linked[t.block] += t.n * ("<a>" in t.place.features)
            last[t.block] = t.value
    out = {}
    for b, n in words.items():
        size = "few words" if n < 4 else "some words" if n < 10 else "words" if n < 25 else "many words"
        links = "no link" if not linked[b] else "links" if 2 * linked[b] > n else "some links"
        out[b] = [size, links, "sentence" if last[b].rstrip()[-1:] in ".!?:;…。" else "no sentence"]
    return out


def learn(pages: list[html_pages.Page]) -> Model:
    """Weights from labelled pages."""
    blank = Model()
    seen: dict[frozenset, list[float]] = {}
    tags, words = (Counter(), Counter()), [0, 0]
    for page in pages:
        whole = "".join(piece for piece, _ in page)
        ends = np.cumsum([len(piece) for piece, _ in page])
        tokens = _tokens(whole, blank)
        blocks = _of_blocks(tokens)
        for t in tokens:
            main = int(page[int(np.searchsorted(ends, t.at, "right"))][1])
            if not t.is_text:
                tags[main][t.value] += 1
            elif t.n:
                words[main] += t.n
                seen.setdefault(t.place.features | frozenset(blocks[t.block]), [0.0, 0.0])[main] += min(t.n, 10)
    names = sorted({f for fs in seen for f in fs})
    place = {f: k + 1 for k, f in enumerate(names)}
    x = np.zeros((len(seen), len(names) + 1))
    x[:, 0] = 1
    for row, fs in enumerate(seen):
        x[row, [place[f] for f in fs]] = 1
    n = np.array(list(seen.values()))
    total, share = n.sum(1), n[:, 1] / n.sum(1)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[0] = 1e-3
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (total * (p - share)) + ridge * w
        curve = (x * (total * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        w = w - np.clip(np.linalg.solve(curve, slope), -3, 3)
    ratio = words[1] / max(1, words[0])
    odds = {t: float(np.log((tags[0][t] + 0.5) / (tags[1][t] + 0.5) * ratio)) for t in {*tags[0], *tags[1]}}
    return Model({"": float(w[0])} | {f: float(w[k]) for f, k in place.items()}, {t: -min(MOST_TAG, max(LEAST_TAG, v)) for t, v in odds.items()})


@functools.lru_cache(maxsize=1)
def learned() -> Model:
    return learn(html_pages.labelled())


def stretch(tokens: list[Token], scores: list[float], model: Model) -> tuple[int, int]:
    """The contiguous tokens of the greatest sum: a running sum that starts anew when it falls to 0."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(tokens):
        score = scores[i] * t.n if t.is_text else model.tag(t.value)
        if score < 0 and t.place.in_main:
            score = -PARTED * (t.n or 1)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def extract(page: str | None, model: Model | None = None, scan: bool = True) -> str:
    """The main text of one page; without ``scan``, of all its blocks of positive score (to see what the scan does)."""
    if not page:
        return ""
    model = model or learned()
    tokens = _tokens(page, model)
    blocks = _of_blocks(tokens)
    scores = [model.word(t.place, blocks[t.block]) if t.n else 0.0 for t in tokens]
    low, high = stretch(tokens, scores, model) if scan else (0, len(tokens))
    if low == high:
        return ""
    first, last = tokens[low].block, tokens[high - 1].block
    sums: Counter = Counter()
    pieces: dict[int, list[str]] = {}
    for t, score in zip(tokens, scores, strict=True):
        if t.is_text and first <= t.block <= last:
            sums[t.block] += score * t.n
            pieces.setdefault(t.block, []).append(t.value)
    texts = (_SPACE.sub(" ", html.unescape("".join(own))).strip() for b, own in pieces.items() if sums[b] > 0)
    return "\n\n".join(t for t in texts if t)


def main_text(pages: DataFrame, source: str = "html", name: str = "__hx_text") -> DataFrame:
    """``pages`` with the main text of every page."""
    column = pages.columns.index(source)
    schema = StructType([*pages.schema.fields, StructField(name, StringType())])
    model = learned()  # some hundred numbers

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([extract(x.as_py(), model) for x in batch.column(column)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return pages.mapInArrow(extracted, schema)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html")))
    return found.select("page_id", "url", F.col("__hx_text").alias("text"), F.length("__hx_text").cast("long").alias("n_chars"))
