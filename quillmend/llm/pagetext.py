"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of words and tags. A word scores the share of such words (by what encloses them) that are
content on labelled pages, so it is positive; a tag scores the logarithm of the share of such tags that lie within content, so
it is negative. One scan finds the contiguous region with the greatest sum, and its words that aren't boilerplate
themselves are the text.

Pages label themselves: where an ``article`` (or, without one, a ``main``) element says what the content is, its words
and tags are examples of content and the others of boilerplate. Every labelled page teaches twice: with its markers
known, for pages that have one, and with them hidden, for pages without.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: About so many labelled pages at most are learned from.
FIT_PAGES = 4096
#: What was counted is mixed with so many examples as the fixed values below say.
PRIOR = 20.0
#: Words below this score are boilerplate wherever they stand.
KEPT = 0.1
#: Pages that one Arrow batch holds: memory is bounded by the longest of them.
BATCH_PAGES = 64

# Elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption caption".split())
SECTION = frozenset("div section article main body html center fieldset table".split())
BOILERPLATE = frozenset("head nav aside footer form menu button select option dialog object canvas audio video".split())
#: Words of classes and ids that say the same; the last line says so only outside of an article.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer toolbar share sharing social related recommended recommendations comment comments disqus replies reply respond pagination pager copyright".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*>)", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_RAW_END = {name: re.compile(f"</{name}(?![a-z])[^>]*+>?", re.IGNORECASE) for name in RAW}
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN, _UNSEEN = re.compile(r"(?:\s|^)hidden(?=[\s=/]|$)", re.IGNORECASE), re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|\S*)display\s*:\s*none", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ARTICLE, _MAIN = re.compile(r"<article\b", re.IGNORECASE), re.compile(r"<main\b|\brole\s*=\s*[\"']?main\b|articleBody", re.IGNORECASE)


class _Tag:
    """What a tag's spelling says, whatever stands around it."""

    __slots__ = ("boiler", "closing", "empty", "header", "key", "name", "role")

    def __init__(self, slash: str, name: str, rest: str):
        self.name, self.closing = name.lower(), bool(slash)
        self.empty = self.name in VOID
        words: list[str] = []
        self.role = self.name if self.name in ("article", "main") else ""
        for what, *values in _NAMED.findall(rest) if "=" in rest and not slash else ():
            value = next(filter(None, values), "")
            what = what.lower()
            if what == "itemprop" and value == "articleBody" or what == "role" and value == "main":
                self.role = self.role or "main"
            elif what == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search"):
                words.append({"banner": "masthead"}.get(value, "nav"))
            elif what in ("class", "id"):
                words += [w.lower() for w in _PART.findall(value)]
        listed = [w for w in words if w in BOILERPLATE_WORDS]
        self.boiler = self.name in BOILERPLATE or bool(listed) or bool(rest and (_HIDDEN.search(_QUOTED.sub('""', rest)) or "=" in rest and _UNSEEN.search(rest)))
        self.header = self.name == "header" or not HEADER_WORDS.isdisjoint(words)
        self.key = self.name + "".join("." + w for w in (listed or words)[:1])


class _Cached(dict):
    """Tags by their spelling; forgets all when it has grown long."""

    def tag(self, slash: str, name: str, rest: str) -> _Tag:
        key = slash, name, rest
        found = self.get(key)
        if found is None:
            if len(self) > 20_000:
                self.clear()
            found = self[key] = _Tag(slash, name, rest)
        return found


def _prior(key: str) -> float:
    """How far a word or tag is content before any page has been seen (fixed values)."""
    kind, where, *of = key.split("|")
    if kind == "w":
        block, link, boiler = of
        if boiler:
            return 0.02
        if where == "in":
            return 0.98
        if where == "out":
            return 0.05
        if link and block not in TEXT_BLOCK:
            return 0.2
        return 0.9 if block in TEXT_BLOCK else 0.6
    name = of[0].partition(".")[0]
    if where == "in":
        return 0.98
    if of[1]:
        return 0.1
    if where == "out":
        return 0.05
    return 0.6 if name in SECTION else 0.97


class Weights:
    """Scores of words and tags by their keys, learned from how often each was seen within content and in all."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.known = {k: self._share(k, *c) for k, c in counts.items()}

    @staticmethod
    def _share(key: str, inside: int, seen: int) -> float:
        return (inside + PRIOR * _prior(key)) / (seen + PRIOR)

    def word(self, key: str) -> float:
        """Above 0."""
        found = self.known.get(key)
        if found is None:
            found = self._share(key, 0, 0)
            if len(self.known) < 100_000:
                self.known[key] = found
        return found

    def tag(self, key: str) -> float:
        """Below 0."""
        return math.log(self.word(key))


def _tokens(page: str, cache: _Cached, marker: str) -> Iterator[tuple]:
    """(key, text, block, inside) in page order: text None for a tag; block: how many block boundaries came before.

    marker: ``article``, ``main`` or empty, what marks the content; inside: whether the token is within it and isn't
    boilerplate. Places are visited once; an element that is never closed ends with its parent.
    """
    stack: list[tuple] = []  # (name, block, where, region's block, link, boilerplate)
    opened: Counter[str] = Counter()
    block, where, around, link, boiler = 0, "out" if marker else "", "", "", ""

    def left() -> None:
        nonlocal block, where, around, link, boiler
        name, where, around, link, boiler = stack.pop()
        opened[name] -= 1
        block += name in BLOCK

    def implied(name: str) -> None:
        """Elements that end where this one starts."""
        while stack and opened["p"] and stack[-1][0] not in BLOCK:
            if not any(s[0] == "p" for s in stack[-8:]):
                return
            left()
        if stack and stack[-1][0] == "p":
            left()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and (stack[-1][0] == name or {stack[-1][0], name} in ({"dt", "dd"}, {"td", "th"})):
            left()

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        m = None
        while lt < size and not (m := _TAG.match(page, lt) or _LOOSE.match(page, lt)):
            lt = page.find("<", lt + 1)
            lt = size if lt < 0 else lt
        if lt > at:
            yield f"w|{where}|{around}|{link}|{boiler}", page[at:lt], block, where != "out" and not boiler
        if not m:
            return
        at = m.end()
        if not m[2]:  # a comment, a declaration
            continue
        tag = cache.tag(m[1], m[2], m[3])
        name = tag.name
        if tag.closing:
            if opened[name] <= 0:
                block += name in BLOCK
                continue
            while stack[-1][0] != name:
                left()
            yield f"t|{where}|/{name}|{boiler}", None, block, where != "out"
            left()
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            yield f"t|{where}|{name}|{boiler}", None, block, False
            if not end:
                return
            at = end.end()
            continue
        if name in BLOCK:
            implied(name)
            block += 1
        if not tag.empty:
            stack.append((name, where, around, link, boiler))
            opened[name] += 1
            if name in BLOCK:
                around = name
            if name == "a":
                link = "a"
            if tag.boiler or tag.header and where != "in":
                boiler = "b"
            elif marker and tag.role and not boiler and (tag.role == marker or marker == "main"):
                where = "in"
        yield f"t|{where}|{tag.key}|{boiler}", None, block, where != "out"


def _marker(page: str) -> str:
    return "article" if _ARTICLE.search(page) else "main" if _MAIN.search(page) else ""


def count(page: str, cache: _Cached) -> Counter:
    """What a labelled page teaches: (key, inside) of its words and tags, with its markers known and hidden."""
    found: Counter = Counter()
    marker = _marker(page)
    if not marker:
        return found
    for key, text, _, inside in _tokens(page, cache, marker):
        n = 1 if text is None else len(text.split())
        if n:
            kind, _, rest = key.split("|", 2)
            found[key, inside] += n
            found[f"{kind}||{rest}", inside] += n
    return found


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part (from, to) with the greatest sum, the first of several; (0, 0) if no sum is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: Weights, cache: _Cached | None = None) -> str:
    """The page's text: white space within a block is one space, blocks are lines."""
    cache = _Cached() if cache is None else cache
    marker = _marker(page)
    text = _region(page, weights, cache, marker)
    return text or (_region(page, weights, cache, "") if marker and not _only_empty(page, cache, marker) else "")


def _only_empty(page: str, cache: _Cached, marker: str) -> bool:
    """Whether the page does mark a content, which then is empty."""
    return any(inside for _, _, _, inside in _tokens(page, cache, marker))


def _region(page: str, weights: Weights, cache: _Cached, marker: str) -> str:
    scores: list[float] = []
    runs: list[tuple[int, str, int]] = []  # place among the scores, text, block
    for key, text, block, _ in _tokens(page, cache, marker):
        if text is None:
            scores.append(weights.tag(key))
            continue
        n = len(text.split())
        w = weights.word(key)
        scores.append(n * w)
        if w >= KEPT:
            runs.append((len(scores) - 1, text, block))
    start, end = best_region(scores)
    blocks: list[list[str]] = []
    last = None
    for i, text, block in runs:
        if start <= i < end:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, column: str) -> Weights:
    """Weights from about ``FIT_PAGES`` different pages, drawn by a hash of the whole page; all of them in small tables.

    Pages without a marker teach nothing. The counts are sums over the cluster, a row for each kind of word or tag.
    """
    page = F.col(column)
    n = pages.count()
    unit = F.pmod(F.xxhash64(page), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = pages.filter((unit < FIT_PAGES / max(1, n)) & page.rlike(r"(?i)<(article|main)\b|role\s*=\s*[\"']?main\b|articleBody")).groupBy(F.xxhash64(page)).agg(F.any_value(page).alias("page"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, found = _Cached(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(count(text, cache))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], names=["key", "inside", "n"])

    counts = drawn.select("page").mapInArrow(counted, "key string, inside boolean, n bigint").groupBy("key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("seen"))
    return Weights({r.key: (r.inside, r.seen) for r in counts.collect()})  # bounded by the sample


def extract(pages: DataFrame, column: str, weights: Weights) -> DataFrame:
    """``pages`` with ``text`` (the main text of ``column``, empty if there is none) and ``n_chars``, its code points.

    Null and empty pages have an empty text. Rows keep to themselves, so repeated rows and nulls elsewhere are
    no matter; a very long page takes memory in proportion. Input columns of these names give way.
    """
    inner, at = common.shielded(pages)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    place = inner.columns.index(at[column])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cached()
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH_PAGES):
                batch = whole.slice(i, BATCH_PAGES)
                texts = [main_text(p, weights, cache) if p else "" for p in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    out = inner.mapInArrow(extracted, f"{fields}, text string").withColumn("n_chars", F.char_length("text").cast("bigint"))
    return common.restored(out, pages.columns, "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by weights learned from the same table."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, "html", learn(pages, "html")).select("page_id", "url", "text", "n_chars")
