"""Main text of web pages: markup that says what is no text, and subtrees that recur on a host's pages.

A page is read into blocks of text and the elements that hold them. Each element's subtree is hashed,
and Spark counts for each host on how many different pages a subtree occurs; copies of a page count
once. Subtrees that recur are a template and go. Within an article (or main) element only containers
with a class or id can go this way, since prose may recur in true articles; where a page has no such
element, anything can.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import BROADCAST_ROWS, map_arrow
from sensorloom.sources.scratch import written

#: Different pages of a host on which a subtree occurs that is taken as a template.
TEMPLATE_PAGES = 5

# Elements of HTML by their meaning for the text.
HIDDEN = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select option datalist button".split())
PARTS = frozenset("nav footer aside form menu dialog fieldset search".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("html head title script style noscript noframes template base basefont bgsound link meta".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words in a class or id that mark what is no part of an article, or a main part.
NO_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN = frozenset("article content entry main post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|noframes|template|textarea|title|svg|math|iframe|object|select|button|video|audio|canvas|datalist)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[^a-z0-9]+")

_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@dataclass
class Element:
    tag: str
    marks: frozenset[str]  # words of class and id
    named: bool
    role: str
    parent: int
    first: int  # blocks from first to end - 1 are within
    end: int = -1


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    holder: list[int] = field(default_factory=list)


def _marks(attrs: str | None) -> frozenset[str]:
    """Words of class and id."""
    if not attrs:
        return frozenset()
    names = {a[1].lower(): (a[2] or a[3] or a[4] or "").lower() for a in _ATTR.finditer(attrs)}
    return frozenset(w for w in _WORD.split(f"{names.get('class', '')} {names.get('id', '')}") if w)


def parse(source: str) -> Page:
    """Blocks and block-level elements of a page, unclosed and misplaced tags as browsers take them."""
    page, stack, text = Page(), [], []
    page.elements.append(Element("html", frozenset(), False, "", -1, 0))
    stack.append(0)
    hidden = 0
    #: An inline element that is no text: its tag, how deep it is open, where it begins, blocks open around it.
    inline: list | None = None

    def flush() -> None:
        if inline:
            del text[inline[2] :]
            inline[2] = 0
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                page.blocks.append(block)
                page.holder.append(stack[-1])

    def close(to: int) -> None:
        while len(stack) > to:
            page.elements[stack.pop()].end = len(page.blocks)

    at = 0
    for m in _TOKEN.finditer(source):
        # Tags of head and body may be left out: the head also ends before text or what can't be in it.
        if hidden and source[at : m.start()].strip():
            hidden = 0
        if m.start() > at and not hidden:
            text.append(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "head" and not m["end"]:
            hidden = 1
        elif tag in ("head", "body") and hidden:
            hidden = 0
        elif hidden and (tag or m["raw"]) and not m["end"] and (tag or m["raw"].lower()) not in HEAD:
            hidden = 0
        if hidden or not tag:
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS or tag in ("html", "body"):
            if inline and tag == inline[0]:
                inline[1] += -1 if m["end"] else 1
                if not inline[1]:
                    del text[inline[2] :]
                    inline = None
            elif not inline and not m["end"] and tag not in VOID and (tag == "label" or _marks(m["attrs"]) & NO_TEXT):
                inline = [tag, 1, len(text), len(stack)]
            continue
        flush()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if page.elements[stack[i]].tag == tag:
                    close(i)
                    if inline and len(stack) < inline[3]:
                        inline = None  # never closed: it ends with the block around it
                    break
                if page.elements[stack[i]].tag in ("article", "main", "td", "table") and tag in PROSE:
                    break
            continue
        if tag == "hr":
            continue
        # A paragraph ends where the next block begins, items and cells where the next of their kind does.
        if page.elements[stack[-1]].tag == "p":
            close(len(stack) - 1)
        if page.elements[stack[-1]].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "p"):
            close(len(stack) - 1)
        if inline and len(stack) < inline[3]:
            inline = None
        names = {"class": "", "id": "", "role": ""}
        for a in _ATTR.finditer(m["attrs"] or ""):
            names[a[1].lower()] = (a[2] or a[3] or a[4] or "").lower()
        marks = frozenset(w for w in _WORD.split(f"{names['class']} {names['id']}") if w)
        page.elements.append(Element(tag, marks, bool(marks), names["role"].strip(), stack[-1], len(page.blocks)))
        stack.append(len(page.elements) - 1)
    if at < len(source) and (not hidden or source[at:].strip()):
        text.append(source[at:])
    flush()
    close(0)
    return page


def _within(page: Page, chosen: list[bool]) -> list[bool]:
    """For each element whether it or one around it is chosen."""
    out: list[bool] = []
    for e, c in zip(page.elements, chosen, strict=True):
        out.append(c or (e.parent >= 0 and out[e.parent]))
    return out


def marked(page: Page) -> tuple[list[bool], list[bool], bool]:
    """For each element: whether its markup says it is no text; whether it is within the main part; if there is one."""
    strong = _within(page, [e.tag in ("article", "main") or e.role == "main" for e in page.elements])
    no_text = []
    for i, e in enumerate(page.elements):
        apart = e.tag in PARTS or e.tag in HIDDEN or e.role in ROLES or bool(e.marks & NO_TEXT)
        head = e.tag == "header" and not strong[i]
        # Words of a class may also name the article itself, as in "post with-sidebar".
        no_text.append((apart and not (e.tag in ("article", "main") and not e.marks & {"comment", "comments", "ad", "ads", "related", "promo", "sponsored"})) or head)
    gone = _within(page, no_text)
    for main in (
        [e.tag == "article" for e in page.elements],
        [e.tag == "main" or e.role == "main" for e in page.elements],
        [bool(e.marks & MAIN) and e.tag in ("div", "section", "td") for e in page.elements],
    ):
        usable = [m and not g and e.end > e.first for m, g, e in zip(main, gone, page.elements, strict=True)]
        if any(usable):
            return gone, _within(page, usable), True
    return gone, [True] * len(page.elements), False


def subtree_keys(page: Page, host: str) -> list[int]:
    """For each element a hash of the host, its tag and marks, and all text within.

    The text within is a run of blocks: its hash is a difference of running sums, so that an element
    costs the same however deep others lie in it.
    """
    sums, shift, inverse = [0], 1, [1]
    for block in page.blocks:
        sums.append((sums[-1] + (xxhash.xxh3_64_intdigest(block.encode("utf-8", "surrogatepass")) | 1) * shift) & _MASK)
        shift = shift * _FACTOR & _MASK
        inverse.append(inverse[-1] * _INVERSE & _MASK)
    out = []
    for e in page.elements:
        text = (sums[e.end] - sums[e.first]) * inverse[e.first] & _MASK
        own = f"{host}\0{e.tag}\0{' '.join(sorted(e.marks))}\0{e.end - e.first}\0{text}"
        out.append(xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) - 2**63)
    return out


def removable(page: Page, main: list[bool], has_main: bool) -> list[bool]:
    """Elements that may go because their subtree recurs."""
    return [e.end > e.first and e.parent >= 0 and (not has_main or not m or (e.named and e.tag not in PROSE and e.tag not in ("article", "main"))) for e, m in zip(page.elements, main, strict=True)]


def main_text(page: Page, gone: list[bool], main: list[bool]) -> str:
    return "\n".join(b for b, h in zip(page.blocks, page.holder, strict=True) if main[h] and not gone[h])


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str | None, str]]:
    for url, source in zip(batch.column(1), batch.column(2), strict=True):
        yield url.as_py(), source.as_py() or ""


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("subtree", pa.int64()), ("page", pa.int64())])
    for batch in batches:
        rows = set()
        for url, source in _texts(batch):
            page = parse(source)
            gone, main, has_main = marked(page)
            # Copies of a page have one text without what its markup sets apart.
            text = xxhash.xxh3_64_intdigest(main_text(page, gone, main).encode("utf-8", "surrogatepass")) - 2**63
            keys, may = subtree_keys(page, host_of(url)), removable(page, main, has_main)
            rows.update((k, text) for k, m in zip(keys, may, strict=True) if m)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is in known, which is sorted: the cost of a page does not grow with all templates."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _extract(known: object):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            own = batch.column(3).to_pylist() if known is None else None
            for i, (url, source) in enumerate(_texts(batch)):
                page = parse(source)
                gone, main, has_main = marked(page)
                keys, may = np.array(subtree_keys(page, host_of(url)), np.int64), removable(page, main, has_main)
                recurring = among(keys, np.sort(np.array(own[i] or [], np.int64)) if known is None else known.value)
                gone = _within(page, [g or (m and bool(r)) for g, m, r in zip(gone, may, recurring, strict=True)])
                text = main_text(page, gone, main)
                texts.append(text)
                counts.append(text.count("\n") + 1 if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return run, "page_id long, url string, text string, n_blocks long"


def _page_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_key", pa.int64()), ("subtree", pa.int64())])
    for batch in batches:
        rows = []
        for (url, source), key in zip(_texts(batch), batch.column(3).to_pylist(), strict=True):
            page = parse(source)
            _, main, has_main = marked(page)
            keys, may = subtree_keys(page, host_of(url)), removable(page, main, has_main)
            rows += {(key, k) for k, m in zip(keys, may, strict=True) if m}
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def template_subtrees(pages: DataFrame, least: int = TEMPLATE_PAGES) -> DataFrame:
    """(subtree, pages): subtrees that occur on at least so many different pages of a host."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    once = map_arrow(rows, _subtrees, "subtree long, page long").distinct()
    return once.groupBy("subtree").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)


def extract_text(pages: DataFrame, least: int = TEMPLATE_PAGES) -> DataFrame:
    """(page_id, url, text, n_blocks) of each row of pages (page_id, url, html, and any others).

    text is the main text: blocks in page order joined by a line end, character references decoded,
    white space in a block taken as one blank. It is empty for a null or empty html and for a page
    without main text. Pages with a null or unreadable url count as one host. Repeated rows give
    repeated rows, and count once for templates. An empty table gives an empty result.

    Hashes of recurring subtrees go to all tasks while there are at most BROADCAST_ROWS; beyond
    that, each page is joined with those of its own that recur.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    templates = written(template_subtrees(rows, least).select("subtree"))
    if templates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = np.sort(np.array([r[0] for r in templates.toLocalIterator()], np.int64))
        return map_arrow(rows, *_extract(rows.sparkSession.sparkContext.broadcast(known)))
    keyed = rows.withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    own = map_arrow(keyed, _page_subtrees, "page_key long, subtree long").join(templates, "subtree")
    found = own.groupBy("page_key").agg(F.collect_set("subtree").alias("own"))  # a page's own elements at most
    return map_arrow(keyed.join(found, "page_key", "left").select("page_id", "url", "html", "own"), *_extract(None))
