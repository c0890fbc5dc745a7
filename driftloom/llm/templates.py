"""Main text of web pages: what a host repeats on its pages is its template, not its text.

Every container's subtree is hashed, bottom-up from its tag, text and children; Spark counts on how
many different pages of a host each hash occurs. A subtree on more than half of them, or on more
than half of those of one design, is template; ``LEAST_PAGES`` pages are needed to tell. A design is
the set of containers, with their classes, right below body; those of less than ``DESIGN_SHARE`` of
the host's pages are not counted on their own, so a host has few. Copies of one page count once.

The text is that of all ``article`` if they hold the larger part of ``main`` or body, else that of
``main`` or body. Within an article or main only repeated blocks that hold blocks or lists of links
go, never paragraphs, headings or parts of them, and not where more than half of an article would
go: such a page is a near copy of others. Where there is neither, repeated paragraphs go too.
Menus, forms and the like that vary by page cannot be told by counting; they are known by their
tags, roles and class words, unless they stand around the page's text.

A host has fewer than (1 + 1 / DESIGN_SHARE) * 2 * (containers per page) template hashes, however
many its pages. The lists are stored before they meet the pages: Spark knows their size, and
broadcasts them if it is under its limit; beyond that, pages are shuffled by host and adaptive
execution splits large hosts.

Null and empty pages have an empty text; null urls form a host of their own. Repeated rows give
a row each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from driftloom.llm.common import signed, slices
from driftloom.shipping import ship_package
from driftloom.storage import settle

LEAST_PAGES = 4
SHARE = 0.5
DESIGN_SHARE = 0.02
#: The design that stands for the whole host.
WHOLE = 0
#: Hosts whose lists a task remembers.
REMEMBERED = 4096

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|title|textarea|select|object|canvas|video|audio|math|button"
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that carry text of their own; all others hold blocks.
TEXT_BLOCKS = frozenset("address blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr legend li p pre summary tbody td tfoot th thead tr".split())
CONTAINERS = BLOCKS - TEXT_BLOCKS - {"html", "body", "article", "main"}
#: A start tag of the first kind ends an open element of the second kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NEVER = frozenset("nav footer aside form menu dialog head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer cookie cookies consent gdpr notice notices banner popup modal newsletter subscribe subscription share sharing social "
    "related recommended comment comments reply replies disqus pagination pager widget masthead skip login signup toolbar".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Element(NamedTuple):
    """Tag, first and last text piece, nesting, whether the tags alone rule it out, and its hash.

    ``words``: what rules it out says nothing about its size (a form, or words of class and id).
    ``full``: it holds a block, or links and little else.
    """

    tag: str
    first: int
    last: int
    depth: int
    never: bool
    words: bool = False
    full: bool = False
    hash: int = 0


class Page(NamedTuple):
    """Elements in order of their ends, text pieces with whether a block begins before each, the design."""

    elements: list[Element]
    pieces: list[tuple[str, bool]]
    design: int


class _Open:
    """An element that has not ended: what it holds so far."""

    __slots__ = ("tag", "first", "why", "parts", "blocks", "links")

    def __init__(self, tag: str, first: int, why: str, source: str):
        self.tag, self.first, self.why = tag, first, why
        self.parts = [" ".join(source.split()).encode("utf-8", "surrogatepass")]
        self.blocks = self.links = 0


def _ruled_out(tag: str, attributes: str, inside: bool) -> str:
    """What rules an element out: "tag" (or role), "words" (or a form), or nothing."""
    if tag == "form":
        return "words"
    if tag in NEVER or tag == "header" and not inside:
        return "tag"
    found = ""
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in ROLES:
                return "tag"
        elif tag not in ("html", "body", "article", "main") and not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            found = "words"
    return found


def parse(html: str) -> Page:
    """One pass over the source; every token is looked at once, whatever the nesting."""
    done: list[Element] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    outer: set[str] = set()
    at, breaks = 0, True

    def close() -> None:
        own = stack.pop()
        opened[own.tag] -= 1
        mark = xxh64_digest(b"\0".join(own.parts))
        block = own.tag in BLOCKS
        if stack:
            stack[-1].parts.append(mark)
            stack[-1].blocks += own.blocks + block
            stack[-1].links += own.links + (own.tag == "a")
        full = own.blocks > 0 or own.links > 1
        done.append(Element(own.tag, own.first, len(pieces), len(stack), own.why != "", own.why == "words", full, int.from_bytes(mark, "little")))

    for token in _TOKEN.finditer(html):
        if token.start() > at:
            text = html[at : token.start()]
            pieces.append((text, breaks))
            breaks = False
            if stack and (shown := " ".join(text.split())):
                stack[-1].parts.append(shown.encode("utf-8", "surrogatepass"))
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append((" ", breaks))
            breaks = False
            continue
        if tag in BLOCKS:
            breaks = True
        if token["close"]:
            if opened[tag] > 0:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and tag not in ("html", "body"):
            while stack and stack[-1].tag == "p" or any(own.tag == "p" for own in stack[-3:]) and stack[-1].tag not in BLOCKS:
                close()
        for other in ENDS.get(tag, ()):
            if stack and stack[-1].tag == other:
                close()
        attributes = token["attrs"]
        if tag in CONTAINERS and len(stack) == opened["html"] + opened["body"]:
            classes = next(("".join(v) for n, *v in _ATTRIBUTE.findall(attributes) if n.lower() == "class"), "")
            outer.add(f"{tag} {' '.join(sorted(classes.split()))}")
        why = _ruled_out(tag, attributes, opened["article"] + opened["main"] > 0)
        stack.append(_Open(tag, len(pieces), why, token[0]))
        opened[tag] += 1
    if at < len(html):
        pieces.append((html[at:], breaks))
    while stack:
        close()
    design = xxh64_intdigest("\n".join(sorted(outer)).encode("utf-8", "surrogatepass"))
    return Page(done, pieces, design or 1)


def _held(x: Element, e: Element) -> bool:
    return e.first <= x.first and x.last <= e.last and x.depth > e.depth


def _wrappers(elements: list[Element], pieces: list[tuple[str, bool]]) -> set[Element]:
    """Elements that their tag or words rule out, but that stand around the text of the page.

    That is around a main, or around the longest article and the larger part of the main that it is
    in, if any. A form or an element known by its words also is one if it holds, outside links and
    outside what is ruled out within it, more than half of the page's text; where main or article
    exist, more than four fifths of theirs.
    """
    never = [e for e in elements if e.never and e.last > e.first]
    if not never:
        return set()
    sizes = np.array([len("".join(p.split())) for p, _ in pieces])
    roots = [e for e in elements if e.tag in ("article", "main") and sizes[e.first : e.last].any()]
    spared: set[Element] = set()
    if roots:
        mains = [x for x in roots if x.tag == "main"]
        longest = max((x for x in roots if x.tag == "article"), key=lambda x: (sizes[x.first : x.last].sum(), -x.depth), default=None)
        for e in never:
            part = 2 * sizes[e.first : e.last].sum()
            if any(_held(x, e) for x in mains) or longest and _held(longest, e) and all(part > sizes[x.first : x.last].sum() for x in mains if _held(e, x)):
                spared.add(e)
        inside = np.zeros(len(pieces), bool)
        for x in roots:
            inside[x.first : x.last] = True
        sizes *= inside
    for e in elements:
        if e.tag in ("a", "head"):
            sizes[e.first : e.last] = 0
    share = 0.8 if roots else 0.5
    for e in never:  # in order of their ends: inner ones first
        own = sizes[e.first : e.last]
        if e.words and own.sum() > share * sizes.sum():
            spared.add(e)
        elif e not in spared:
            own[:] = 0
    return spared


def _extent(elements: list[Element], tags: tuple[str, ...], n: int) -> np.ndarray:
    """Pieces within elements of these tags."""
    out = np.zeros(n, bool)
    for e in elements:
        if e.tag in tags:
            out[e.first : e.last] = True
    return out


def _root(elements: list[Element], sizes: np.ndarray) -> np.ndarray:
    """Which pieces the text is taken from; ``sizes`` are what is left of them.

    Articles, if they hold the larger part of main or, without one, of the page; else that. A main
    beside which articles hold more than half as much counts as one of them.
    """

    articles, mains = (_extent(elements, (tag,), len(sizes)) for tag in ("article", "main"))
    whole = np.ones(len(sizes), bool)
    if sizes[mains].sum() > 0 and 2 * sizes[articles & ~mains].sum() <= sizes[mains].sum():
        whole, part = mains, articles & mains
    else:
        part = articles | mains
    return part if 2 * sizes[part].sum() > sizes[whole].sum() else whole


def main_text(html: str, templates: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text, joined by an empty line."""
    return text_of(parse(html), templates)


def text_of(page: Page, templates: frozenset[int]) -> str:
    elements, pieces, _ = page
    if not pieces:
        return ""
    gone, repeated = np.zeros((2, len(pieces)), bool)
    spared = _wrappers(elements, pieces)
    for e in elements:
        if e.never and e.last > e.first and e not in spared:
            gone[e.first : e.last] = True
    lengths = np.array([len("".join(p.split())) for p, _ in pieces])
    inner = _extent(elements, ("article", "main"), len(pieces))
    often = [e for e in elements if e.hash in templates and _may_repeat(e)]
    for e in often:
        if not inner[e.first : e.last].any():
            gone[e.first : e.last] = True
        elif e.tag in CONTAINERS and e.full:
            repeated[e.first : e.last] = True
    root = _root(elements, lengths * ~gone)
    left = lengths * ~gone
    for e in reversed(elements):  # outer ones first
        if e.tag in ("article", "main") and 2 * (left * repeated)[e.first : e.last].sum() > left[e.first : e.last].sum():
            repeated[e.first : e.last] = False
    gone |= repeated
    keep = ~gone & root
    blocks: list[list[str]] = []
    breaks = True
    for i in range(len(pieces)):
        breaks = breaks or pieces[i][1]
        if keep[i]:
            if breaks:
                blocks.append([])
            blocks[-1].append(pieces[i][0])
            breaks = False
    texts = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _may_repeat(e: Element) -> bool:
    """Whether an element may be template; what is within a line never is."""
    return e.tag in BLOCKS and e.tag not in ("html", "body", "article", "main") and e.last > e.first


def candidates(page: Page) -> set[int]:
    """Hashes of the elements that may be template somewhere."""
    return {e.hash for e in page.elements if _may_repeat(e)}


def host_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """host, templates: (design, hash) of the subtrees that are its template; ``WHOLE`` is any design."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            hosts, designs, hashes, marks = [], [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = parse(html)
                own = candidates(page)
                # One row without a hash stands for the page itself.
                mark = xxh64_intdigest("".join(p for p, _ in page.pieces).encode("utf-8", "surrogatepass"))
                hosts += [host] * (len(own) + 1)
                designs += [page.design] * (len(own) + 1)
                hashes += [*own, 0]
                marks += [mark] * (len(own) + 1)
            numbers = [pa.array(signed(np.array(x, np.uint64))) for x in (designs, hashes, marks)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *numbers], ["host", "design", "hash", "mark"])

    found = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = found.mapInArrow(run, "host string, design long, hash long, mark long")
    counts = found.distinct().groupBy("host", "design", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts)  # several steps read it, and pages are parsed once
    whole = counts.groupBy("host", "hash").agg(F.sum("n").alias("n")).withColumn("design", F.lit(WHOLE).cast("long"))
    of_host = whole.filter("hash = 0").select("host", F.col("n").alias("host_pages"))
    of_design = counts.filter("hash = 0").select("host", "design", F.col("n").alias("pages"))
    of_design = of_design.join(of_host, "host").filter(F.col("pages") >= DESIGN_SHARE * F.col("host_pages")).drop("host_pages")
    of_design = of_design.unionByName(of_host.select("host", F.lit(WHOLE).cast("long").alias("design"), F.col("host_pages").alias("pages")))
    every = counts.unionByName(whole).filter((F.col("hash") != 0) & (F.col("n") >= least_pages))
    often = every.join(of_design, ["host", "design"]).filter(F.col("n") > share * F.col("pages"))
    return settle(often.groupBy("host").agg(F.collect_set(F.struct("design", "hash")).alias("templates")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, frozenset[int]]] = {}
        for batch in slices(batches, "html"):
            texts = []
            for host, html, lists in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("templates")):
                if host not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[host] = _by_design(lists)
                page, own = parse(html), known[host]
                texts.append(text_of(page, own.get(page.design, own[WHOLE])))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    met = own.withColumn("host", host_of(F.col("url"))).join(host_templates(pages), "host", "left")
    return met.select("page_id", "url", "host", "html", "templates").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _by_design(lists: pa.ListScalar) -> dict[int, frozenset[int]]:
    """Template hashes of each design of a host, those of the whole host among them."""
    found: dict[int, set[int]] = {WHOLE: set()}
    for row in lists.as_py() or ():
        found.setdefault(row["design"] % (1 << 64), set()).add(row["hash"] % (1 << 64))
    return {design: frozenset(hashes | found[WHOLE]) for design, hashes in found.items()}
