"""In-task helper: one page of HTML to a flat tree, and selectors over that tree.

Spark decides which page meets which selectors; these functions only handle one page.
Tree repair is limited to void tags and implied end tags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset(("script", "style"))
# Opening one of the values ends an open element of the key.
ENDED_BY = {
    "p": frozenset(
        "p div ul ol dl table h1 h2 h3 h4 h5 h6 pre form section article aside "
        "header footer nav main blockquote address fieldset hr".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "option": frozenset(("option", "optgroup")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "head": frozenset(("body",)),
}

_MARKUP = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*+)"""
    r"""([^>"'=]*+(?:(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])[^>"'=]*+)*+)>"""
    r"""|!--.*?(?:-->|\Z)|[!?][^>]*>)""",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""", re.S
)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    start: int
    first_piece: int
    attrs: dict
    last: int = -1
    end: int = -1
    end_piece: int = 0


@dataclass(slots=True)
class Page:
    html: str
    nodes: list = field(default_factory=list)
    pieces: list = field(default_factory=list)
    ids: dict | None = None
    classes: dict | None = None
    tags: dict | None = None

    def text(self, i: int) -> str | None:
        """Stripped text pieces of the element joined by one blank; NULL when there are none."""
        node = self.nodes[i]
        own = node.tag if node.tag in RAW_TEXT else None
        parts = self.pieces[node.first_piece : node.end_piece]
        return " ".join([text for kind, text in parts if kind == own]) or None

    def among(self, test: tuple):
        """Positions that can pass a tag, id or class test, in document order; all for others."""
        kind, name, value = test
        if kind == "=" and name == "id":
            if self.ids is None:
                self.ids = {}
                for i, node in enumerate(self.nodes):
                    if node.attrs and (ident := node.attrs.get("id")) is not None:
                        self.ids.setdefault(ident, []).append(i)
            return self.ids.get(value, ())
        if kind == "~=" and name == "class":
            if self.classes is None:
                self.classes = {}
                for i, node in enumerate(self.nodes):
                    if node.attrs and (own := node.attrs.get("class")):
                        for each in set(own.split()):
                            self.classes.setdefault(each, []).append(i)
            return self.classes.get(value, ())
        if kind == "tag" and name != "*":
            if self.tags is None:
                self.tags = {}
                for i, node in enumerate(self.nodes):
                    self.tags.setdefault(node.tag, []).append(i)
            return self.tags.get(name, ())
        return range(len(self.nodes))


def _attributes(source: str) -> dict:
    # Most tags have one attribute, in lower case and double quotes.
    if (one := _ONE_ATTRIBUTE.fullmatch(source)) is not None:
        return {one[1]: one[2]}
    found: dict = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in _QUOTES:
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


_ONE_ATTRIBUTE = re.compile(r"""\s++([a-z][a-z0-9-]*+)="([^"&]*+)"\s*+""")
_QUOTES = frozenset("\"'")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TEXT}
_NOTHING: dict = {}
_ENDED = ENDED_BY.get


def read_page(html: str) -> Page:
    """Flat tree in document order; ``last`` and ``end`` close each element's range."""
    page = Page(html)
    nodes, pieces = page.nodes, page.pieces
    stack: list[Node] = []
    places: list[int] = [-1]  # positions of the nodes on the stack, after that of no node
    cursor = 0  # end of the markup read so far

    def close(depth: int, at: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            places.pop()
            node.last, node.end, node.end_piece = len(nodes) - 1, at, len(pieces)

    for m in _MARKUP.finditer(html):
        start, end = m.span()
        if start > cursor:
            text = html[cursor:start].strip()
            if text:
                if "&" in text:
                    text = unescape(text).strip()
                if text:
                    pieces.append((None, text))
        elif start < cursor:
            continue  # inside the raw text of a script or style
        cursor = end
        closing, tag, source = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if stack and stack[-1].tag == tag:
                node = stack.pop()
                places.pop()
                node.last, node.end, node.end_piece = len(nodes) - 1, end, len(pieces)
                continue
            for depth in range(len(stack) - 2, -1, -1):
                if stack[depth].tag == tag:
                    close(depth + 1, start)
                    close(depth, end)
                    break
            continue
        while stack and (ending := _ENDED(stack[-1].tag)) is not None and tag in ending:
            close(len(stack) - 1, start)
        node = Node(tag, places[-1], start, len(pieces), _attributes(source) if source else _NOTHING)
        nodes.append(node)
        if tag in VOID or source[-1:] == "/":
            node.last, node.end, node.end_piece = len(nodes) - 1, end, len(pieces)
        elif tag in RAW_TEXT:
            stop = _RAW_END[tag].search(html, cursor)
            text = html[cursor : stop.start() if stop else len(html)].strip()
            if text:
                pieces.append((tag, text))
            cursor = stop.end() if stop else len(html)
            node.last, node.end, node.end_piece = len(nodes) - 1, cursor, len(pieces)
        else:
            stack.append(node)
            places.append(len(nodes) - 1)
    if cursor < len(html) and (text := unescape(html[cursor:]).strip()):
        pieces.append((None, text))
    close(0, len(html))
    return page


# ---------------------------------------------------------------- selectors

_STEP = re.compile(r"\s*([>]|\s|^)\s*((?:[^\s>\[(]|\[[^\]]*\]|\([^)]*\))+)")
_PART = re.compile(
    r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)"""
    r"""|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*)?\]"""
    r"""|:(first-child|first-of-type|nth-child\(\s*\d+\s*\)|nth-of-type\(\s*\d+\s*\))"""
)


class BadSelector(ValueError):
    """The selector uses syntax outside the supported grammar."""


@lru_cache(maxsize=4096)
def compile_selector(text: str) -> tuple:
    """Alternatives of steps; a step is (combinator, tests). Raises ``BadSelector``."""
    alternatives = []
    for chunk in re.split(r",(?![^\[]*\])", text):
        chunk, steps, at = chunk.strip(), [], 0
        while at < len(chunk):
            m = _STEP.match(chunk, at)
            if m is None:
                raise BadSelector(text)
            steps.append((">" if m.group(1) == ">" else " ", _compile_compound(m.group(2), text)))
            at = m.end()
        if not steps or chunk.startswith(">"):
            raise BadSelector(text)
        alternatives.append(tuple(steps))
    return tuple(alternatives)


def _compile_compound(source: str, whole: str) -> tuple:
    tests, at = [], 0
    while at < len(source):
        m = _PART.match(source, at)
        if m is None or (m.group(1) and at):
            raise BadSelector(whole)
        tag, ident, cls, name, op, v1, v2, v3, position = m.groups()
        if tag:
            tests.append(("tag", tag.lower(), None))
        elif ident:
            tests.append(("=", "id", ident))
        elif cls:
            tests.append(("~=", "class", cls))
        elif name:
            value = next((v for v in (v1, v2, v3) if v is not None), None)
            tests.append((op or "has", name.lower(), value))
        else:
            number = re.search(r"\d+", position)
            kind = "of-type" if "of-type" in position else "child"
            tests.append((kind, int(number.group()) if number else 1, None))
        at = m.end()
    return tuple(tests)


def _passes(page: Page, i: int, tests: tuple) -> bool:
    node = page.nodes[i]
    for kind, name, value in tests:
        if kind == "tag":
            if name not in ("*", node.tag):
                return False
            continue
        if kind in ("child", "of-type"):
            rank = sum(
                1
                for j in range(node.parent + 1, i + 1)
                if page.nodes[j].parent == node.parent
                and (kind == "child" or page.nodes[j].tag == node.tag)
            )
            if rank != name:
                return False
            continue
        actual = node.attrs.get(name)
        if actual is None:
            return False
        if kind == "has":
            continue
        if kind == "=":
            ok = actual == value
        elif kind == "~=":
            ok = value in actual.split()
        elif kind == "*=":
            ok = value != "" and value in actual
        elif kind == "^=":
            ok = value != "" and actual.startswith(value)
        elif kind == "$=":
            ok = value != "" and actual.endswith(value)
        else:  # "|="
            ok = actual == value or actual.startswith(value + "-")
        if not ok:
            return False
    return True


def _matches(page: Page, i: int, steps: tuple) -> bool:
    if not _passes(page, i, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    up = page.nodes[i].parent
    while up >= 0:
        if _matches(page, up, steps[:-1]):
            return True
        if steps[-1][0] == ">":
            return False
        up = page.nodes[up].parent
    return False


def select_first(page: Page, selector: str) -> int | None:
    """Index of the first element in document order that the selector matches."""
    found = []
    for steps in compile_selector(selector):
        # Any test of the last step narrows the search; the first is tag, id or class as a rule.
        for i in page.among(steps[-1][1][0]):
            if _matches(page, i, steps):
                found.append(i)
                break
    return min(found, default=None)


def extract_fields(page: Page, selectors: dict) -> dict:
    """field -> text of the first match. A missing, unmatched or bad selector gives NULL."""
    values: dict = {}
    for name, selector in selectors.items():
        values[name] = None
        if selector:
            try:
                found = select_first(page, selector)
            except BadSelector:
                continue
            if found is not None:
                values[name] = page.text(found)
    return values


# ---------------------------------------------------------------- content sections

# Elements removed before a section is chosen.
NOISE_TAGS = frozenset(
    ("script", "style", "noscript", "svg", "iframe", "link", "meta", "head")
)
# Content sections in order of preference.
SECTION_SELECTORS = (
    "[itemtype*='Product']",
    "main",
    "[role='main']",
    "#product",
    ".product",
    "#pdp",
    ".pdp",
    "article",
    ".product-detail",
    ".product-page",
)
# Text a page in lower case must have for each of them to find anything, as long as no entity hides it.
_SECTION_SIGNS = ("itemtype", "<main", "role", "product", "product", "pdp", "pdp", "<article", "product-detail", "product-page")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def clean_page(page: Page) -> list:
    """Source ranges of noise and hidden elements (outermost only), in order."""
    ranges: list = []
    for node in page.nodes:
        if ranges and node.start < ranges[-1][1]:
            continue
        if node.tag in NOISE_TAGS or _HIDDEN.search(node.attrs.get("style", "")):
            ranges.append((node.start, node.end))
    return ranges


def without(html: str, ranges: list, start: int, end: int) -> str:
    """``html[start:end]`` minus the ranges."""
    kept, at = [], start
    for a, b in ranges:
        if b <= at:
            continue
        if a >= end:
            break
        kept.append(html[at : max(a, at)])
        at = b
    kept.append(html[at:end] if at < end else "")
    return "".join(kept)


def content_section(html: str, max_chars: int, min_chars: int) -> tuple[str, str | None, str]:
    """(cleaned page, selector of the chosen section or NULL, section cut to the limit)."""
    page = read_page(html)
    ranges = clean_page(page)
    cleaned = without(html, ranges, 0, len(html))
    chosen, content = None, cleaned
    low, hidden = cleaned.lower(), "&#" in cleaned
    likely = [s for s, sign in zip(SECTION_SELECTORS, _SECTION_SIGNS) if hidden or sign in low]
    # The parse is repeated on the cleaned text so removed elements cannot be selected.
    clean_tree = read_page(cleaned) if ranges and likely else page
    for selector in likely:
        found = select_first(clean_tree, selector)
        if found is not None:
            node = clean_tree.nodes[found]
            section = cleaned[node.start : node.end]
            if len(section) > min_chars:
                chosen, content = selector, section
                break
    if len(content) > max_chars:
        content = content[:max_chars] + "... [truncated]"
    return cleaned, chosen, content
