"""In-task helper: the skeleton of one page, its start tags as lines.

One scan of the page finds the tags; most of them have no kept attribute and cost no more.
"""

from __future__ import annotations

import re

import pyarrow as pa

# Subtrees that never count, and the attributes that do.
REMOVED_TAGS = ("script", "style", "noscript", "svg", "img", "iframe")
KEPT_ATTRIBUTES = ("aria-label", "class", "data-testid", "id", "name", "role", "type")

#: Bytes of a batch that are Python objects at a time.
SLICE_BYTES = 4 << 20


def _subtrees(tags: tuple[str, ...]) -> re.Pattern:
    """Pattern that swallows comments and whole elements of the given tags in one scan."""
    elements = "|".join(rf"{tag}(?:\s+(?:[^>]*[^>/\s]\s*)?)?>.*?(?:</{tag}\s*>|\Z)" for tag in tags)
    # One leading character for all alternatives, so other text is passed over quickly.
    return re.compile(rf"<(?:!--.*?(?:-->|\Z)|{elements})", re.A | re.I | re.S)


_SOURCE = ("script", "style")
# img is void: it has no subtree, and like all removed tags it is no start tag here.
_REMOVED = tuple(t for t in REMOVED_TAGS if t != "img")
_SOURCE_SUBTREES, _REMOVED_SUBTREES = _subtrees(_SOURCE), _subtrees(_REMOVED)
# What a page must have for these to find anything, and to be searched for as plain text.
_SOURCE_SIGNS = ("<!--", *(f"<{t}" for t in _SOURCE))
_REMOVED_SIGNS = ("<!--", *(f"<{t}" for t in _REMOVED))

# Elements that may hold their own kind: an element of one with another inside, and an innermost one.
_NESTING = "svg|noscript|iframe"
_OPENS = re.compile(rf"<(?:{_NESTING})[\s/>]", re.A | re.I)
_OPEN = rf"<({_NESTING})(?:\s[^>]*+)?+>(?:(?!</?\1[\s/>]).)*+"
_NESTED = re.compile(_OPEN + r"<\1[\s/>]", re.A | re.I | re.S)
_INNERMOST = re.compile(_OPEN + r"</\1\s*+>", re.A | re.I | re.S)

# Name and attributes of a start tag.
_START_TAG = re.compile(
    r"""<(?!(?:%s)[\s/>])([a-z][^\s/>]*+)([^>"'=]*+(?:(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])[^>"'=]*+)*+)>"""
    % "|".join(REMOVED_TAGS),
    re.A | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""", re.A)
# A vertical tab is white space to the pattern, but not between a name, its "=" and its value.
_ATTRIBUTE_VT = re.compile(
    r"""([^\s=/"'>]++(?:[ \t\n\r\f]*+\x0b\s*+(?==))?+)(?:\s*+=[ \t\n\r\f]*+((?:\x0b\s*+)?+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)))?+""", re.A
)
_MENTIONS_KEPT = re.compile(r"""[\s"'/](?:%s)[\s=/>]""" % "|".join(KEPT_ATTRIBUTES), re.A | re.I)
_SPACE = re.compile(r"\s+", re.A)
_KEPT = frozenset(KEPT_ATTRIBUTES)
_QUOTES = frozenset("\"'")


def _without_nested(text: str) -> str:
    """Take out innermost elements as often as elements of these kinds open; few pages need it."""
    if not _NESTED.search(text):
        return text
    for _ in range(max(len(_OPENS.findall(text)), 1)):
        text, count = _INNERMOST.subn("", text)
        if not count:
            break
    return text


def _visible(html: str) -> str:
    """The page without comments and removed subtrees."""
    low = html.lower()
    if any([sign in low for sign in _SOURCE_SIGNS]):
        html = _SOURCE_SUBTREES.sub("", html)
        low = html.lower()
    if any([sign in low for sign in _REMOVED_SIGNS]):
        html = _REMOVED_SUBTREES.sub("", _without_nested(html))
    return html


def _shown(kept: dict[str, str]) -> str:
    """``"name": value`` of attributes, by name; classes as a sorted list, an empty list as nothing."""
    shown = []
    for name in sorted(kept) if len(kept) > 1 else kept:
        value = kept[name]
        if name != "class":
            shown.append(f'"{name}": "{value}"')
            continue
        if _SPACE.search(value):
            value = '", "'.join(sorted([c for c in _SPACE.split(value) if c]))
        if value:
            shown.append(f'"class": ["{value}"]')
    return ", ".join(shown)


def skeleton_lines(html: str | None) -> list[str] | None:
    """One line per start tag, in document order."""
    if html is None:
        return None
    lines = []
    attributes = (_ATTRIBUTE_VT if "\x0b" in html else _ATTRIBUTE).findall
    for tag, rest in _START_TAG.findall(_visible(html)):
        # After a plain name only attributes are left; another name may hide some, or have a value.
        plain = tag.isalnum()
        if plain and not rest:
            lines.append(tag.lower() + ":{}")
            continue
        kept: dict[str, str] = {}
        plain = plain and rest.lstrip()[:1] != "="
        for name, value in attributes(rest if plain else f"<{tag}{rest}"):
            name = name.lower()
            if name in _KEPT and name not in kept:
                kept[name] = value[1:-1] if value[:1] in _QUOTES else value
        if kept and _MENTIONS_KEPT.search(f"<{tag}{rest}>"):
            lines.append(f"{tag.lower()}:{{{_shown(kept)}}}")
        else:
            lines.append(tag.lower() + ":{}")
    return lines


def lines_of(pages: pa.Array) -> pa.Array:
    """``skeleton_lines`` of a column of pages, some megabytes of them as Python objects at a time."""
    rows = max(1, len(pages) * SLICE_BYTES // max(pages.nbytes, 1))
    found = []
    for low in range(0, len(pages), rows):
        found.append(pa.array([skeleton_lines(html) for html in _texts(pages.slice(low, rows))], pa.list_(pa.string())))
    return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))


def _texts(column: pa.Array) -> list:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:  # a broken text is read as Spark reads it
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]
