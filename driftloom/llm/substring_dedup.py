"""Substring deduplication by anchored block matching, in place of a relative Lempel-Ziv parse.

Every text is cut into blocks at sampled anchors: of the word shingles inside a window the one
with the least hash is its anchor, and the windows with one anchor form a block. Equal windows
have equal anchors at equal places, so a document need only meet the blocks that share an anchor
with it. No longest factors are formed: a block that stands whole in an earlier document is a
copy. Only in blocks whose anchor occurs but which differ somewhere are the single windows looked
up. Windows of a copied block or found by themselves are the duplicate spans; the result is
that of looking up every window, at a fraction of the rows.

Rows are sorted per anchor, not gathered. Before the shuffle each task settles what it can see
alone: of equal blocks only the first is sent on, and of one anchor at most two different blocks,
so a passage that a third of all rows share arrives as a few rows from every task.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f, \\r. Texts of fewer words than a
window lose nothing. Nulls are empty texts. Rows that share a doc_id are judged each on its own
text and never against each other; rows without one count as the smallest id. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import ODD, Powers, bytes_of, ids_and_texts, signed, slices, word_bounds
from driftloom.storage import settle

WINDOW = 20
ANCHOR_WORDS = 5
#: Rows that a task holds at once to settle equal ones among them.
HELD_ROWS = 400_000
NO_ID = -(1 << 63)
COPY, CHECK, OPEN = 0, 1, 2

_LETTERS, _WORDS, _SHINGLES = Powers(0x5851F42D4C957F2D, 1), Powers(0x2545F4914F6CDD1D, 2), Powers(0x9E6C63D0876A9A35, 3)


class Parsed:
    """The words of a slice of texts, the hashes of their windows, and the blocks these fall into."""

    def __init__(self, column: pa.Array, window: int, anchor: int):
        self.data, self.rows = bytes_of(column)
        self.starts, self.ends, self.firsts = word_bounds(self.data, self.rows)
        letters = _LETTERS.prefix(_LETTERS.letters[self.data])
        self.words = _LETTERS.between(letters, self.starts, self.ends)
        self.prefix = _WORDS.prefix(self.words)
        #: Sixteen bits of each text's own hash, to tell apart the rows that share a doc_id.
        self.tags = (_LETTERS.between(letters, self.rows[:-1], self.rows[1:]) >> np.uint64(48)).astype(np.int64)
        counts = np.diff(self.firsts)
        # Windows that lie within one text, and the text of each.
        full = np.maximum(counts - window + 1, 0)
        self.text = np.repeat(np.arange(len(counts)), full)
        self.at = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full) + np.repeat(self.firsts[:-1], full)
        self.windows = _WORDS.between(self.prefix, self.at, self.at + window)
        self.window, self.anchor = window, anchor

    def blocks(self) -> tuple[np.ndarray, ...]:
        """Text, anchor hash, block hash, first window (word of its text) and windows of each block."""
        if not len(self.at):
            none = np.zeros(0, np.int64)
            return none, none.astype(np.uint64), none.astype(np.uint64), none, none
        total, reach = len(self.prefix) - 1, self.window - self.anchor + 1
        shingles = _WORDS.between(self.prefix, np.arange(total - self.anchor + 1), np.arange(self.anchor, total + 1))
        best = self.at.copy()
        least = shingles[best]
        for step in range(1, reach):
            other = shingles[self.at + step]
            less = other < least
            best[less] = self.at[less] + step
            least[less] = other[less]
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (self.text[1:] != self.text[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(best)))
        low, high = self.at[head], self.at[head] + n + self.window - 1
        inner = (best[head] - low).astype(np.uint64)
        block = _SHINGLES.base * _WORDS.between(self.prefix, low, high) + inner
        return self.text[head], least[head], block, low - self.firsts[self.text[head]], n


def _place(start: np.ndarray, tag: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """First word, the text's tag and a count below 256, as one number."""
    return (start << 24) | (tag << 8) | n


def _firsts(anchor: np.ndarray, block: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, block, doc); in it: not in the earliest doc; new block; place of the block in its anchor."""
    order = np.lexsort((doc, block, anchor))
    anchor, block, doc = anchor[order], block[order], doc[order]
    turn = np.ones(len(order), bool)
    turn[1:] = anchor[1:] != anchor[:-1]
    new = turn.copy()
    new[1:] |= block[1:] != block[:-1]
    first = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    kind = np.cumsum(new)
    return order, doc > first, new, kind - kind[np.maximum.accumulate(np.where(turn, np.arange(len(turn)), 0))]


_ROWS = "anchor long, block long, doc long, place long, state int"


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _ROWS.split(", ")])


def _settled(parts: list[tuple[np.ndarray, ...]], several: bool) -> pa.RecordBatch:
    """What a task can say alone about the rows it holds; the rest stays OPEN.

    ``several``: an anchor with two different blocks makes all its blocks CHECK.
    """
    anchor, block, doc, place = (np.concatenate(c) for c in zip(*parts))
    order, late, _, kind = _firsts(anchor, block, doc)
    state = np.where(late, COPY, np.where(kind > 1, CHECK, OPEN) if several else OPEN).astype(np.int32)
    anchor, block, doc, place = anchor[order], block[order], doc[order], place[order]
    # Settled rows need no meeting: they are dealt out by their document.
    return _batch(np.where(state == OPEN, anchor, doc), block, doc, place, state)


def _held(pieces: Iterator[tuple[np.ndarray, ...]], several: bool) -> Iterator[pa.RecordBatch]:
    parts, n = [], 0
    for piece in pieces:
        parts.append(piece)
        n += len(piece[0])
        if n >= HELD_ROWS:
            yield _settled(parts, several)
            parts, n = [], 0
    if n:
        yield _settled(parts, several)


def _met(rows: DataFrame, several: bool) -> DataFrame:
    """Decide the OPEN rows where all of one anchor meet, in sorted order: doc, place, state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(5))

        def decide(a: np.ndarray, b: np.ndarray, d: np.ndarray, p: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            is_open = s == OPEN
            out_d, out_p, out_s = [d[~is_open]], [p[~is_open]], [s[~is_open]]
            a, b, d, p = a[is_open], b[is_open], d[is_open], p[is_open]
            if len(a):
                order, late, _, kind = _firsts(a, b, d)
                a, d, p = a[order], d[order], p[order]
                last = np.append(np.flatnonzero(a[1:] != a[:-1]), len(a) - 1)
                more = np.repeat(kind[last] > 0, np.diff(np.append(-1, last)))
                keep = late | (more & several)
                out_d.append(d[keep])
                out_p.append(p[keep])
                out_s.append(np.where(late, COPY, CHECK)[keep])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_p)), pa.array(np.concatenate(out_s).astype(np.int32))], ["doc", "place", "state"]
            )

        for batch in batches:
            now = tuple(np.concatenate([x, np.asarray(c).astype(np.int64)]) for x, c in zip(rest, batch.columns))
            edge = np.searchsorted(now[0], now[0][-1], side="left") if len(now[0]) else 0
            if edge:
                yield decide(*(c[:edge] for c in now))
            rest = tuple(c[edge:] for c in now)
        if len(rest[0]):
            yield decide(*rest)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc long, place long, state int")


def parse(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc, place, state of every block that is copied (COPY) or whose anchor has other blocks (CHECK)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in slices(batches):
                parsed = Parsed(batch.column("text"), window, anchor_words)
                text, anchor, block, start, n = parsed.blocks()
                yield signed(anchor), signed(block), _docs(batch)[text], _place(start, parsed.tags[text], n)

        return _held(pieces(), True)

    return _met(ids_and_texts(docs).mapInArrow(run, _ROWS), True)


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id").fill_null(NO_ID))


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text and the places of its rows (doc-wise lists: at most one entry per word)."""
    lists = places.groupBy("doc").agg(F.collect_list("place").alias("places"))
    texts = ids_and_texts(docs).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    return texts.join(lists, "doc", "left").select("doc_id", "text", "places")


def _of_row(places: list[int] | None, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and count of the places that carry ``tag``."""
    own = np.array(places or [], np.int64)
    own = own[(own >> 8) & 0xFFFF == tag]
    return own >> 24, own & 0xFF


def boundary_windows(docs: DataFrame, parsed: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc, place (of one window) of the windows in CHECK blocks that start in an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in slices(batches):
                parsed_ = Parsed(batch.column("text"), window, anchor_words)
                first = np.searchsorted(parsed_.text, np.arange(batch.num_rows))
                docs_, picked, rows = _docs(batch), [], []
                for row, places in enumerate(batch.column("places").to_pylist()):
                    start, n = _of_row(places, parsed_.tags[row])
                    own = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    picked.append(own + first[row])
                    rows.append(np.full(len(own), row))
                if not picked or not sum(map(len, picked)):
                    continue
                at, row = np.concatenate(picked), np.concatenate(rows)
                hashes = signed(parsed_.windows[at])
                # A second base, so that two windows are equal only if 128 bits are.
                second = signed(_SHINGLES.between(_SHINGLES.prefix(parsed_.words), parsed_.at[at], parsed_.at[at] + window))
                yield hashes, second, docs_[row], _place(at - first[row], parsed_.tags[row], 1)

        return _held(pieces(), False)

    listed = _with_places(docs, parsed.filter(f"state = {CHECK}"))
    return _met(listed.filter("places is not null").mapInArrow(run, _ROWS), False).select("doc", "place")


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, kept (the words that stay, one space between), n_words, n_removed of every row."""
    parsed = settle(parse(docs, window, anchor_words))
    spans = parsed.filter(f"state = {COPY}").select("doc", "place").unionAll(boundary_windows(docs, parsed, window, anchor_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parsed_ = Parsed(batch.column("text"), window, anchor_words)
            total = len(parsed_.starts)
            edge = np.zeros(total + 1, np.int64)
            # Windows that start earlier in the same text.
            own = parsed_.windows + ODD * parsed_.text.astype(np.uint64)
            order = np.argsort(own, kind="stable")
            again = order[1:][own[order[1:]] == own[order[:-1]]]
            np.add.at(edge, parsed_.at[again], 1)
            np.add.at(edge, parsed_.at[again] + window, -1)
            for row, places in enumerate(batch.column("places").to_pylist()):
                if places:
                    start, n = _of_row(places, parsed_.tags[row])
                    np.add.at(edge, start + parsed_.firsts[row], 1)
                    np.add.at(edge, start + parsed_.firsts[row] + n + window - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            data, low, high = parsed_.data.tobytes(), parsed_.starts.tolist(), parsed_.ends.tolist()
            kept, removed = [], []
            for a, b in zip(parsed_.firsts.tolist(), parsed_.firsts[1:].tolist()):
                stays = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([data[low[i] : high[i]] for i in stays.tolist()]).decode())
                removed.append(b - a - len(stays))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(np.diff(parsed_.firsts)), pa.array(removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return _with_places(docs, spans).mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")


def digest(deduplicated: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
