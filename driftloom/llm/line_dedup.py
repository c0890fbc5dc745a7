"""Fuzzy line deduplication: MinHash bands, exact Jaccard, union-find, one line per component.

Lines are alike if the sets of their eight-character shingles have a Jaccard similarity of 0.8
or more. A signature has forty minima: of forty hashes for lines of few different shingles, of bins
of one hash for lines of many. Lines between have both, so two lines whose sets' sizes allow a
link always have one kind in common. Bands of four minima send a line to ten buckets per kind
(99.5 % of pairs at 0.8 share one, more above).

In a bucket the least line is compared with all others, and linked lines take one label. Buckets
that have lines of two labels left go through tasks whole, where each line is compared with all
lines of other labels at once, on sorted hashes of their shingles. So the links connect what all
pairs of the bucket would connect, and a bucket of lines that are alike is done after one
comparison for each. A large bucket is cut into blocks, and every two of them meet in a task of their own.

A line is what stands between newlines; white space around it is no part of the comparison, and
lines of white space alone always stay. Of each component the first line stays, by doc_id and
place: the first place of every different line is found before components are looked at, so a line
or a component that many documents have is never gathered, and documents get lists of the lines
that stay. Nulls stay null and count as no line. Rows without a doc_id come first, each as a
document of its own. Rows that share a doc_id are one document's versions: equal lines at one
place of several stay in all. An empty table gives no rows. All columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from xxhash import xxh64_intdigest

from driftloom.llm.common import ODD, Powers, ids_and_texts, mixed, release, signed, slices
from driftloom.llm.components import components
from driftloom.shipping import ship_package
from driftloom.storage import settle

SHINGLE = 8
BANDS, ROWS = 10, 4
LIKE = 0.8
NO_ID = -(1 << 63)
#: Size of the map of wanted lines that every task gets: 2**26 bits are 8 MB.
MAP_BITS = 26
#: Lines that a task remembers to send each only once.
REMEMBERED = 500_000

#: Lines of as many different shingles have bins; lines of fewer than SHORT / like have forty hashes.
SHORT = 160

#: Lines and characters of a block of a large bucket, about; a task has two blocks at once.
BLOCK_LINES, BLOCK_CHARS = 512, 4 << 20
#: Names of the columns that go with a table's own.
_DOC, _ROW, _KEPT = "_line_dedup_doc", "_line_dedup_row", "_line_dedup_kept"
_LAST = (1 << 63, 0, 0)
_BINS = BANDS * ROWS
_SEEDS = np.random.default_rng(43).integers(0, 1 << 63, _BINS, dtype=np.uint64)
_LETTERS = Powers(0xA0761D6478BD642F, 41)
_PROBES = np.array([np.random.default_rng(j).permutation(_BINS) for j in range(_BINS)])


def mark_of(line: str) -> int:
    return xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(text: str) -> list[str]:
    return [line.strip() for line in text.split("\n")]


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, one per place, and their count per line."""
    sizes = np.array([len(x) for x in lines])
    data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    prefix = _LETTERS.prefix(mixed(data.astype(np.uint64) + ODD))
    n = np.maximum(sizes - SHINGLE + 1, 1)
    at = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
    end = np.minimum(at + SHINGLE, np.repeat(starts + sizes, n))
    return _LETTERS.between(prefix, at, end), n


def _seeded(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minima of one hash for every row of the signature."""
    out = np.empty((len(n), _BINS), np.uint32)
    heads = np.cumsum(n) - n
    for column in range(_BINS if len(n) else 0):
        again = (hashes ^ _SEEDS[column]) * ODD
        out[:, column] = np.minimum.reduceat((again >> np.uint64(32)).astype(np.uint32), heads)
    return out


def _binned(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minima of bins of one hash; an empty bin borrows from another one."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(len(n) * _BINS, empty)
    np.minimum.at(out, np.repeat(np.arange(len(n)) * _BINS, n) + bins.astype(np.int64), hashes.astype(np.uint32))
    out = out.reshape(-1, _BINS)
    row, column = np.nonzero(out == empty)
    known = out.copy()
    for step in range(_BINS):
        if not len(row):
            break
        found = known[row, _PROBES[column, step]]
        good = found != empty
        out[row[good], column[good]] = found[good]
        row, column = row[~good], column[~good]
    return out


def _different(hashes: np.ndarray) -> int:
    hashes = np.sort(hashes)
    return 1 + int(np.count_nonzero(hashes[1:] != hashes[:-1]))


def signatures(lines: list[str], like: float = LIKE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, places in ``lines`` and one row of minima each, of (non-empty) lines.

    A link's smaller set has at least ``like`` times the shingles of the larger one. So with
    forty hashes below SHORT / like and bins from SHORT, no link is between lines without a
    common kind. Different shingles count, not places: a line that repeats itself has few.
    """
    hashes, n = _hashes(lines)
    heads = np.cumsum(n) - n
    few = int(SHORT / like) + 1
    first = np.ones(len(hashes), bool)  # what the forty hashes read: every shingle, or each once
    size = n.copy()
    for i in np.flatnonzero(n >= SHORT).tolist():
        own = hashes[heads[i] : heads[i] + n[i]]
        # Most long lines show enough shingles soon.
        if n[i] > 2 * few and _different(own[: 2 * few]) >= few:
            continue
        size[i] = _different(own)
        if size[i] < min(few, n[i]):
            first[heads[i] : heads[i] + n[i]] = False
            first[heads[i] + np.unique(own, return_index=True)[1]] = True
    short = size < few
    if short.any():
        yield 0, np.flatnonzero(short), _seeded(hashes[np.repeat(short, n) & first], size[short])
    long = size >= SHORT
    if long.any():
        yield 1, np.flatnonzero(long), _binned(hashes[np.repeat(long, n)], n[long])


def band_keys(lines: list[str], like: float = LIKE) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and the place in ``lines`` of the line that each is for."""
    keys, whom = [], []
    for kind, places, found in signatures(lines, like):
        found = found.astype(np.uint64).reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * kind), found.shape[:2])
        for i in range(ROWS):
            key = mixed(key * ODD + found[:, :, i])
        keys.append(key.reshape(-1))
        whom.append(np.repeat(places, BANDS))
    return np.concatenate(keys), np.concatenate(whom)


def _banded(docs: DataFrame, like: float) -> DataFrame:
    """bucket, line: every line, once per task, in its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sent: set[int] = set()
        for batch in slices(batches, limit=1 << 20):
            new = {mark_of(x): x for text in batch.column("text").to_pylist() for x in _lines(text) if x}
            for known in sent.intersection(new):
                del new[known]
            if len(sent) > REMEMBERED:
                sent.clear()
            sent.update(new)
            if new:
                keys, whom = band_keys(list(new.values()), like)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(np.array(list(new), np.int64)[whom])], ["bucket", "line"])

    return ids_and_texts(docs).mapInArrow(run, "bucket long, line long")


def _shared(members: DataFrame) -> DataFrame:
    """bucket, line, least (line of the bucket), of the buckets with more than one line."""
    bucket = Window.partitionBy("bucket").orderBy("line")
    near = members.withColumn("before", F.lag("line").over(bucket)).withColumn("after", F.lead("line").over(bucket)).withColumn("least", F.first("line").over(bucket))
    # Equal lines stand side by side: the last of the least ones tells whether others follow, and
    # the first of any other one stands behind them.
    return near.filter("before <> line OR line = least AND after <> line").select("bucket", "line", "least")


def _map_of(wanted: DataFrame) -> np.ndarray:
    """A bit map of the hashes of the wanted lines: of fixed size, and only to send less text."""
    place = F.col("line").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = wanted.select(F.shiftright(place, 5).alias("word"), F.expr("shiftleft(1L, cast(line & 31 AS INT))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    out[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).astype(np.uint32)
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """line, content of the wanted lines; stored."""
    seen = docs.sparkSession.sparkContext.broadcast(_map_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for batch in slices(batches):
            found = {mark_of(x): x for text in batch.column("text").to_pylist() for x in _lines(text) if x}
            marks = np.array(list(found), np.int64)
            place = marks & ((1 << MAP_BITS) - 1)
            good = (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(marks[good]), pa.array([found[m] for m in marks[good].tolist()], pa.string())], ["line", "content"])

    found = ids_and_texts(docs).mapInArrow(run, "line long, content string").join(wanted, "line", "left_semi")
    return settle(found.groupBy("line").agg(F.min("content").alias("content")))


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of (non-empty) lines, pair by pair."""
    number = {x: i for i, x in enumerate(dict.fromkeys([*left, *right]))}
    hashes, n = _hashes(list(number))
    line = np.repeat(np.arange(len(number)), n)
    order = np.lexsort((hashes, line))
    line, hashes = line[order], hashes[order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))
    line, hashes = line[first], hashes[first]
    sizes = np.bincount(line, minlength=len(number))
    starts = np.cumsum(sizes) - sizes
    both = np.empty(len(left), np.int64)
    for i, (x, y) in enumerate(zip((number[x] for x in left), (number[y] for y in right))):
        a, b = hashes[starts[x] : starts[x] + sizes[x]], hashes[starts[y] : starts[y] + sizes[y]]
        at = np.searchsorted(a, b)
        at[at == len(a)] = 0
        both[i] = np.count_nonzero(a[at] == b)
    x, y = (sizes[[number[t] for t in side]] for side in (left, right))
    return both / (x + y - both)


def _compared(pairs: DataFrame, texts: DataFrame, like: float) -> DataFrame:
    """a, b, alike of the pairs (0 if their lengths rule a link out); stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "right", 1 << 18):
                alike = similarities(part.column("left").to_pylist(), part.column("right").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(alike)], ["a", "b", "alike"])

    right = texts.select(F.col("line").alias("b"), F.col("content").alias("right"))
    left = texts.select(F.col("line").alias("a"), F.col("content").alias("left"))
    met = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return settle(met.mapInArrow(run, "a long, b long, alike double"))


def _relabelled(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (line, component) after two steps of taking the least label of linked lines.

    Equal labels mean one component; that more would be equal after more steps costs comparisons,
    not links. Two steps give a centre's lines one label.
    """
    both = settle(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    for _ in range(2):
        seen = both.join(named.select(F.col("line").alias("b"), "component"), "b").groupBy(F.col("a").alias("line")).agg(F.min("component").alias("least"))
        named = named.join(seen, "line", "left").select("line", F.coalesce(F.least("component", "least"), "component").alias("component"))
    return settle(named)


def line_classes(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """line, component: all lines (by hash) that share a bucket with another, and their components."""
    rest = settle(_shared(_banded(docs, like)))
    wanted = settle(rest.select("line").distinct())
    texts = _texts(docs, wanted)
    first = _compared(rest.filter("line <> least").select(F.col("least").alias("a"), F.col("line").alias("b")).distinct(), texts, like)
    links = first.filter(F.col("alike") >= like).select("a", "b")
    named = _relabelled(wanted.withColumn("component", F.col("line")), links)
    rest = _unfinished(rest.filter("line <> least").select("bucket", "line"), named)
    whole = components(links.unionAll(settle(_linked(rest, texts, like)))).select(F.col("v").alias("line"), "component")
    return wanted.join(whole, "line", "left").select("line", F.coalesce("component", "line").alias("component"))


def _unfinished(left: DataFrame, named: DataFrame) -> DataFrame:
    """bucket, line, component of the buckets that have lines of two components left; stored."""
    own = left.join(named, "line")
    bucket = Window.partitionBy("bucket")
    several = own.withColumn("low", F.min("component").over(bucket)).withColumn("high", F.max("component").over(bucket)).filter("low < high")
    return settle(several.select("bucket", "line", "component"))


def found_links(lines: list[str], labels: np.ndarray, blocks: np.ndarray, like: float) -> list[tuple[int, int]]:
    """Places in ``lines`` of links that connect what all pairs of different labels would connect.

    If there are lines of two blocks, only pairs across them count.
    """
    hashes, n = _hashes(lines)
    line = np.repeat(np.arange(len(lines)), n)
    order = np.lexsort((hashes, line))
    line, hashes = line[order], hashes[order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))
    hashes, sizes = hashes[first], np.bincount(line[first], minlength=len(lines))
    starts = np.cumsum(sizes) - sizes
    labels, across, out = labels.copy(), bool((blocks != blocks[0]).any()), []
    for i in range(len(lines) - 1):
        # Similarity is at most the smaller set's share of the larger one.
        other = labels[i + 1 :] != labels[i]
        other &= np.minimum(sizes[i + 1 :], sizes[i]) >= (like - 1e-9) * np.maximum(sizes[i + 1 :], sizes[i])
        if across:
            other &= blocks[i + 1 :] != blocks[i]
        met = np.flatnonzero(other) + i + 1
        if not len(met):
            continue
        own, counts = hashes[starts[i] : starts[i] + sizes[i]], sizes[met]
        heads = np.cumsum(counts) - counts
        theirs = hashes[np.repeat(starts[met] - heads, counts) + np.arange(int(counts.sum()))]
        at = np.searchsorted(own, theirs)
        at[at == len(own)] = 0
        both = np.add.reduceat((own[at] == theirs).astype(np.int64), heads)
        for j in met[both / (sizes[i] + counts - both) >= like].tolist():
            if labels[j] != labels[i]:
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def _linked(rest: DataFrame, texts: DataFrame, like: float) -> DataFrame:
    """a, b: links between lines of different components of a bucket."""
    chars = texts.select("line", F.length("content").alias("chars"))
    sizes = rest.join(chars, "line").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK_LINES), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    large = settle(sizes.select("bucket", cuts.alias("cuts")).filter("cuts > 1"))
    dealt = rest.join(large, "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("line"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("line", "bucket", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = dealt.join(texts, "line").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "line")
    names = ["bucket", "low", "high", "line", "component", "block", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))
        a, b = [], []
        for _, own in groupby(every, key=itemgetter(0, 1, 2)):
            *_, lines, labels, blocks, contents = zip(*own)
            if len(lines) > 1:
                for i, j in found_links(list(contents), np.array(labels), np.array(blocks), like):
                    a.append(lines[i])
                    b.append(lines[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select(*names).mapInArrow(run, "a long, b long")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with doc and row: the id, or NO_ID and a number of the row's own."""
    known = docs.filter("doc_id IS NOT NULL").select("*", F.col("doc_id").cast("long").alias(_DOC), F.lit(0).cast("long").alias(_ROW))
    # Stored, so that the numbers are the same wherever they are read.
    return known.unionAll(settle(docs.filter("doc_id IS NULL").select("*", F.lit(NO_ID).alias(_DOC), F.monotonically_increasing_id().alias(_ROW))))


def _firsts(numbered: DataFrame) -> DataFrame:
    """line and its first doc, row and place; a task sends each line it meets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[int, tuple[int, int, int]] = {}

        def close() -> pa.RecordBatch:
            columns = [list(held), *map(list, zip(*held.values()))] if held else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["line", "doc", "row", "place"])

        for batch in slices(batches):
            for doc, row, text in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                for i, x in enumerate(_lines(text)):
                    if x:
                        own, mark = (doc, row, i), mark_of(x)
                        if own < held.get(mark, _LAST):
                            held[mark] = own
            if len(held) > REMEMBERED:
                yield close()
                held.clear()
        yield close()

    ship_package(numbered.sparkSession)
    own = numbered.select(F.col(_DOC).alias("doc"), F.col(_ROW).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = own.mapInArrow(run, "line long, doc long, row long, place long")
    return found.groupBy("line").agg(F.min(F.struct("doc", "row", "place")).alias("first"))


def staying(numbered: DataFrame, like: float = LIKE) -> DataFrame:
    """doc, row, and the places and lines that stay there."""
    kinds = _firsts(numbered).join(line_classes(numbered, like), "line", "left")
    first = kinds.groupBy(F.coalesce("component", "line").alias("kind")).agg(F.min(F.struct("first", "line")).alias("x"))
    kept = first.select("x.first.doc", "x.first.row", "x.first.place", "x.line")
    return kept.groupBy("doc", "row").agg(F.collect_list("place").alias("places"), F.collect_list("line").alias("lines"))


def deduplicate(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """``docs`` with the lines that stay; texts meet their lists in one join on the id."""
    numbered = _numbered(docs)
    lists = staying(numbered, like).select(F.col("doc").alias(_DOC), F.col("row").alias(_ROW), F.struct("places", "lines").alias(_KEPT))
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column(_KEPT).to_pylist()):
                if text is not None:
                    kept = set(zip(own["places"], own["lines"])) if own else ()
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if not (y := x.strip()) or (i, mark_of(y)) in kept)
                out.append(text)
            columns = [batch.column(i) for i in range(len(schema))]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    met = numbered.join(lists, [_DOC, _ROW], "left").select(*docs.columns, _KEPT)
    return met.mapInArrow(run, schema)
