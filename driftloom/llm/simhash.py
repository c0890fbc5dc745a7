"""SimHash near-duplicates: fingerprints meet in the middle of the ball that links them.

Two fingerprints differ in at most ``2 * HALF`` bits exactly if some third value lies within
``HALF`` bits of both. So every fingerprint is sent to all values within half the radius, and
those that arrive at one value are neighbours of each other: linking each with the next one
there loses no link and needs no pairs. A value is met by at most as many fingerprints as its
ball holds (2,081), whatever the data.

Before that, fingerprints without any partner are set aside by an exact test, since a ball is
2,081 rows: of ten blocks, four differing bits leave six blocks equal. A fingerprint that shares
no choice of six blocks with another has no link. Each task marks those that meet in it and
sends on one of them per choice, so what many fingerprints share arrives as a few rows per task.

Nulls and texts without words have fingerprint zero, linked like any other. Rows with equal
doc_id are rows of their own, each in the component of its fingerprint. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from xxhash import xxh64_intdigest

from driftloom.llm.common import ODD, bytes_of, ids_and_texts, mixed, signed, slices, word_bounds
from driftloom.llm.components import components
from driftloom.storage import settle

SHINGLE_WORDS = 4
SEED = 42
HALF = 2
BLOCKS = 10
#: Rows that one task makes of the fingerprints it gets, about.
TASK_ROWS = 1 << 20
_FEW = 256
_MANY = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between, and their new starts and ends."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + inner] = data[np.repeat(starts, sizes) + inner]
    return out.tobytes(), to, to + sizes


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row: the majority of its shingles' bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, rows = bytes_of(batch.column("text"))
            data = _LOWER[data]
            starts, ends, firsts = word_bounds(data, rows)
            text, starts, ends = _joined(data, starts, ends)
            low, high = starts.tolist(), ends.tolist()
            fps = np.zeros(batch.num_rows, np.uint64)
            for row, (a, b) in enumerate(zip(firsts.tolist(), firsts[1:].tolist())):
                if a == b:
                    continue
                last = high[a + words - 1 : b] or [high[b - 1]]
                hashes = np.array([xxh64_intdigest(text[s:e], seed) for s, e in zip(low[a:b], last)], "<u8")
                ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fps[row] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(fps))], ["doc_id", "fp"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, fp long")


def _block_masks() -> np.ndarray:
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return np.array([sum(chosen) for chosen in combinations(blocks, BLOCKS - 2 * HALF)], np.uint64)


def _ball() -> np.ndarray:
    """All 64-bit patterns with at most HALF ones."""
    return np.array([sum(1 << i for i in chosen) for n in range(HALF + 1) for chosen in combinations(range(64), n)], np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        every = np.asarray(batch.column("fp")).view(np.uint64)
        for low in range(0, len(every), size):
            yield every[low : low + size]


def _spread(fps: DataFrame, rows: int) -> DataFrame:
    """``fps`` (stored) dealt out for a step that makes ``rows`` rows of each; no task makes many more than others."""
    tasks = -(-fps.count() * rows // TASK_ROWS)
    return fps.repartition(max(tasks, fps.sparkSession.sparkContext.defaultParallelism))


def with_partners(fps: DataFrame) -> DataFrame:
    """Those of the distinct ``fps`` that share a choice of blocks with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _block_masks()
        # A choice's number is mixed in, so equal bits under different choices stay apart.
        tags = np.arange(len(masks), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for own in _chunks(batches, _MANY):
            at = (((own[:, None] & masks) * ODD) ^ tags).reshape(-1)
            order = np.argsort(at, kind="stable")
            same = at[order[1:]] == at[order[:-1]]
            sure = np.zeros(len(at), bool)
            sure[order[1:][same]] = sure[order[:-1][same]] = True
            met = np.unique(own[sure.reshape(len(own), -1).any(1)])
            first = order[np.append(True, ~same)]
            sent = own[first // len(masks)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate([at[first], mixed(met)]))),
                    pa.array(signed(np.concatenate([sent, met]))),
                    pa.array(np.repeat([False, True], [len(sent), len(met)])),
                ],
                ["at", "fp", "sure"],
            )

    keyed = _spread(fps.select("fp"), len(_block_masks())).mapInArrow(run, "at long, fp long, sure boolean")
    meet = Window.partitionBy("at").orderBy("fp")
    found = keyed.withColumn("left", F.lag("fp").over(meet)).withColumn("right", F.lead("fp").over(meet))
    return found.filter("sure OR left <> fp OR right <> fp").select("fp").distinct()


def _arrived(fps: DataFrame) -> DataFrame:
    """at, fp: each fingerprint at all values within half the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball()
        for own in _chunks(batches, _FEW):
            yield pa.RecordBatch.from_arrays([pa.array(signed((own[:, None] ^ ball).reshape(-1))), pa.array(signed(np.repeat(own, len(ball))))], ["at", "fp"])

    return _spread(fps, len(_ball())).mapInArrow(run, "at long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """a < b: enough pairs of distinct ``fps`` within 2 * HALF bits to connect all such pairs."""
    arrived = _arrived(settle(with_partners(fps)))
    before = F.lag("fp").over(Window.partitionBy("at").orderBy("fp"))
    met = arrived.select(before.alias("a"), F.col("fp").alias("b")).filter("a is not null")
    return met.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * HALF)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _named(prints: DataFrame) -> DataFrame:
    """fp, whole (the component's least fingerprint), component_id (its least doc_id, if any has one); stored."""
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes))
    wholes = nodes.join(found.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("whole"))
    least = wholes.groupBy("whole").agg(F.min("first").alias("component_id"))
    return settle(wholes.join(least, "whole").select("fp", "whole", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links."""
    prints = settle(fingerprints(docs))
    return prints.join(_named(prints), "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: of the least doc_id, then fingerprint, then content.

    Rows without a doc_id come last. Ids that one row has are compared without texts; only rows
    that share an id, or have none, meet with their content.
    """
    prints = settle(fingerprints(docs))
    rows = prints.join(_named(prints), "fp").select("doc_id", "fp", "whole")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best")
    chosen = settle(rows.groupBy("whole").agg(best).select("best.doc_id", "best.fp"))
    several = settle(prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    dropped = rows.select("doc_id", "fp").join(chosen, ["doc_id", "fp"], "left_anti").select("doc_id").unionAll(several)
    once = docs.filter("doc_id IS NOT NULL").join(dropped.filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(*docs.columns)

    own = F.struct(*[F.col(c) for c in docs.columns])
    shared = docs.join(several, "doc_id", "left_semi").select(*docs.columns).unionAll(docs.filter("doc_id IS NULL"))
    # The texts' fingerprints, by the texts themselves: rows of one id may have several.
    texts = shared.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    marks = fingerprints(texts.select(F.col("mark").alias("doc_id"), "text")).distinct().select(F.col("doc_id").alias("mark"), "fp")
    met = shared.select(own.alias("own"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).join(marks, "mark")
    # By their text, as columns may be of kinds that have no order.
    first = met.groupBy("id", "fp").agg(F.min_by("own", F.to_json("own")).alias("own"))
    kept = first.join(chosen.withColumnRenamed("fp", "print"), (F.col("fp") == F.col("print")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return once.unionAll(kept.select("own.*"))
