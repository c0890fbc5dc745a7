"""Context-triggered piecewise hashing: fingerprints that survive edits.

A rolling hash over the last seven bytes ends a piece wherever its low bits are all ones; how
many bits is the block size's logarithm. The signature has one symbol of twelve bits per piece.
Two signatures are kept, at the chosen block size and at twice that, so texts whose sizes differ
by a factor of two still have one size in common. The block size is the least that gives at most
63 ends and suits the length. Signatures are compared by edit distance (insertions, deletions).

A fingerprint reads ``level:signature:signature of the next level``. Nulls are empty texts; an
empty text has the fingerprint ``2::``. Empty signatures are alike only to empty ones. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Powers, ids_and_texts, slices

REACH = 7
PIECES = 64
LEAST_LEVEL = 2
NO_ID = -(1 << 63)
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PIECES = Powers(0x9FB21C651E98DF25, 7)
_ROLL = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_MULTIPLIER = np.uint32(0x6C8E944D)

Signature = tuple[int, np.ndarray, np.ndarray]


def _rolled(data: np.ndarray) -> np.ndarray:
    """Hash of the seven bytes that end at each place."""
    own = _ROLL[data]
    out = own.copy()
    for back in range(1, REACH):
        own = own * _MULTIPLIER
        out[back:] += own[:-back]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def signatures(texts: list[bytes]) -> list[Signature]:
    """Level, symbols at that level and at the next, of every text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    base = np.maximum(LEAST_LEVEL, np.floor(np.log2(np.maximum(sizes, 1) / PIECES)).astype(np.int64))
    hashes = _rolled(data) if len(data) else np.zeros(0, np.uint32)
    ones = ((np.int64(1) << np.minimum(base, 31)) - 1).astype(np.uint32)
    per_byte = np.repeat(ones, sizes)
    hit = np.flatnonzero((hashes & per_byte) == per_byte)
    text = np.searchsorted(starts, hit, side="right") - 1
    inner = hit - starts[text] >= REACH - 1
    hit, text = hit[inner], text[inner]
    # Trailing ones of the hash: the highest level at which the place still ends a piece.
    flipped = ~hashes[hit]
    low = flipped & (~flipped + np.uint32(1))
    level = np.where(low == 0, 32, np.log2(np.maximum(low, 1)).astype(np.int64))
    prefix = _PIECES.prefix(_PIECES.letters[data])
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for row in range(len(texts)):
        ends, levels = hit[at[row] : at[row + 1]] + 1, level[at[row] : at[row + 1]]
        chosen = int(base[row])
        while (levels >= chosen).sum() > PIECES - 1:
            chosen += 1
        symbols = []
        for own in (chosen, chosen + 1):
            cuts = np.unique(np.concatenate([[starts[row]], ends[levels >= own], [starts[row] + sizes[row]]]))
            symbols.append((_PIECES.between(prefix, cuts[:-1], cuts[1:]) >> np.uint64(52)).astype(np.int64))
        out.append((chosen, symbols[0], symbols[1]))
    return out


def written(signature: Signature) -> str:
    level, one, two = signature
    text = [_ALPHABET[np.stack([s >> 6, s & 63], 1).reshape(-1)].tobytes().decode() for s in (one, two)]
    return f"{level}:{text[0]}:{text[1]}"


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of at most 64 symbols.

    One bit per symbol of the left side; all pairs advance together.
    """
    n = len(left)
    a, b = np.full((n, PIECES), -1, np.int64), np.full((n, PIECES), -2, np.int64)
    for row in range(n):
        a[row, : len(left[row])], b[row, : len(right[row])] = left[row], right[row]
    bits = np.uint64(1) << np.arange(PIECES, dtype=np.uint64)
    state = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for step in range(max(map(len, right), default=0)):
        match = np.where(a == b[:, step, None], bits, np.uint64(0)).sum(1, dtype=np.uint64)
        both = state & match
        state = (state + both) | (state - both)
    return np.bitwise_count(~state).astype(np.int64)


def likeness(left: list[Signature], right: list[Signature]) -> np.ndarray:
    """0 to 1 for each pair: one less the edit distance over the lengths, at a common block size."""
    best = np.zeros(len(left))
    for i in (1, 2):
        for j in (1, 2):
            rows = [r for r, (x, y) in enumerate(zip(left, right)) if x[0] + i == y[0] + j]
            for low in range(0, len(rows), 2048):
                part = rows[low : low + 2048]
                a, b = [left[r][i] for r in part], [right[r][j] for r in part]
                sizes = np.array([len(x) + len(y) for x, y in zip(a, b)])
                same = np.where(sizes == 0, 1.0, 2 * _common(a, b) / np.maximum(sizes, 1))
                best[part] = np.maximum(best[part], same)
    return best


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` ids that cut the table into parts of like size."""
    if parts < 2:
        return []
    found = docs.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in found})


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    Edited: the last half of the code points replaced by the beginning of the next document, in
    order of doc_id (then text; no id comes first); the last is followed by the first.

    Texts are shuffled once: by stretches of ids, of which each also gets the first document of
    the next one. The ids that cut the stretches and those first ids are as many as there are
    shuffle partitions.
    """
    spark = docs.sparkSession
    texts = ids_and_texts(docs).withColumn("own", F.coalesce("doc_id", F.lit(NO_ID)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(texts.select(F.col("own").alias("doc_id")), parts)

    @F.pandas_udf("int")
    def stretch_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(), side="right").astype(np.int32))

    placed = texts.withColumn("stretch", stretch_of("own"))
    leading = sorted(tuple(r) for r in placed.select("own", "stretch").groupBy("stretch").agg(F.min("own")).collect())
    follows = [(first, leading[i - 1][0]) for i, (_, first) in enumerate(leading)]
    tails = spark.createDataFrame(follows, "own long, before int")
    also = placed.join(F.broadcast(tails), "own", "left").withColumn("to", F.explode(F.array(F.struct("stretch", F.lit(False).alias("tail")), F.struct(F.col("before").alias("stretch"), F.lit(True).alias("tail")))))
    dealt = also.select(F.col("to.stretch").alias("stretch"), F.col("to.tail").alias("tail"), "own", "doc_id", "text").filter("stretch is not null")
    ordered = dealt.repartitionById(parts, "stretch").sortWithinPartitions("stretch", "tail", "own", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row that still waits for its next one

        def out(pairs: list[tuple[tuple, str]]) -> pa.RecordBatch:
            half = [len(t) // 2 for (_, t, _), _ in pairs]
            edited = [(t[: len(t) - h] + following[:h]).encode() for ((_, t, _), following), h in zip(pairs, half)]
            after = signatures(edited)
            own = [row[2] for row, _ in pairs]
            nexts = own[1:] + signatures([pairs[-1][1].encode()])
            # A row's next one is the following row but where a stretch ends.
            for i in range(len(pairs) - 1):
                if pairs[i][1] is not pairs[i + 1][0][1]:
                    nexts[i] = signatures([pairs[i][1].encode()])[0]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row, _ in pairs], pa.int64()),
                    pa.array([len(row[1]) for row, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                    pa.array([written(s) for s in own]),
                    pa.array([written(s) for s in after]),
                    pa.array(likeness(own, after)),
                    pa.array(likeness(own, nexts)),
                ],
                [f.split()[0] for f in _OUT.split(", ")],
            )

        stretch = None
        for batch in slices(batches):
            pairs: list[tuple[tuple, str]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("stretch", "tail", "doc_id", "text")))
            marks = signatures([t.encode() for t in batch.column("text").to_pylist()])
            for (at, tail, doc, text), mark in zip(rows, marks):
                if at != stretch:
                    held, stretch = [], at
                if held:
                    pairs.append((held.pop(), text))
                if not tail:
                    held.append((doc, text, mark))
            if pairs:
                yield out(pairs)

    return ordered.mapInArrow(run, _OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [written(s) for s in signatures([t.encode() for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, fingerprint string")
