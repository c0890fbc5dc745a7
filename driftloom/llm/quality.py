"""Quality rules: fixed base rules, then hashed n-gram logistic regression.

Features are word and two-word hashes and three- and four-byte hashes of the whole text, as
square roots of their shares. The regression is trained on at most ``SAMPLE`` labelled rows
(copies of a text teach once), a fifth of which sets the scale that turns margins into
probabilities (Platt). A row is kept if it passes the base rules and its probability of being
good reaches ``THRESHOLD``.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f, \\r. Nulls are empty texts; those fail
the base rules. Null labels are ignored; of contradicting ones the worse holds. Without labels of
both kinds the base rules decide alone. Rows that share a doc_id are judged each on its own text.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import ODD, WORD_SPACE, Powers, bytes_of, ids_and_texts, mixed, slices, word_bounds

WORD_DIMS, CHAR_DIMS = 2048, 2048
SAMPLE = 4000
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
_ROWS = 256
_LETTERS, _WORDS = Powers(0xB5297A4D3F84D5B5, 31), Powers(0x68E31DA4C5B1A2ED, 32)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (features @ self.weights + self.bias) + self.shift, -50, 50)))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, _ROWS):
        yield batch.slice(low, _ROWS)


def features(column: pa.Array) -> np.ndarray:
    """One row per text: square roots of the shares of its word and byte n-grams."""
    data, rows = bytes_of(column)
    n = len(rows) - 1
    out = np.zeros((n, WORD_DIMS + CHAR_DIMS), np.float32)
    starts, ends, firsts = word_bounds(data, rows)
    words = _LETTERS.between(_LETTERS.prefix(_LETTERS.letters[data]), starts, ends)
    row = np.repeat(np.arange(n), np.diff(firsts))
    pair = np.flatnonzero(row[1:] == row[:-1])
    grams = np.concatenate([words, mixed(words[pair] * ODD + words[pair + 1])])
    owner = np.concatenate([row, row[pair]])
    _share(out, 0, WORD_DIMS, owner, (grams >> np.uint64(32)).astype(np.int64) % WORD_DIMS)
    letter = data.astype(np.uint32)
    where = np.repeat(np.arange(n), np.diff(rows))
    buckets, owners = [], []
    for size in (3, 4):
        if len(data) >= size:
            gram = letter[: len(data) - size + 1].copy()
            for step in range(1, size):
                gram = (gram << np.uint32(8)) | letter[step : len(data) - size + 1 + step]
            inner = where[: len(gram)] == where[size - 1 :]
            gram = (gram[inner] + np.uint32(size)) * np.uint32(0x9E3779B1)
            buckets.append((gram >> np.uint32(16)).astype(np.int64) % CHAR_DIMS)
            owners.append(where[: len(inner)][inner])
    if buckets:
        _share(out, WORD_DIMS, CHAR_DIMS, np.concatenate(owners), np.concatenate(buckets))
    return out


def _share(out: np.ndarray, offset: int, dims: int, owner: np.ndarray, bucket: np.ndarray) -> None:
    counts = np.bincount(owner * dims + bucket, minlength=len(out) * dims).reshape(len(out), dims)
    out[:, offset : offset + dims] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def base(column: pa.Array) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    data, rows = bytes_of(column)
    starts, ends, firsts = word_bounds(data, rows)
    n_words = np.diff(firsts)

    def per_row(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return np.diff(sums[rows])

    word_chars = per_row(~WORD_SPACE[data] & ((data & 0xC0) != 0x80))
    n_symbols = per_row(_SYMBOL[data])
    words = _LETTERS.between(_LETTERS.prefix(_LETTERS.letters[data]), starts, ends)
    row = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    keys = _WORDS.between(_WORDS.prefix(words), at, at + 3) + ODD * row[at].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = at[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    marked = np.zeros(len(words), bool)
    for step in range(3):
        marked[twice + step] = True
    sums = np.zeros(len(words) + 1, np.int64)
    np.cumsum(marked, out=sums[1:])
    dup_lines = []
    for text in column.to_pylist():
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        dup_lines.append(len(lines) - len(set(lines)))
    return n_words, word_chars, n_symbols, np.array(dup_lines, np.int64), np.diff(sums[firsts])


def failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = ids_and_texts(docs).select("doc_id", F.xxhash64("text").alias("mark"))
    own = own.join(marks, "doc_id").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.min("quality").alias("quality"))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = own.count()
    number = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    own = own.filter(number < (1 << 20) * 0.95 * sample / max(n, 1)).limit(sample)
    return ids_and_texts(docs).join(F.broadcast(own), "doc_id").select("doc_id", "text", "quality")


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, weak: float = 3e-5) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    rate = 4 * len(x) / float((x1.astype(np.float64) ** 2).sum())  # the trace bounds the largest eigenvalue
    now = ahead = np.zeros(x1.shape[1], np.float32)
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        gradient = x1.T @ (p - y).astype(np.float32) / len(y) + weak * ahead
        new = ahead - rate * gradient
        ahead = new + step / (step + 3) * (new - now)
        now = new
    return now[:-1].astype(np.float64), float(now[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the labelled sample; None if it lacks one of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for piece in _pieces(batch):
                x = features(piece.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary()), piece.column("quality")], ["doc_id", "x", "quality"])

    rows = _training(docs, labels, sample).mapInArrow(run, "doc_id long, x binary, quality int").toArrow().sort_by("doc_id")
    y = (np.asarray(rows.column("quality")) > 0).astype(np.float32)
    apart = np.arange(len(y)) % 5 == 0
    if min(y.sum(), len(y) - y.sum()) < 10 or len(set(y[apart])) < 2:
        return None
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(len(y), -1).astype(np.float32)
    weights, bias = fit(x[~apart], y[~apart])
    margin = (x[apart] @ weights + bias).astype(np.float32)
    scale = float(np.abs(margin).mean()) or 1.0
    slope, shift = fit(margin[:, None] / np.float32(scale), y[apart], weak=1e-3)
    return Model(weights, bias, float(slope[0]) / scale, shift)


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """The base figures, both verdicts and the probability of every row; nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in slices(batches):
            for piece in _pieces(batch):
                column = piece.column("text")
                figures = base(column)
                bad = failed(figures[0], figures[4])
                good = own.probability(features(column)) if own else np.ones(len(bad))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *map(pa.array, figures), pa.array(bad), pa.array(~bad & (good >= THRESHOLD)), pa.array(good)],
                    [f.split()[0] for f in _OUT.split(", ")],
                )

    return ids_and_texts(docs).mapInArrow(run, _OUT)
