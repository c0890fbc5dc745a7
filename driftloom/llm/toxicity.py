"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme values.

Learning: for each of 2**18 token hashes, how many toxic and clean labelled documents hold it.
The log-odds come from these counts with a Dirichlet prior in the classes' own proportion, less a
drift, so that a step through clean text loses on average. Scoring: one linear scan finds all
maximal segments (each as good as can be; none overlap). The best segment of a clean text of n
tokens exceeds s with a chance of about K n exp(-lambda s), where lambda solves
E exp(lambda step) = 1 over clean tokens; a segment is significant if its logarithm
lambda s - ln(K n) is positive. A document's evidence is the sum over its significant segments, or
that of its best segment if there is none. Evidence becomes a probability by isotonic regression,
fitted on labelled rows that are scored by a model without their own third.

Labelled rows whose crc32(doc_id) leaves remainder 2 by 4 are never learned from; of the others at
most ``SAMPLE`` are. Counts that reach the driver: one row per token hash and third at most.

Nulls and texts without tokens have the evidence of no token at all. Labels that are null are
ignored, of contradicting ones the toxic one holds. Without labels of both kinds every score is
the share of toxic labels (zero if there are none). Rows that share a doc_id are scored each on
its own text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Powers, bytes_of, ids_and_texts, release, slices, toxic_split, word_bounds
from driftloom.shipping import ship_package

BITS = 18
SAMPLE = 200_000
THIRDS = 3
PRIOR = 10.0
DRIFT = 0.6
REACH = 256
THRESHOLD = 0.3
HELD_OUT = 2
_BINS, _LOW, _HIGH = 4000, -40.0, 160.0

_LETTERS = Powers(0xD1342543DE82EF95, 21)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_GAP = np.ones(256, bool)
_GAP[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every token (a run of letters, A-Z folded) and where each row starts."""
    data, rows = bytes_of(column)
    data = _FOLD[data]
    starts, ends, firsts = word_bounds(data, rows, _GAP)
    hashes = _LETTERS.between(_LETTERS.prefix(_LETTERS.letters[data]), starts, ends)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), firsts


@dataclass(frozen=True)
class Model:
    """Step of each token bucket, the decay and scale of clean maxima, evidence edges and their scores."""

    steps: np.ndarray
    decay: float
    scale: float
    edges: np.ndarray
    scores: np.ndarray


def segments(steps: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass.

    Runs of steps with one sign act as one step, so the pass is over changes of sign.
    """
    if not len(steps):
        return []
    sign = steps > 0
    cut = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
    sums = np.add.reduceat(steps, cut).tolist()
    bounds = np.append(cut, len(steps)).tolist()
    total, found = 0.0, []  # (start, end, sum before, sum after)
    for i, value in enumerate(sums):
        before, total = total, total + value
        if value <= 0:
            continue
        start, low = bounds[i], before
        # Join to the left while an earlier segment starts lower and ends lower.
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append((start, bounds[i + 1], low, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _steps(buckets: np.ndarray, firsts: np.ndarray, model: Model) -> np.ndarray:
    """Steps of all tokens; a token that its row has had within ``REACH`` tokens adds nothing but the drift.

    So one word said over and over is no passage, and a passage that comes again later is one.
    """
    steps = model.steps[buckets]
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    own = (row << BITS) | buckets
    order = np.argsort(own, kind="stable")
    near = (own[order[1:]] == own[order[:-1]]) & (order[1:] - order[:-1] <= REACH)
    again = order[1:][near]
    steps[again] = np.minimum(steps[again], -DRIFT)
    return steps


def evidence(buckets: np.ndarray, firsts: np.ndarray, model: Model) -> np.ndarray:
    """Logarithm-scale evidence of every row."""
    out = np.full(len(firsts) - 1, _LOW)
    steps = _steps(buckets, firsts, model)
    sums = np.zeros(len(steps) + 1)
    np.cumsum(steps, out=sums[1:])
    for row, (a, b) in enumerate(zip(firsts.tolist(), firsts[1:].tolist())):
        if a == b:
            continue
        limit = np.log(model.scale * (b - a))
        best = float((sums[a + 1 : b + 1] - np.minimum.accumulate(sums[a:b])).max())
        if model.decay * best <= limit:
            out[row] = model.decay * max(best, 0.0) - limit
        else:
            out[row] = sum(e for _, _, s in segments(steps[a:b]) if (e := model.decay * s - limit) > 0)
    return np.clip(out, _LOW, _HIGH)


def log_odds(toxic: np.ndarray, clean: np.ndarray, documents: tuple[int, int], prior: float = PRIOR) -> np.ndarray:
    """Per bucket: how much likelier in toxic documents than in clean ones, under the prior."""
    share = documents[0] / sum(documents)
    return np.log((toxic + prior * share) / share) - np.log((clean + prior * (1 - share)) / (1 - share))


def decay_of(steps: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(x step) = 1 over clean tokens; its mean step must be negative."""
    weights = weights / weights.sum()
    low, high = 0.0, 1.0
    while (weights * np.exp(high * steps)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (weights * np.exp(middle * steps)).sum() < 1 else (low, middle)
    return max(high, 1e-6)


def isotonic(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Non-decreasing shares by pooling adjacent violators."""
    pools: list[list[float]] = []
    for one, n in zip(ones.tolist(), all_.tolist()):
        pools.append([one, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            one_, n_, width = pools.pop()
            pools[-1] = [pools[-1][0] + one_, pools[-1][1] + n_, pools[-1][2] + width]
    return np.concatenate([np.full(w, one / max(n, 1e-9)) for one, n, w in pools])


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, third, toxic of at most ``sample`` labelled rows that may be learned from.

    Copies of a text teach once. The ids taken are all that is broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    own = own.filter(toxic_split(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = ids_and_texts(docs).select("doc_id", F.xxhash64("text").alias("mark"))
    own = own.join(marks, "doc_id").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    n = own.count()
    own = own.filter(number < (1 << 20) * 0.98 * sample / max(n, 1)).limit(sample)
    own = own.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("third")), F.lit(THIRDS)).cast("int").alias("third"))
    return ids_and_texts(docs).join(F.broadcast(own), "doc_id").select("text", "third", "toxic")


def _counts(training: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents per third, class and token bucket; documents per third and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((THIRDS, 2, 1 << BITS), np.int64)
        docs = np.zeros((THIRDS, 2), np.int64)
        for batch in slices(batches):
            buckets, firsts = tokens(batch.column("text"))
            for row, (third, toxic) in enumerate(zip(batch.column("third").to_pylist(), batch.column("toxic").to_pylist())):
                held[third, int(toxic > 0), np.unique(buckets[firsts[row] : firsts[row + 1]])] += 1
                docs[third, int(toxic > 0)] += 1
        where = np.flatnonzero(held)
        other = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([where, -1 - other])), pa.array(np.concatenate([held.reshape(-1)[where], docs.reshape(-1)[other]]))], ["place", "n"]
        )

    summed = training.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = np.asarray(summed.column("place")), np.asarray(summed.column("n"))
    held, docs = np.zeros(THIRDS * 2 << BITS, np.int64), np.zeros(THIRDS * 2, np.int64)
    held[place[place >= 0]], docs[-1 - place[place < 0]] = n[place >= 0], n[place < 0]
    return held.reshape(THIRDS, 2, -1), docs.reshape(THIRDS, 2)


def _scored(held: np.ndarray, docs: np.ndarray) -> Model:
    """Steps and clean maxima from documents per class and bucket; not calibrated yet."""
    steps = log_odds(held[1].astype(float), held[0].astype(float), (int(docs[1]), int(docs[0]))) - DRIFT
    clean = np.maximum(held[0], 0).astype(float) + 1e-9
    return Model(steps.astype(np.float64), decay_of(steps, clean), 0.1, np.zeros(0), np.zeros(1))


def _rows(found: DataFrame) -> tuple[np.ndarray, ...]:
    rows = found.toArrow()
    return tuple(np.asarray(rows.column(c)) for c in rows.column_names)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows that may be learned from."""
    spark = docs.sparkSession
    training = _training(docs, labels, sample)
    held, n = _counts(training)
    whole = n.sum(0)
    if not whole.all():
        return Model(np.zeros(1 << BITS), 1.0, 1.0, np.zeros(0), np.array([whole[1] / max(whole.sum(), 1)]))
    model = _scored(held.sum(0), whole)
    parts = [(h, d) for h, d in ((held.sum(0) - held[i], whole - n[i]) for i in range(THIRDS))]
    apart = spark.sparkContext.broadcast([_scored(h, d) if d.all() else model for h, d in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((_BINS, 2), np.int64)
        for batch in slices(batches):
            buckets, firsts = tokens(batch.column("text"))
            third, toxic = np.asarray(batch.column("third")), np.asarray(batch.column("toxic")) > 0
            for i, own in enumerate(apart.value):
                rows = np.flatnonzero(third == i)
                if len(rows):
                    picked = np.concatenate([buckets[firsts[r] : firsts[r + 1]] for r in rows])
                    at = np.concatenate([[0], np.cumsum(firsts[rows + 1] - firsts[rows])])
                    np.add.at(counts, (_bin(evidence(picked, at, own)), toxic[rows].astype(int)), 1)
        where = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(counts.reshape(-1)[where])], ["place", "n"])

    place, number = _rows(training.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")))
    counts = np.zeros(_BINS * 2)
    counts[place] = number
    counts = counts.reshape(_BINS, 2)
    # A little of the overall share keeps scores off zero and one, and ties in order.
    weak = 0.5 * whole[1] / whole.sum()
    scores = isotonic(counts[:, 1] + weak / _BINS, counts.sum(1) + 0.5 / _BINS)
    scores = 0.998 * scores + 0.002 * np.linspace(0, 1, _BINS)
    return Model(model.steps, model.decay, model.scale, np.linspace(_LOW, _HIGH, _BINS + 1)[1:-1], scores)


def _bin(found: np.ndarray) -> np.ndarray:
    return np.minimum(((found - _LOW) * (_BINS / (_HIGH - _LOW))).astype(np.int64), _BINS - 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in slices(batches):
            found = evidence(*tokens(batch.column("text")), own)
            scores = own.scores[_bin(found)] if len(own.scores) > 1 else np.full(batch.num_rows, own.scores[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = ids_and_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(toxic_split(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_token, last_token, evidence of every significant passage."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in slices(batches):
            buckets, firsts = tokens(batch.column("text"))
            steps, out = _steps(buckets, firsts, own), []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), firsts.tolist(), firsts[1:].tolist()):
                limit = np.log(own.scale * max(b - a, 1))
                out += [(doc, x, y - 1, e) for x, y, s in segments(steps[a:b]) if (e := own.decay * s - limit) > 0]
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int64()] * 3 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "first_token", "last_token", "evidence"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, first_token long, last_token long, evidence double")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; nothing is shuffled.

    Rows go through the task as Arrow slices and are cut there: no copy of a whole batch is made.
    """
    ship_package(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = known.value
        for batch in slices(batches):
            found = evidence(*tokens(pc.fill_null(batch.column("text"), "")), own)
            scores = own.scores[_bin(found)] if len(own.scores) > 1 else np.full(batch.num_rows, own.scores[0])
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
