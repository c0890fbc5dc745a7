"""What the operators share: Arrow slices of bounded size, vectorised words and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.shipping import ship_package

SLICE_BYTES = 2 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ids_and_texts(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """doc_id, the whole text (null counts as empty) and ``more``; other columns are not read.

    Python workers can import the package afterwards.
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


#: What lets go of things that operators remember in a worker from task to task.
MEMORIES: list[Callable[[], None]] = []


def release() -> None:
    """Let go of what operators remembered: a worker that goes on to another one needs the room."""
    for forget in MEMORIES:
        forget()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = offsets_of(batch.column(column))
        marks = (sizes - sizes[0])[1:] // limit
        cuts = np.flatnonzero(np.diff(marks)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Start of each value in the data buffer, and the end of the last, as int64."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each row starts (ends with the total)."""
    at = offsets_of(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int, seed: int = 1):
        self.base = np.uint64(base | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)
        self.letters = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def upto(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up))
            up, down = np.full(size, self.base), np.full(size, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of value times power; the difference of two identifies what lies between."""
        self.upto(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of values[low:high], the same wherever those values stand."""
        return mixed((prefix[high] - prefix[low]) * self.down[low] + (high - low).astype(np.uint64) * ODD)


WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, rows: np.ndarray, space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and at which word each row starts.

    A word ends at white space or at the end of its row.
    """
    inside = ~space[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[rows[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[rows[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, rows)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def toxic_split(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo four; two of them marks a held-out row."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
