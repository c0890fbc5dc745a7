"""Packing: concatenate all documents and cut the stream into windows of fixed length.

First pass: tokenize every document once and store its ids with its offset in its partition.
Partition totals (one row each) give every partition its place in the whole stream. Second
pass: cut at multiples of the window, without moving any ids. A window that begins in one
partition and ends in the next is described by piece records of both: they share its
``sequence_id`` and their offsets join without a gap.

Nulls and empty texts are one token, the end id. Repeated rows are packed once for each row. An
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import ids_and_texts, slices
from driftloom.llm.tokens import encoder
from driftloom.storage import settle

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048

_CODED = "doc_id long, ids binary, n long, part long, local long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, unsigned 32 bits, end id last), n, part and local offset; stored."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(vocabulary), np.array([end_id], np.uint32).tobytes()
        part, local = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [x + end for x in known.encode(batch.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = local + np.cumsum(n) - n
            local += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_narrow(ids), pa.binary()), pa.array(n), pa.array(np.full(len(n), part)), pa.array(starts)],
                ["doc_id", "ids", "n", "part", "local"],
            )

    return settle(ids_and_texts(docs).mapInArrow(code, _CODED))


def _narrow(ids: list[bytes]) -> list[bytes]:
    """Two bytes an id where all of a document's fit; a leading byte tells the width."""
    out = []
    for raw in ids:
        values = np.frombuffer(raw, "<u4")
        out.append(b"\x02" + values.astype("<u2").tobytes() if values.max() < 1 << 16 else b"\x04" + raw)
    return out


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")


def placed(coded: DataFrame) -> DataFrame:
    """``coded`` with the offset of every document in the whole stream.

    The totals have one row per partition, so the side that is broadcast is bounded by their number.
    """
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    bases = totals.select("part", before.alias("base"))
    return coded.join(F.broadcast(bases), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("local")).alias("at"))


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and their ids.

    Every id lies in exactly one piece and every sequence but the last is full, so padding is
    less than one window in all.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            rows: list[tuple] = []
            for doc, raw, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "at"))):
                ids = _wide(raw)
                edge = 0
                while edge < len(ids):
                    sequence, offset = divmod(at + edge, window)
                    length = min(len(ids) - edge, window - offset)
                    piece = ids[edge : edge + length].tobytes()
                    rows.append((doc, edge, length, zlib.crc32(piece), len(ids), sequence, offset, piece if with_ids else None))
                    edge += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.binary()) for i, c in enumerate(zip(*rows))], [f.split()[0] for f in _PIECES.split(", ")])

    return placed(tokenized(docs, vocabulary, end_id)).mapInArrow(cut, _PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids, padded to the window unless n_tokens is a power of two.

    A group holds at most ``window`` pieces.
    """

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4").astype(np.int32)
        n = len(ids)
        if n & (n - 1):
            ids = np.concatenate([ids, np.full(window - n, pad_id, np.int32)])
        return pa.table({"sequence_id": [key[0].as_py()], "n_tokens": [n], "ids": [ids.tolist()]}, pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return pieces.groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens long, ids array<int>")
