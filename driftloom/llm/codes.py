"""Token files of directly addressable codes.

A file is a Parquet file of shards. A shard holds the ids of consecutive documents as levels of
eight-bit chunks: level 0 has the low byte of every id and a bitmap that says which ids go on;
level 1 has the next byte of those, and so on. A rank directory per bitmap (ones before every
512 bits) finds an id's place in the next level, so any id is read without decoding others.

Shards stand in ascending order of doc_id: files by partition, shards by number. Null texts are
empty ones; every document ends with the end id. Repeated doc_ids stand side by side, ordered by
text. An empty table gives files without shards. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.common import ids_and_texts, slices
from driftloom.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SHARD_TOKENS = 1 << 16
RANK_BITS = 512

_SHARDS = "part long, shard long, first long, n long, doc_ids binary, doc_tokens binary, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories, one of each per level."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        ones = _ONES[bits].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        bitmaps.append(bits.tobytes())
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        if not more.any():
            return chunks, bitmaps, ranks
        rest = rest[more] >> np.uint32(8)


def access(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place ``i`` of a shard: one step per level."""
    value = 0
    for level, chunk in enumerate(chunks):
        value |= chunk[i] << (8 * level)
        byte, bit = divmod(i, 8)
        if not bitmaps[level][byte] >> bit & 1:
            return value
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        ones = int(np.frombuffer(ranks[level], "<u4", 1, 4 * block)[0])
        ones += int(_ONES[np.frombuffer(bitmaps[level], np.uint8, byte - start, start)].sum())
        i = ones + (bitmaps[level][byte] & ((1 << bit) - 1)).bit_count()
    raise ValueError("a shard's last level goes on")


def decode(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a shard."""
    values = np.zeros(0, np.uint32)
    for level in range(len(chunks) - 1, -1, -1):
        own = np.frombuffer(chunks[level], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bitmaps[level], np.uint8), count=len(own), bitorder="little").astype(bool)
        own[more] |= values << np.uint32(8)
        values = own
    return values


def write_codes(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Tokenize ``docs`` and write their shards below ``path``, in ascending order of doc_id."""
    names = [x.split()[0] for x in _SHARDS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.binary())] * 3

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(vocabulary), np.array([end_id], np.uint32).tobytes()
        part, first, shard, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []
        docs: list[int] = []

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in held], "<i8")
            levels = encode(np.frombuffer(b"".join(held), "<u4"))
            row = (part, shard, first, int(sizes.sum()), np.array(docs, "<i8").tobytes(), sizes.tobytes(), *levels)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for batch in slices(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), known.encode(batch.column("text").to_pylist())):
                held.append(ids + end)
                docs.append(-(1 << 63) if doc is None else doc)
                size += len(held[-1]) // 4
                if size >= SHARD_TOKENS:
                    yield close()
                    first, shard, size = first + size, shard + 1, 0
                    held.clear()
                    docs.clear()
        if held:
            yield close()

    ordered = ids_and_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(code, _SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards below ``path`` with ``start``: the ids of all documents before them.

    Totals have one row per written partition, so their broadcast is bounded by that number.
    """
    shards = spark.read.schema(_SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    bases = totals.select("part", before.alias("base"))
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian, unsigned 32 bits) of every document."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["chunks"], row["bitmaps"]).astype("<u4")
                sizes = np.frombuffer(row["doc_tokens"], "<i8")
                starts = np.cumsum(sizes) - sizes
                docs = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, mask=docs == np.iinfo(np.int64).min),
                        pa.array(starts + row["start"]),
                        pa.array(sizes),
                        pa.array([ids[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return read_shards(spark, path).mapInArrow(open_, "doc_id long, start long, n_tokens long, ids binary")


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place, id for every ``place`` (a position in the whole stream); places beyond it are left out.

    Places find their shard by equal stretch numbers in narrow columns: a shard is listed under each
    stretch it reaches into. Then each shard that is asked for travels once, ahead of its places.
    """
    shards = read_shards(spark, path)
    low, high = F.floor(F.col("start") / SHARD_TOKENS), F.floor((F.col("start") + F.col("n") - 1) / SHARD_TOKENS)
    listed = shards.select("start", "n", F.explode(F.sequence(low, high)).alias("stretch"))
    wanted = places.select(F.col("place").cast("long").alias("place")).withColumn("stretch", F.floor(F.col("place") / SHARD_TOKENS))
    met = wanted.join(listed, "stretch").filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n")))
    met = met.select("start", "place")
    sent = shards.join(met.select("start").distinct(), "start", "left_semi").select("start", F.lit(None).cast("long").alias("place"), "chunks", "bitmaps", "ranks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple[list[bytes], ...] = ([], [], [])
        for batch in batches:
            asked, found = [], []
            for i, (start, place) in enumerate(zip(batch.column("start").to_pylist(), batch.column("place").to_pylist())):
                if place is None:
                    shard = tuple(batch.column(c)[i].as_py() for c in ("chunks", "bitmaps", "ranks"))
                else:
                    asked.append(place)
                    found.append(access(*shard, place - start))
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64())], ["place", "id"])

    rows = sent.unionByName(met, allowMissingColumns=True).repartition("start").sortWithinPartitions("start", F.col("place").asc_nulls_first())
    return rows.mapInArrow(look, "place long, id long")


def checksums(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read back."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
