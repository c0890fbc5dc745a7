"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often.

Tokenizer A is byte-level, B has pieces with byte fallback. Both encode a space and the text; the
byte offsets where tokens of both end cut a document into groups, and the two tokens that end at
such an offset are a link. A link's count is how often its two ids are linked in the whole corpus.

Counting is external. Tasks collect pair-document records (ids of B and A, document, links) of a
stretch of documents, a chunk, and write them radix-partitioned by the id of B, sorted, as zstd
runs: heads (pairs and their number of links) and posts (the documents of each pair). A k-way heap
merge of heads counts each pair, at most about ``FAN`` runs of one radix in one task; its results
are runs again, merged until each radix has one, so a pair that every document has is never
gathered. The last merge comes in order of B's ids, so when an id ends its highest count is known.
Then each run's posts stream what their pairs contribute (count, and whether it is the highest of
its id of B) back to the documents; a chunk's runs lie together, so a document gets one row or few.

Links end together, so one token's bytes end with the other's: there are at most as many different
pairs as all tokens of both vocabularies have bytes. That bounds what the driver sends to all tasks.

Texts that are null or empty, or whose tokens of A or B do not have the bytes of the space and the
text (a U+2581 reads as a space), have no tokens: zeros, and '' for the hash. Special tokens'
strings are ordinary text. Repeated rows count as often as they occur, each has a row. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import pieces
from driftloom.llm.common import ids_and_texts, slices
from driftloom.llm.tokens import ByteLevel
from driftloom.storage import settle

BYTE_VOCABULARY = "byte_bpe_50k.json"
RADIXES = 32
#: Links of a chunk, about: 8 bytes each while they are collected.
CHUNK = 2 << 20
#: Bits for a document's place in its chunk.
PLACE_BITS = 22
#: Runs that one task merges, about.
FAN = 64
BLOCK = 1 << 15
#: Remembered words of A per worker.
MEMORY = 400_000

Side = tuple[int, np.ndarray, np.ndarray]

_STORED = (
    "chunk long, radix int, heads array<binary>, posts binary, place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
)


def pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns of one length, as byte planes under zstd."""
    planes = [np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T for c in columns]
    return bytes([len(columns)]) + zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(blob: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], 8, -1)
    return [np.ascontiguousarray(c.T).reshape(-1).view("<i8") for c in data]


class Tokens:
    """A vocabulary's token bytes, and its ids as text."""

    def __init__(self, by_id: dict[int, bytes]):
        self.n = max(by_id) + 1
        every = [by_id.get(i, b"") for i in range(self.n)]
        self.sizes = np.array([len(x) for x in every], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(every), np.uint8)
        names = [str(i) for i in range(self.n)]
        self.named = {mark: np.array([x + mark for x in names], object) for mark in ",|;"}

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def _byte_letters() -> dict[str, int]:
    """The letter of every byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Spaced(ByteLevel):
    """Ids of texts with a space in front: their first word is one like those after spaces."""

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        if len(self.heads) + len(self.tails) > MEMORY:
            self.heads.clear()
            self.tails.clear()
        rows = [[line.split(" ") for line in text.split("\n")] for text in texts]
        heads, tails = set(), set()
        for first, *others in rows:
            tails.update(first)
            for words in others:
                heads.add(words[0])
                tails.update(words[1:])
        self._learn(heads, self.heads, True)
        self._learn(tails, self.tails, False)
        head, tail = self.heads, self.tails.__getitem__
        out = []
        for text, (first, *others) in zip(texts, rows):
            try:
                out.append(self.newline.join([b"".join(map(tail, first)), *(head[w[0]] + b"".join(map(tail, w[1:])) for w in others)]))
            except KeyError:  # white space that is not one space or newline between words
                out.append(self.plain(f" {text}") if text else b"")
        return out


class Aligner:
    """Both encoders and their tokens' bytes."""

    def __init__(self, a: str, b: str):
        self.a = Spaced(a if "/" in a else public_tokenizers.path(a))
        self.a.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        self.a_tokens = Tokens({i: bytes(letters[c] for c in t) for t, i in self.a.tokenizer.get_vocab(with_added_tokens=False).items()})
        self.b = pieces.encoder(b)
        fallback = {i: bytes([x]) for x, i in enumerate(self.b.bytes or ())}
        self.b_tokens = Tokens({i: p.replace(pieces.SPACE, " ").encode() for p, i in self.b.ids.items()} | fallback)
        if self.a_tokens.n * self.b_tokens.n >> (63 - PLACE_BITS):
            raise ValueError("vocabularies too large for one word per record")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their number per row, ids of B and theirs; rows whose bytes differ have none."""
        data = [f" {t}".encode() if t else b"" for t in texts]
        sizes = np.array([len(x) for x in data], np.int64)
        own = [self.a.encode_spaced(texts), [self.b.encode(t) for t in texts]]
        good = np.ones(len(texts), bool)
        for ids, tokens in zip(own, (self.a_tokens, self.b_tokens)):
            flat, row = _flat(ids)
            good &= np.bincount(row, tokens.sizes[flat], len(texts)).astype(np.int64) == sizes
        for ids, tokens in zip(own, (self.a_tokens, self.b_tokens)):
            flat, _ = _flat([x if g else b"" for x, g in zip(ids, good)])
            want = np.frombuffer(b"".join(x for x, g in zip(data, good) if g), np.uint8)
            wrong = np.flatnonzero(tokens.bytes_of(flat) != want)
            good[np.repeat(np.arange(len(texts)), sizes * good)[wrong]] = False
        out = []
        for ids in own:
            kept = [x if g else b"" for x, g in zip(ids, good)]
            out += [_flat(kept)[0], np.array([len(x) // 4 for x in kept], np.int64)]
        return tuple(out)

    def align(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Per row n_a, n_b, n_links and the hash of its groups; per link row, id of A and id of B."""
        a, n_a, b, n_b = self.encode(texts)
        ends_a, ends_b = np.cumsum(self.a_tokens.sizes[a]), np.cumsum(self.b_tokens.sizes[b])
        both = np.zeros((2, int(ends_a[-1]) + 1 if len(a) else 1), bool)
        both[0, ends_a] = both[1, ends_b] = True
        last_a, last_b = both[1][ends_a], both[0][ends_b]
        link_a, link_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        row_a = np.repeat(np.arange(len(texts)), n_a)
        n_links = np.bincount(row_a[link_a], minlength=len(texts))
        # Each group's tokens of A stand before those of B.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before = np.concatenate([[0], link_b + 1])
        named = np.empty(len(a) + len(b), object)
        at = np.arange(len(a)) + before[group_a]
        named[at] = self.a_tokens.named[","][a]
        named[at[link_a]] = self.a_tokens.named["|"][a[link_a]]
        at = np.arange(len(b)) + link_a[group_b] + 1
        named[at] = self.b_tokens.named[","][b]
        named[at[link_b]] = self.b_tokens.named[";"][b[link_b]]
        words, bounds = named.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        hashes = [sha256("".join(words[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:])]
        return n_a, n_b, n_links, hashes, row_a[link_a], a[link_a].astype(np.int64), b[link_b].astype(np.int64)


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) // 4 for x in ids]
    return np.frombuffer(b"".join(ids), np.uint32), np.repeat(np.arange(len(ids)), sizes)


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def runs_of(codes: np.ndarray, n_a: int, n_b: int) -> Iterator[tuple[int, list[bytes], bytes]]:
    """radix, heads and posts of records; a record is (side, id of A, place) in one word.

    A side is an id of B in order of its radix, the remainder by ``RADIXES``, then of its quotient.
    """
    records, links = np.unique(codes, return_counts=True)
    pairs, place = records >> PLACE_BITS, records & ((1 << PLACE_BITS) - 1)
    heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    side, a = np.divmod(pairs[heads], n_a)
    radix, high = np.divmod(side, -(-n_b // RADIXES))
    b, n = high * RADIXES + radix, np.add.reduceat(links, heads)
    posts = np.append(heads, len(records))
    bounds = np.searchsorted(radix, np.arange(RADIXES + 1))
    for r, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if y > x:
            blocks = [pack(b[i : min(i + BLOCK, y)], a[i : min(i + BLOCK, y)], n[i : min(i + BLOCK, y)]) for i in range(x, y, BLOCK)]
            low, high_ = posts[x], posts[y]
            sizes = pack(np.diff(posts[x : y + 1]))
            yield r, blocks, len(sizes).to_bytes(4, "little") + sizes + pack(place[low:high_], links[low:high_])


def posts_in(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents per pair; their places and links."""
    n = int.from_bytes(blob[:4], "little")
    (sizes,) = unpack(blob[4 : 4 + n])
    place, links = unpack(blob[4 + n :])
    return sizes, place, links


def sides(blocks: Iterable[bytes]) -> Iterator[Side]:
    """Each id of B of a run, in order, with its ids of A and their links; one block is open at a time."""
    held: list[np.ndarray] = []
    for block in blocks:
        b, a, n, *_ = unpack(block)
        cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(b)]
        for x, y in zip(bounds, bounds[1:]):
            if held and held[0] != b[x]:
                yield held[0], np.concatenate(held[1]), np.concatenate(held[2])
                held = []
            if not held:
                held = [int(b[x]), [], []]
            held[1].append(a[x:y])
            held[2].append(n[x:y])
    if held:
        yield held[0], np.concatenate(held[1]), np.concatenate(held[2])


def merged(runs: list[Iterable[bytes]]) -> Iterator[Side]:
    """The k-way heap merge: each id of B once, its ids of A in order, and all their links."""
    every = heapq.merge(*map(sides, runs), key=itemgetter(0))
    for b, same in groupby(every, key=itemgetter(0)):
        own = list(same)
        if len(own) == 1:
            yield own[0]
            continue
        a, n = (np.concatenate([x[i] for x in own]) for i in (1, 2))
        order = np.argsort(a, kind="stable")
        a, n = a[order], n[order]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        yield b, a[heads], np.add.reduceat(n, heads)


def written(found: Iterable[Side]) -> Iterator[bytes]:
    """Blocks of a run, with a column that marks each id's highest count."""
    held: list[list[np.ndarray]] = [[], [], [], []]
    size = 0
    for b, a, n in found:
        for column, values in zip(held, (np.full(len(a), b), a, n, n == n.max())):
            column.append(values)
        size += len(a)
        if size >= BLOCK:
            yield pack(*map(np.concatenate, held))
            held, size = [[], [], [], []], 0
    if size:
        yield pack(*map(np.concatenate, held))


def records(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = pieces.VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """One row per document (radix -1) and the runs of their chunks; stored."""
    names = [x.split()[0] for x in _STORED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), *[pa.int64()] * 6, pa.string()]

    def batch_of(n: int, **columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a, b)
        n_a, n_b = known.a_tokens.n, known.b_tokens.n
        width = -(-n_b // RADIXES)
        number, place, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            for radix, heads, posts in runs_of(np.concatenate(held), n_a, n_b):
                yield batch_of(1, chunk=[number], radix=[radix], heads=[heads], posts=[posts])

        for batch in slices(batches):
            rows = batch.num_rows
            own_a, own_b, links, hashes, row, ids_a, ids_b = known.align(batch.column("text").to_pylist())
            yield batch_of(
                rows, chunk=np.full(rows, number), radix=np.full(rows, -1, np.int32), place=np.arange(place, place + rows), doc_id=batch.column("doc_id"),
                n_a=own_a, n_b=own_b, n_groups=links, n_links=links, groups_sha256=hashes,
            )
            side = ids_b % RADIXES * width + ids_b // RADIXES
            held.append((side * n_a + ids_a << PLACE_BITS) | (row + place))
            place, size = place + rows, size + len(row)
            # A slice has fewer rows than bytes, so places fit their bits.
            if size >= chunk or place >= 1 << (PLACE_BITS - 1):
                if size:
                    yield from close()
                number, place, size, held = number + 1, 0, 0, []
        if size:
            yield from close()

    return settle(ids_and_texts(docs).mapInArrow(run, _STORED))


def totals(stored: DataFrame, fan: int = FAN) -> DataFrame:
    """radix, blocks (id of B, id of A, links of the corpus, whether no other id of A has more)."""
    runs = stored.filter("radix >= 0")
    groups = -(-runs.select("chunk").distinct().count() // fan)
    left = runs.select("radix", F.pmod(F.xxhash64("chunk"), F.lit(max(groups, 1))).alias("salt"), F.col("heads").alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, s, x) for b in batches for r, s, x in zip(b.column("radix").to_pylist(), b.column("salt").to_pylist(), b.column("blocks")))
        for (radix, salt), same in groupby(rows, key=itemgetter(0, 1)):
            blocks = list(written(merged([(y.as_py() for y in x.values) for _, _, x in same])))
            yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([salt], pa.int64()), pa.array([blocks], pa.list_(pa.binary()))], ["radix", "salt", "blocks"])

    while True:
        left = left.repartition("radix", "salt").sortWithinPartitions("radix", "salt").mapInArrow(run, "radix int, salt long, blocks array<binary>")
        if groups <= 1:
            return left.select("radix", "blocks")
        groups = -(-groups // fan)
        left = left.withColumn("salt", F.pmod("salt", F.lit(groups)))


def contributions(stored: DataFrame, counted: DataFrame) -> DataFrame:
    """chunk, place, n_best, count_sum of the documents with links."""
    # At most one entry per byte of all tokens of both vocabularies.
    blocks = [x for row in counted.toArrow().column("blocks").to_pylist() for x in row]
    sent = stored.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*(unpack(x) for x in sent.value))] or [np.zeros(0, np.int64)] * 4
        keys = columns[0] << 32 | columns[1]
        order = np.argsort(keys)
        keys, count, best = keys[order], columns[2][order], columns[3][order]

        def rows() -> Iterator[tuple[int, list[bytes], bytes]]:
            for batch in batches:
                for chunk, heads, posts in zip(batch.column("chunk").to_pylist(), batch.column("heads"), batch.column("posts")):
                    yield chunk, heads.values.to_pylist(), posts.as_py()

        for chunk, same in groupby(rows(), key=itemgetter(0)):
            sums = np.zeros((2, 0), np.int64)
            for _, heads, posts in same:
                b, a, _ = (np.concatenate(c) for c in zip(*(unpack(x) for x in heads)))
                at = np.searchsorted(keys, b << 32 | a)
                sizes, place, links = posts_in(posts)
                if place.max() >= sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, int(place.max()) + 1 - sums.shape[1])))
                for out, own in zip(sums, (best, count)):
                    np.add.at(out, place, np.repeat(own[at], sizes) * links)
            found = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), chunk)), pa.array(found), pa.array(sums[0][found]), pa.array(sums[1][found])], ["chunk", "place", "n_best", "count_sum"]
            )

    own = stored.filter("radix >= 0").select("chunk", "heads", "posts")
    return own.mapInArrow(run, "chunk long, place long, n_best long, count_sum long")


def align(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = pieces.VOCABULARY, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    stored = records(docs, a, b, chunk)
    summed = contributions(stored, totals(stored, fan)).groupBy("chunk", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = stored.filter("radix < 0").select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    whole = own.join(summed, ["chunk", "place"], "left").na.fill(0, ["n_best", "count_sum"])
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_counts(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = pieces.VOCABULARY) -> DataFrame:
    """id_b, id_a, links, best of every linked pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("blocks"):
                for block in row.values:
                    id_b, id_a, links, best = unpack(block.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(id_b), pa.array(id_a), pa.array(links), pa.array(best > 0)], ["id_b", "id_a", "links", "best"])

    return totals(records(docs, a, b)).mapInArrow(run, "id_b long, id_a long, links long, best boolean")
