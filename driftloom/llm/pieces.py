"""SentencePiece encoding and decoding, exact for BPE models, by a table over prefixes.

Byte-pair merging gives every prefix of a text one encoding, so one last token. An encoding is the
merged one exactly if each two neighbours are compatible, that is if merging their joined text
gives the two back. So the last token of the prefix that ends at place i is the only token that an
automaton finds ending there and that is compatible with the last token of the prefix before it.
The table keeps that token for every place; the ids are read from it backwards. Work is linear in
the text, and no priority queue of merges is kept.

Compatibility is tested on the two tokens' own merge trees: from the joined state backwards, the
later merge is undone, and the pair then facing each other at the border must not merge before it.
Tokens whose trees have equal or falling ranks are tested by merging their text instead.

Texts are cut where no merge can pass (before a run of spaces, between characters that are in no
piece together), and a part that comes again is looked up. A model whose pieces have spaces inside
is not cut.

Characters without a piece become byte ids, or the unknown id where the model has none. Null texts
are empty ones and have the end id only; ids that are null decode to the empty text. Rows are
independent of each other: repeated rows give a row each, an empty table none, other columns are
ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from driftloom.llm.common import ids_and_texts, slices
from driftloom.shipping import ship_package

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Remembered pieces of text per worker; beyond that the memory starts anew. Longer ones are not kept.
MEMORY = 400_000
LONGEST = 40


class Merges:
    """The order of merges: the rank of every joined text, lower first; of equal ranks the left one."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        #: The two texts that each reachable token of several characters is merged from.
        self.halves: dict[str, tuple[str, str]] = {}
        self.unreachable: set[str] = set()
        self.irregular: set[str] = set()
        for token in sorted(ranks, key=len):
            if len(token) > 1:
                self._learn(token)

    def merge(self, text: str) -> list[str]:
        """Plain merging, step by step: quadratic, for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 62))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            self.last = (parts[best], parts[best + 1])
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _learn(self, token: str) -> None:
        if len(self.merge(token)) > 1:
            self.unreachable.add(token)
            return
        left, right = self.halves[token] = self.last
        for half in (left, right):
            if len(half) > 1 and (half in self.irregular or half not in self.halves or self.ranks[half] >= self.ranks[token]):
                self.irregular.add(token)

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives these two tokens."""
        if left in self.irregular or right in self.irregular:
            return self.merge(left + right) == [left, right]
        ranks, halves = self.ranks, self.halves
        limit = 1 << 62
        while True:
            if ranks.get(left + right, 1 << 62) < limit:
                return False
            a = ranks[left] if left in halves else -1
            b = ranks[right] if right in halves else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                # The left token's merge goes first where the pair at the border ranks equal.
                left, limit = halves[left][1], a
            else:
                right, limit = halves[right][0], b + 1


@lru_cache(maxsize=2)
def library(name: str) -> SentencePieceProcessor:
    """The library's own processor of a public model file (a name in its folder, or a path)."""
    return SentencePieceProcessor(model_file=name if "/" in name else public_tokenizers.path(name))


class Encoder:
    def __init__(self, path: str):
        self.library = library(path)
        spec = model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        if spec.trainer_spec.model_type != model_pb2.TrainerSpec.BPE:
            raise ValueError("not a BPE model")
        kinds = model_pb2.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        n = spec.normalizer_spec
        #: Only spaces are changed, so the library need not be asked.
        self.plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        order = {s: i for i, s in enumerate(sorted({-p.score for p in spec.pieces if p.type == kinds.NORMAL}))}
        self.merges = Merges({p.piece: order[-p.score] for p in spec.pieces if p.type == kinds.NORMAL and len(p.piece) > 1})
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if piece not in self.merges.unreachable:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.cut = self._cutter()

    def _cutter(self) -> re.Pattern[str] | None:
        """Where texts may be cut: no piece goes from another character into a space, or over a cut.

        Characters that are neighbours in some piece stay together, with the spaces before them.
        """
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return None
        kinds: dict[str, set[str]] = {}
        for piece in longer:
            own = set(piece) - {SPACE}
            for other in {id(kinds[c]): kinds[c] for c in own if c in kinds}.values():
                own |= other
            kinds.update(dict.fromkeys(own, own))
        different = {id(k): "".join(sorted(k)) for k in kinds.values()}
        together = [f"[{re.escape(k)}]+" for k in sorted(different.values(), key=len, reverse=True)]
        alone = f"[^{SPACE}{re.escape(''.join(sorted(kinds)))}]"
        return re.compile("|".join([*([f"{SPACE}*(?:{'|'.join(together)})"] if together else []), f"{SPACE}+", alone]), re.S)

    def last_tokens(self, text: str) -> list[str | None]:
        """The last token of the encoding of every prefix, from that of one character on; none if no piece has it."""
        last: list[str | None] = [None] * len(text)
        pairs, done = self.pairs, -1
        for end, token in self.automaton.iter(text):
            if end == done:
                continue
            start = end - len(token)
            if start >= 0:
                pair = (last[start] or text[start], token)
                good = pairs.get(pair)
                if good is None:
                    good = pairs[pair] = self.merges.compatible(*pair)
                if not good:
                    continue
            last[end] = token
            done = end
        return last

    def encode_part(self, text: str) -> bytes:
        """Ids (unsigned 32 bits) of a text between two cuts."""
        last, ids = self.last_tokens(text), self.ids
        found, i = [], len(text)
        while i:
            token = last[i - 1]
            if token is not None:
                found.append(ids[token])
                i -= len(token)
            else:
                i -= 1
                found += [self.bytes[b] for b in reversed(text[i].encode())] if self.bytes else [self.unknown]
        found.reverse()
        return array("I", found).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids (unsigned 32 bits) of a text, without an end id."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE) if self.plain else self.library.normalize(text)
        if self.cut is None:
            return self.encode_part(text)
        if len(self.known) > MEMORY:
            self.known.clear()
        if len(self.pairs) > MEMORY:
            self.pairs.clear()
        parts, known = self.cut.findall(text), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            out = []
            for part in parts:
                ids = known.get(part)
                if ids is None:
                    ids = self.encode_part(part)
                    if len(part) <= LONGEST:
                        known[part] = ids
                out.append(ids)
            return b"".join(out)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The encoder of a public model file, once per worker."""
    return Encoder(name)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, end: bool = True) -> DataFrame:
    """doc_id, ids (array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        last = array("I", [known.end]).tobytes() if end else b""
        for batch in slices(batches):
            found = [known.encode(text) + last for text in batch.column("text").to_pylist()]
            values = pa.Array.from_buffers(pa.int32(), sum(map(len, found)) // 4, [None, pa.py_buffer(b"".join(found))])
            at = [0]
            for x in found:
                at.append(at[-1] + len(x) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], ["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, text: the library's text of the ids."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(vocabulary)
        for batch in batches:
            ids = batch.column("ids")
            texts = pa.array((known.decode(row.values.to_pylist() if row.is_valid else []) for row in ids), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``decode`` gave."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
