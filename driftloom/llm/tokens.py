"""Token ids by a public tokenizer file: a word's ids are looked up once and then remembered.

Both given vocabularies split a text at white space before anything else, so the ids of a text
are those of its pieces in order. Pieces that the argument does not cover (double spaces, other
white space at a piece's edge) send their whole text to the tokenizer as it is.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from driftloom.llm.common import MEMORIES

#: Remembered pieces per worker; beyond that the memory starts anew. About 200 bytes each.
MEMORY = 900_000
_PER_CALL = 400
_PLAIN = re.compile(r"[!-~¡-ÿ ]+")


def _as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=True)

    def plain(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _cut(self, text: str, lengths: np.ndarray) -> list[bytes] | None:
        """Ids of one text, cut where the given byte lengths end; None if no id ends there."""
        # The fast way keeps no offsets.
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(lengths)
        at = np.searchsorted(ends, wanted, side="left")
        if not len(ids) or at[-1] >= len(ids) or (ends[at] != wanted).any():
            return None
        data, cuts = ids.tobytes(), [0, *(4 * at + 4).tolist()]
        return [data[low:high] for low, high in zip(cuts, cuts[1:])]


class ByteLevel(_Encoder):
    """Byte-level pieces that carry the one space before them."""

    def __init__(self, path: str):
        super().__init__(path)
        self.sizes = np.zeros(max(self.vocab.values()) + 1, np.int64)
        for token, i in self.vocab.items():
            self.sizes[i] = len(token)
        self.newline = self.plain("\n")
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _learn(self, pieces: set[str], into: dict[str, bytes], head: bool) -> None:
        wanted = [p for p in pieces.difference(into) if p and not p[0].isspace() and not p[-1].isspace()]
        for low in range(0, len(wanted), _PER_CALL):
            part = wanted[low : low + _PER_CALL]
            sizes = np.array([len(p.encode()) for p in part])
            if head:
                both = np.ones(2 * len(part), np.int64)
                both[1::2] = sizes
                found = self._cut("".join("\n" + p for p in part), both)
                found = found and found[1::2]
            else:
                found = self._cut("".join(" " + p for p in part), sizes + 1)
            into.update(zip(part, found or [self.plain(p if head else " " + p) for p in part]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.heads) + len(self.tails) > MEMORY:
            self.heads.clear()
            self.tails.clear()
        rows, heads, tails = [], set(), set()
        for text in texts:
            lines = []
            for line in text.split("\n"):
                pieces = line.split(" ")
                first = pieces.pop(0)
                heads.add(first)
                tails.update(pieces)
                lines.append((first, pieces))
            rows.append(lines)
        self._learn(heads, self.heads, True)
        self._learn(tails, self.tails, False)
        head, tail = self.heads, self.tails.__getitem__
        out = []
        for text, lines in zip(texts, rows):
            try:
                out.append(self.newline.join([head[first] + b"".join(map(tail, pieces)) for first, pieces in lines]))
            except KeyError:
                out.append(self.plain(text))
        return out


class WordLevel(_Encoder):
    """Pieces whose white space is dropped and whose last token carries a word end."""

    def __init__(self, path: str):
        super().__init__(path)
        self.sizes = np.zeros(max(self.vocab.values()) + 1, np.int64)
        for token, i in self.vocab.items():
            self.sizes[i] = len(token.removesuffix("</w>")) or len(token)
        self.words: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > MEMORY:
            self.words = {"": b""}
        rows = [text.replace("\n", " ").split(" ") for text in texts]
        wanted = [w for w in set().union(*rows) if w not in self.words]
        for low in range(0, len(wanted), _PER_CALL):
            part = wanted[low : low + _PER_CALL]
            joined, found = " ".join(part), None
            if _PLAIN.fullmatch(joined) and "<|" not in joined:
                found = self._cut(joined, np.array([len(w.encode()) for w in part]))
            self.words.update(zip(part, found or [self.plain(w) for w in part]))
        look = self.words.__getitem__
        return [b"".join(map(look, row)) for row in rows]


@lru_cache(maxsize=4)
def encoder(name: str) -> ByteLevel | WordLevel:
    """The encoder of a public vocabulary file (a name in its folder, or a path)."""
    path = name if "/" in name else public_tokenizers.path(name)
    dropped = Tokenizer.from_file(path).encode("a b", add_special_tokens=False).tokens[0].endswith("</w>")
    return WordLevel(path) if dropped else ByteLevel(path)


MEMORIES.append(encoder.cache_clear)
