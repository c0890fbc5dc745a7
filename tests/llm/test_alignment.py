"""Links, counts and groups against both libraries and plain dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from driftloom.llm import alignment
from driftloom.llm.queries import op13_tokenizer_alignment
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def piece_bytes(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def expected(rows, libraries):
    a, b = libraries
    letters = alignment._byte_letters()
    found, counts = [], Counter()
    for doc, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            two = [(i, piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]
            if b"".join(x for _, x in one) == b"".join(x for _, x in two) == (" " + text).encode():
                n = (len(one), len(two))
                ends = []
                for tokens in (one, two):
                    at, own = 0, {}
                    for i, x in tokens:
                        at += len(x)
                        own[at] = i
                    ends.append(own)
                both = sorted(ends[0].keys() & ends[1].keys())
                links = [(ends[0][e], ends[1][e]) for e in both]
                last = 0
                for e in both:
                    groups.append("|".join(",".join(str(own[x]) for x in sorted(own) if last < x <= e) for own in ends))
                    last = e
        counts.update(links)
        found.append((doc, *n, links, groups))
    best = defaultdict(int)
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    out = []
    for doc, n_a, n_b, links, groups in found:
        sums = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((doc, n_a, n_b, len(groups), len(links), *sums, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_odd_rows(spark, odd, empty, libraries):
    rows = [*ODD_TEXTS, (20, "a ▁ b"), (21, "\x00 \r\n\t"), (22, "</s> <0x0A> <unk>"), (23, "   x"), (24, "<|endoftext|>")]
    more = spark.createDataFrame([(i, t) for i, t in rows[len(ODD_TEXTS) :]], "doc_id long, text string")
    found = alignment.align(odd.select("doc_id", "text", "n", "at").unionByName(more, allowMissingColumns=True))
    assert rows_of(found) == expected(rows, libraries)
    assert [r for r in rows_of(found) if r[0] == 20] == [(20, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.align(empty).columns == found.columns and alignment.align(empty).count() == 0


def test_many_chunks_and_merges(spark, libraries):
    rng = random.Random(9)
    words = ["the", " and", "ing", "tion", "über", "漢", "🙂", "12", "\n", "  ", "antidisestablishment", ".", ","]
    # One word that half of the rows have, and a group of copies.
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = list(enumerate(texts + ["the " * rng.randint(1, 4) for _ in range(300)] + [texts[0]] * 50))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    # Chunks of a few documents, merged two at a time: as many levels as there can be.
    assert rows_of(alignment.align(frame, chunk=200, fan=2)) == expected(rows, libraries)


def test_merging_keeps_order_and_sums(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    rng = random.Random(2)
    runs, want = [], Counter()
    for _ in range(9):
        own = Counter((rng.randrange(12), rng.randrange(9)) for _ in range(60))
        want.update(own)
        b, a, n = np.array([(x, y, c) for (x, y), c in sorted(own.items())]).T
        runs.append([alignment.pack(b[i : i + 5], a[i : i + 5], n[i : i + 5]) for i in range(0, len(b), 5)])
    blocks = list(alignment.written(alignment.merged(runs)))
    b, a, n, best = (np.concatenate(c) for c in zip(*map(alignment.unpack, blocks)))
    assert list(zip(b.tolist(), a.tolist(), n.tolist())) == [(x, y, c) for (x, y), c in sorted(want.items())]
    top = {x: max(c for (y, _), c in want.items() if y == x) for x, _ in want}
    assert best.tolist() == [c == top[x] for x, c in zip(b.tolist(), n.tolist())]


def test_pair_counts(spark, odd, libraries):
    counts = {(r["id_b"], r["id_a"]): (r["links"], r["best"]) for r in alignment.pair_counts(odd).collect()}
    a, b = libraries
    word, piece = a.encode(" word").ids, b.encode("word")
    assert len(word) == len(piece) == 1 and counts[piece[0], word[0]] == (5000, True)


def test_documents(spark, folder, documents, libraries):
    assert rows_of(op13_tokenizer_alignment(spark, folder)) == expected(documents, libraries)
