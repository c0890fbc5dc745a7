"""Encoding by the prefix table against the library's own encoder."""

import hashlib
import random

import numpy as np
import pytest

from driftloom.llm import pieces
from driftloom.llm.queries import op11_sentencepiece
from tests.llm.conftest import ODD_TEXTS


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows, library):
    out = []
    for doc, text in rows:
        ids = [*library.encode(text or ""), library.eos_id()]
        out.append((doc, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def known():
    return pieces.encoder(pieces.VOCABULARY)


def fuzzed(known, n):
    rng = random.Random(5)
    vocabulary = list(known.ids)
    letters = "abcdefgh ▁\n\t0123éß漢字🙂\x00　ﬁ<>/s"
    for i in range(n):
        if i % 3 == 0:
            yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        elif i % 3 == 1:
            yield "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))).replace("▁", " ")
        else:
            yield "".join(rng.choice("etaoinshr ") for _ in range(rng.randint(1, 60)))


@pytest.mark.parametrize("whole", [False, True])
def test_ids_equal_the_library_s(known, whole, monkeypatch):
    monkeypatch.setattr(known, "cut", None if whole else known.cut)
    texts = ["", " ", "   ", "a  b   c        d", "</s><s><unk><0x0A>", "\x00", "a" * 3000, " " * 500, "▁▁ ▁", *fuzzed(known, 3000)]
    for text in texts:
        assert np.frombuffer(known.encode(text), np.uint32).tolist() == known.library.encode(text), text


def test_merge_trees_agree_with_merging(known):
    rng = random.Random(6)
    tokens = [t for t in known.ids if len(t) > 1]
    some = [rng.choice(tokens) for _ in range(400)] + sorted(known.merges.irregular)
    for left in some:
        right = rng.choice(some)
        assert known.merges.compatible(left, right) == (known.merges.merge(left + right) == [left, right])


def test_pieces_that_no_merge_reaches_and_falling_ranks():
    # "abc" needs "ab" or "bc": none is there. "xyz" is better than its only half "xy".
    merges = pieces.Merges({"abc": 0, "xy": 5, "xyz": 1, "yz": 9, "zz": 3})
    assert merges.unreachable == {"abc"} and merges.irregular == {"xyz"}
    for left in ("x", "y", "z", "xy", "xyz", "zz"):
        for right in ("x", "y", "z", "yz", "xyz", "zz"):
            assert merges.compatible(left, right) == (merges.merge(left + right) == [left, right]), (left, right)


def test_odd_rows(spark, odd, empty, known):
    found = pieces.digest(pieces.decode(pieces.encode(odd)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(ODD_TEXTS, known.library)
    assert pieces.decode(pieces.encode(empty)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in pieces.decode(nothing).collect()] == [(1, None, "")]
    bare = {r["doc_id"]: r["ids"] for r in pieces.encode(odd.filter("doc_id < 9"), end=False).collect()}
    assert bare[1] == bare[2] == [] and bare[8] == known.library.encode("one")


def test_documents(spark, folder, documents, known):
    rows = op11_sentencepiece(spark, folder).collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected(documents, known.library)
