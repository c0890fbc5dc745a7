"""Codes and packing against the plain tokenizer."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftloom.llm import codes, common, line_dedup, packing, tokens
from driftloom.llm.queries import op2_token_codes, op9_packing
from driftloom.storage import work_folder
from tests.llm.conftest import ODD_TEXTS


def plain_ids(vocabulary, texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected_codes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for (doc, _), ids in zip(rows, plain_ids(codes.VOCABULARY, [t for _, t in rows], 0)):
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def by_start(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[1])


def test_codes_of_documents(spark, folder, documents):
    assert by_start(op2_token_codes(spark, folder)) == expected_codes(documents)


def test_codes_of_odd_rows_and_random_access(spark, odd):
    path = work_folder(spark)
    codes.write_codes(odd, path)
    want = expected_codes(ODD_TEXTS)
    assert by_start(codes.checksums(codes.read_documents(spark, path))) == want
    stream = [i for ids in plain_ids(codes.VOCABULARY, [t for _, t in sorted(ODD_TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))], 0) for i in ids]
    places = spark.range(0, len(stream) + 5, 7).withColumnRenamed("id", "place")
    found = {r["place"]: r["id"] for r in codes.token_at(spark, path, places).collect()}
    assert found == {p: stream[p] for p in range(0, len(stream), 7)}


def test_codes_of_nothing(spark, empty):
    path = work_folder(spark)
    codes.write_codes(empty, path)
    assert codes.read_documents(spark, path).count() == 0


@pytest.mark.parametrize("top", [2, 300, 70_000, 1 << 32])
def test_levels_round_trip(top):
    ids = np.random.default_rng(3).integers(0, top, 5000, dtype=np.uint32)
    levels = codes.encode(ids)
    assert (codes.decode(levels[0], levels[1]) == ids).all()
    assert [codes.access(*levels, i) for i in range(0, 5000, 37)] == ids[::37].tolist()


def check_pieces(pieces, rows):
    pieces = [tuple(r) for r in pieces]
    ids = plain_ids(packing.VOCABULARY, [t for _, t in rows], 1)
    total = sum(map(len, ids))
    filled = sorted((s, o, n) for _, _, n, _, _, s, o in pieces)
    place = 0
    for sequence, offset, n in filled:
        assert sequence * packing.WINDOW + offset == place and offset + n <= packing.WINDOW
        place += n
    assert place == total
    known = {}
    for (doc, _), own in zip(rows, ids):
        known.setdefault(doc, []).append(own)
    for doc, start, n, check, tokens, _, _ in pieces:
        assert any(len(own) == tokens and crc(own[start : start + n]) == check for own in known[doc])
    assert sorted((d or -1, t) for d, s, _, _, t, _, _ in pieces if s == 0) == sorted((d or -1, len(i)) for (d, _), i in zip(rows, ids))


def test_packing_of_documents(spark, folder, documents):
    check_pieces(op9_packing(spark, folder).collect(), documents)


def test_packing_of_odd_rows(spark, odd, empty):
    pieces = packing.pack(odd)
    check_pieces(pieces.drop("ids").collect(), ODD_TEXTS)
    whole = sorted(packing.sequences(pieces).collect(), key=lambda r: r["sequence_id"])
    assert all(len(r["ids"]) == packing.WINDOW for r in whole[:-1])
    assert packing.pack(empty).count() == 0


def test_released_words_are_forgotten():
    held = tokens.encoder("byte_bpe_50k.json")
    ids = held.encode(["some words\nhere"])
    common.release()
    assert tokens.encoder.cache_info().currsize == 0
    assert tokens.encoder("byte_bpe_50k.json") is not held
    assert tokens.encoder("byte_bpe_50k.json").encode(["some words\nhere"]) == ids


def test_line_dedup_lets_go_of_words(monkeypatch):
    class Docs:
        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(line_dedup, "ids_and_texts", lambda docs: Docs())
    task = line_dedup._banded(None, 0.8)
    tokens.encoder("byte_bpe_50k.json")
    assert list(task(iter([]))) == []
    assert tokens.encoder.cache_info().currsize == 0
