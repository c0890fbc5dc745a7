"""Removed passages against every window of every text."""

import hashlib
import random
import re

from driftloom.llm import substring_dedup
from tests.llm.conftest import ODD_TEXTS, SCHEMA

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(rows, window=20):
    rows = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
    seen, out = {}, []
    for place, (doc, text) in rows:
        words = WORD.findall(text or "")
        gone, own = set(), set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in own or seen.get(key, doc) != doc:
                gone.update(range(i, i + window))
            own.add(key)
            seen.setdefault(key, doc)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(frame):
    return sorted(map(tuple, substring_dedup.digest(substring_dedup.deduplicate(frame)).collect()), key=str)


def test_odd_rows(odd, empty):
    assert run(odd) == expected(ODD_TEXTS)
    assert run(empty) == []


def test_overlapping_passages(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(12)]
    rows = []
    for doc in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            passage = rng.choice(passages)
            low = rng.randint(0, 10)
            text += passage[low : low + rng.randint(5, 60)] if rng.random() < 0.8 else [rng.choice(words[:3]) for _ in range(25)]
        rows.append((doc - 20, rng.choice([" ", "\n", "  "]).join(text)))
    frame = spark.createDataFrame([(i, t, *([None] * 9)) for i, t in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(substring_dedup, "HELD_ROWS", 50)
    assert run(frame) == expected(rows)
