"""Piecewise fingerprints: edited texts and likeness against plain versions."""

import hashlib
import random

import numpy as np

from driftloom.llm import piecewise
from driftloom.llm.queries import op5_piecewise_fingerprints
from tests.llm.conftest import ODD_TEXTS


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def read(fingerprint):
    level, *parts = fingerprint.split(":")
    return int(level), *[[p[i : i + 2] for i in range(0, len(p), 2)] for p in parts]


def like(left, right):
    left, right, best = read(left), read(right), 0.0
    for i in (1, 2):
        for j in (1, 2):
            if left[0] + i == right[0] + j:
                n = len(left[i]) + len(right[j])
                best = max(best, 2 * common(left[i], right[j]) / n if n else 1.0)
    return best


def check(rows, found):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    marks = {t: piecewise.written(piecewise.signatures([t.encode()])[0]) for _, t in rows}
    want = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mark = piecewise.written(piecewise.signatures([edited.encode()])[0])
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[text], mark, round(like(marks[text], mark), 9), round(like(marks[text], marks[after]), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, found)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents(spark, folder, documents):
    rows = op5_piecewise_fingerprints(spark, folder).collect()
    check(documents, rows)
    assert np.median([r["near_edited"] for r in rows]) > 0.3 > 0.1 > np.median([r["near_next"] for r in rows])


def test_odd_rows(spark, odd, empty):
    check(ODD_TEXTS, piecewise.compare_with_next(odd).collect())
    assert piecewise.compare_with_next(empty).count() == 0
    one = spark.createDataFrame([(3, "alone in the table")], "doc_id long, text string")
    check([(3, "alone in the table")], piecewise.compare_with_next(one).collect())


def test_an_insertion_moves_few_symbols():
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "pi", "rho"]) + str(rng.randint(0, 999)) for _ in range(800))
    one, two = piecewise.signatures([text.encode(), (text[:900] + "inserted words " + text[900:]).encode()])
    assert piecewise.likeness([one], [two])[0] > 0.9
    assert len(one[1]) <= 64
