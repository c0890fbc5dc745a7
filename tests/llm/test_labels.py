"""Scores learned from labels: held-out accuracy, scans against brute force, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftloom.llm import quality, toxicity
from driftloom.llm.queries import op6_toxic_segments, op7_quality_rules
from tests.llm.conftest import ODD_TEXTS

MIDDLE = "/root/testdata/sf0.01"


def maximal(steps):
    """Segments found by taking the best one and going on left and right of it."""
    if not len(steps):
        return []
    best = (0, 0, 0.0)
    for i in range(len(steps)):
        total = 0.0
        for j in range(i, len(steps)):
            total += steps[j]
            if total > best[2] + 1e-9:
                best = (i, j + 1, total)
    if best[2] <= 0:
        return []
    i, j, total = best
    return maximal(steps[:i]) + [(i, j, total)] + [(a + j, b + j, s) for a, b, s in maximal(steps[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    steps = np.random.default_rng(seed).normal(-0.3, 1.5, 40)
    got, want = toxicity.segments(steps), maximal(steps)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_isotonic():
    got = toxicity.isotonic(np.array([1.0, 0, 3, 2]), np.array([2.0, 2, 4, 2]))
    assert np.allclose(got, [0.25, 0.25, 0.75, 1.0])


def test_toxic_scores_on_held_out_rows(spark):
    rows = op6_toxic_segments(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").collect()
    held = [(r["toxic"], r["predicted"], r["score"]) for r in rows if r["held_out"]]
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, p, s in held)
    assert sum(t == p for t, p, _ in held) >= 0.9 * len(held)


def test_held_out_labels_are_never_used(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.toxic_split(labels["doc_id"]) == toxicity.HELD_OUT
    turned = labels.withColumn("toxic", (held.cast("int") + labels["toxic"]) % 2)
    one, two = (toxicity.learn(docs, x) for x in (labels, turned))
    assert (one.steps == two.steps).all() and (one.scores == two.scores).all()


def test_toxicity_of_odd_rows(spark, odd, empty, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.selectExpr("doc_id", "toxic", "1 AS text", "doc_id AS score"))
    rows = toxicity.score(odd, model).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ODD_TEXTS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.passages(odd, model).count() >= 0
    without = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, without).collect()} == {0.0}


def test_a_passage_that_comes_again_is_a_passage(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    words = sorted({w for r in docs.select("text").collect() for w in re.findall("[a-z]+", (r["text"] or "").lower())})
    bucket = {w: int(toxicity.tokens(pa.array([w]))[0][0]) for w in words}
    ranked = sorted(words, key=lambda w: model.steps[bucket[w]])
    mild, bad = ranked[: len(ranked) // 3], ranked[-20:]
    rng = random.Random(7)
    text = [rng.choice(mild) for _ in range(1200)]
    text[400:420] = text[820:840] = bad
    found = toxicity.passages(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), model).collect()
    assert any(r["first_token"] <= 405 and r["last_token"] >= 414 for r in found) and any(r["first_token"] <= 825 and r["last_token"] >= 834 for r in found)
    # One word over and over is no more than that word once.
    again = spark.createDataFrame([(1, " ".join([bad[-1]] * 500))], "doc_id long, text string")
    assert all(r["first_token"] == r["last_token"] == 0 for r in toxicity.passages(again, model).collect())


WORD = re.compile("[^\x20\x09-\x0d]+")


def figures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_base_figures(documents):
    rng = random.Random(4)
    texts = [t or "" for _, t in ODD_TEXTS] + [t for _, t in documents]
    texts += [" ".join(rng.choice("ab|") for _ in range(rng.randint(0, 30))) + "\nx\n \nx\n\n" for _ in range(50)]
    got = list(zip(*(c.tolist() for c in quality.base(pa.array(texts)))))
    assert got == [figures(t) for t in texts]


def test_quality_learns_the_labels(spark):
    rows = op7_quality_rules(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").collect()
    judged = [(r["quality"], int(r["kept"])) for r in rows if not r["base_failed"]]
    assert sum(q == k for q, k in judged) >= 0.97 * len(judged)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_quality_of_odd_rows(spark, odd, empty, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert quality.learn(docs, labels.limit(0)) is None
    rows = quality.judge(odd, None).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in rows) == sorted((str(i), figures(t or "")[0], False) for i, t in ODD_TEXTS)
    assert quality.judge(empty, None).count() == 0
