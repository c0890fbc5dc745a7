"""Ordered work per key: hot keys cut into segments give what whole keys give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators import analytics, drift, fold, skew
from driftloom.operators.canary import canary
from driftloom.operators.fold import fold_by_key
from driftloom.operators.replay import replay
from driftloom.operators.skew import hot_keys, latest_per_key, previous, window_over_key
from driftloom.params import RegistryParams
from driftloom.sources.derived import DerivedTables
from tests import pages


def skewed_rows(n=600, seed=7):
    rng = random.Random(seed)
    names = ["hot"] * 5 + ["warm", None, "a", "b", "c"]
    # Many equal times, so the id has to break ties.
    return [(i, rng.choice(names), rng.randrange(40), float(rng.randrange(9))) for i in range(n)]


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(skewed_rows(), "id long, key string, t long, v double").repartition(3)


def test_hot_keys_are_found(skewed):
    assert {k for k, _ in hot_keys(skewed, "key", 100)} == {"hot"}
    assert hot_keys(skewed, "key", 10_000) == []


@pytest.mark.parametrize("segment_rows", [1_000_000, 100, 17])
def test_window_over_key(skewed, segment_rows):
    by = {}
    for i, key, t, v in sorted(skewed_rows(), key=lambda r: (r[2], r[0])):
        by.setdefault(key, []).append((i, v))
    expected = {}
    for rows in by.values():
        for n, (i, _) in enumerate(rows):
            last = [v for _, v in rows[max(0, n - 3) : n + 1]]
            expected[i] = (rows[n - 1][1] if n else None, sum(last))
    columns = {
        "before": previous("v"),
        "last_four": lambda w: F.sum("v").over(w.rowsBetween(-3, Window.currentRow)),
    }
    out = window_over_key(skewed, "key", ["t", "id"], 3, columns, segment_rows)
    assert {r.id: (r.before, r.last_four) for r in out.collect()} == expected


def make_totals():
    """A machine that never forgets: the worst case for cut histories."""

    def step(state, row):
        total = (state or {"sum": 0.0})["sum"] * 0.5 + row.v
        return (row.id, total), {"sum": total}

    return step


def make_resets():
    """A machine that starts over at high values, and is empty after low ones."""

    def step(state, row):
        if row.v >= 7:
            state = {"n": 0}
        elif state:
            state = {"n": state["n"] + 1}
        shown = float(state["n"]) if state else -1.0
        return (row.id, shown), None if row.v == 0 else state

    return step


@pytest.mark.parametrize("segment_rows", [1_000_000, 100, 13])
@pytest.mark.parametrize("make", [make_totals, make_resets])
def test_fold_by_key(skewed, make, segment_rows):
    from types import SimpleNamespace

    expected, states, step = {}, {}, make()
    for i, key, t, v in sorted(skewed_rows(), key=lambda r: (r[2], r[0])):
        (_, shown), states[key] = step(states.get(key), SimpleNamespace(id=i, v=v))
        expected[i] = shown
    schema = T.StructType().add("id", T.LongType()).add("shown", T.DoubleType())
    out = fold_by_key(skewed, "key", ["t", "id"], make(), schema, segment_rows)
    rows = out.collect()
    assert len(rows) == len(expected) and {r.id: r.shown for r in rows} == expected


def test_latest_per_key(skewed):
    got = {r.key: r.id for r in latest_per_key(skewed, "key", ["t", "id"]).collect()}
    expected = {}
    for i, key, t, _ in skewed_rows():
        expected[key] = max(expected.get(key, (-1, -1)), (t, i))
    assert got == {k: i for k, (_, i) in expected.items()}


def one_hot_site(spark, folder):
    """Shop visits with half of all visits under one key and a sixth under another."""
    t = DerivedTables(spark, folder)
    story = F.col("part_key") % 6
    url = (
        F.when(story.isin(0, 4, 5), F.lit("https://one.example.com/x"))
        .when(story == 1, F.lit("https://two.example.com/x"))
        .otherwise(F.col("url"))
    )
    part = F.col("part_key") < 60
    return t.shop_visits().filter(part).withColumn("url", url), t.shop_responses().filter(part)


def test_replay_of_a_hot_key(spark, folder):
    visits, answers = one_hot_site(spark, folder)
    whole = sorted(map(str, replay(visits, answers).collect()))
    cut = sorted(map(str, replay(visits, answers, segment_rows=45).collect()))
    assert len(whole) == 600 and whole == cut
    assert any("high_null_rate" in row for row in whole)


def test_canary_of_a_hot_key(spark, folder):
    events = DerivedTables(spark, folder).cache_events().withColumn("key", F.lit("one"))
    whole = sorted(map(str, canary(events).collect()))
    assert whole == sorted(map(str, canary(events, segment_rows=90).collect()))
    assert any("retired=True" in row for row in whole)


def test_drift_and_trend_of_a_hot_key(spark, folder):
    t = DerivedTables(spark, folder)
    visits = t.pages().select("page_id", F.lit("one").alias("site"), "html")
    whole = sorted(map(str, drift.drift_vs_previous(visits, "site", ["page_id"]).collect()))
    cut = drift.drift_vs_previous(visits, "site", ["page_id"], segment_rows=9)
    assert whole == sorted(map(str, cut.collect()))
    log = t.crawl_log().withColumn("url", F.lit("u"))
    rounded = lambda df: sorted((r.id, round(r.trend, 9)) for r in df.collect())
    assert rounded(analytics.null_rate_trend(log)) == rounded(analytics.null_rate_trend(log, segment_rows=70))


def canary_rows(spark, ops):
    events = spark.createDataFrame([(i, "k", i, op) for i, op in enumerate(ops)], "event_id long, key string, at_us long, op string")
    return [(r.hit_count, r.miss_count, r.retired) for r in canary(events).orderBy("event_id").collect()]


def test_canary_rules(spark):
    # Five misses retire the entry; afterwards nothing counts until the next set.
    rows = canary_rows(spark, ["set"] + ["miss"] * 6 + ["hit", "set", "hit"])
    assert [r[2] for r in rows] == [False] * 5 + [True] + [False] * 4
    assert rows[6] == (None, None, False) and rows[8] == (0, 0, False) and rows[9] == (1, 0, False)
    # Exactly a quarter is still fine, and a hit never retires.
    assert not any(r[2] for r in canary_rows(spark, ["set"] + ["hit"] * 6 + ["miss"] * 2))
    assert canary_rows(spark, ["set"] + ["hit"] * 6 + ["miss"] * 3)[-1] == (6, 3, True)
    assert not any(r[2] for r in canary_rows(spark, ["set", "miss", "miss", "miss", "miss", "hit"]))
    # Without an entry nothing is counted.
    assert canary_rows(spark, ["hit", "miss"]) == [(None, None, False)] * 2


def test_a_steady_key_needs_few_rounds(spark, monkeypatch):
    """One entry lives through all segments, with misses, and is known after two rounds."""
    ops = ["set"] + ["miss" if i % 6 == 0 else "hit" for i in range(1200)]
    events = spark.createDataFrame([(i, "k", i, op) for i, op in enumerate(ops)], "event_id long, key string, at_us long, op string")
    whole = sorted(map(str, canary(events).collect()))
    monkeypatch.setattr(skew, "PIECES_PER_CORE", 10)
    monkeypatch.setattr(fold, "ROUNDS", 2)
    seen = []
    starts = fold._true_starts

    def spy(*args):
        out = starts(*args)
        seen.append((out[0].count(), out[1].count()))
        return out

    monkeypatch.setattr(fold, "_true_starts", spy)
    assert whole == sorted(map(str, canary(events, segment_rows=50).collect()))
    ((segments, open_chains),) = seen
    assert segments >= 20 and open_chains == 0


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_open_chains_are_run_in_one_go(spark, monkeypatch, rounds):
    """An entry that fails and is set again all the time: the rest runs from the last known state."""
    rng = random.Random(rounds)
    ops = [rng.choice(["hit", "hit", "miss", "set"] if i % 200 < 30 else ["hit"] * 11 + ["miss"] * 4) for i in range(1500)]
    rows = [(i, "k" if i % 3 else "j", i, op) for i, op in enumerate(ops)]
    events = spark.createDataFrame(rows, "event_id long, key string, at_us long, op string")
    whole = sorted(map(str, canary(events).collect()))
    monkeypatch.setattr(fold, "ROUNDS", rounds)
    assert whole == sorted(map(str, canary(events, segment_rows=20).collect()))


VISIT = "visit_id long, url string, schema_name string, crawled_at timestamp_ntz, html string, visual_hash string"
ANSWER = "visit_id long, raw_text string, input_tokens long, output_tokens long"


def history(spark, visits, answers, **limits):
    import datetime as dt
    import json

    start = dt.datetime(2024, 3, 9)
    rows = [(n, "https://s.example.com/p?x=%d" % n, "product_v1", start + dt.timedelta(hours=h), html, v) for n, h, html, v in visits]
    good = {"extracted": {"title": "T", "price": "$1"}, "selectors": pages.SELECTORS_ONE}
    texts = [(n, json.dumps(good) if text is True else text, 7, 5) for n, text in answers.items()]
    out = replay(
        spark.createDataFrame(rows, VISIT), spark.createDataFrame(texts, ANSWER), registry=RegistryParams(**limits)
    )
    return [(r.method, r.drift_severity, r.ended) for r in out.orderBy("visit_id").collect()]


ONE, TWO = pages.DESIGN_ONE, pages.DESIGN_TWO


def test_four_runs(spark):
    visits = [(1, 0, ONE, None), (2, 1, ONE, None), (3, 2, TWO, None), (4, 3, TWO, None)]
    assert history(spark, visits, {n: True for n in (1, 2, 3, 4)}) == [
        ("llm_extraction", "none", None),
        ("cache_hit", "none", None),
        ("llm_extraction", "major", "drift_major"),
        ("cache_hit", "none", None),
    ]
    # Without an extractor nothing is stored, so nothing can drift.
    assert history(spark, visits, {}) == [("no_extractor", "none", None)] * 4


def test_missing_selector_retires_on_the_fifth_cached_visit(spark):
    visits = [(n, n, ONE, None) for n in range(1, 9)]
    got = history(spark, visits, {n: True for n in range(1, 9)})
    assert [m for m, _, _ in got] == ["llm_extraction"] + ["cache_hit"] * 5 + ["llm_extraction", "cache_hit"]
    assert got[5] == ("cache_hit", "none", "high_null_rate") and got[6] == ("llm_extraction", "none", None)


def test_expiry_is_strict_and_empty_pages_change_nothing(spark):
    visits = [(1, 0, ONE, None), (2, 168, ONE, None), (3, 169, "", None), (4, 170, None, None), (5, 171, ONE, None)]
    assert history(spark, visits, {n: True for n in range(1, 6)}) == [
        ("llm_extraction", "none", None),
        ("cache_hit", "none", None),
        ("error", "none", None),
        ("error", "none", None),
        ("llm_extraction", "none", "ttl_expired"),
    ]


def test_visual_drift_and_bad_answers(spark):
    a, b = "ffffffffffffffff", "ffffffff00000000"
    visits = [(1, 0, ONE, a), (2, 1, ONE, None), (3, 2, ONE, b), (4, 3, ONE, b)]
    assert history(spark, visits, {1: True, 2: True, 3: "broken", 4: True}) == [
        ("llm_extraction", "none", None),
        ("cache_hit", "none", None),
        ("error", "minor", "drift_minor"),
        ("llm_extraction", "none", None),
    ]


def test_the_state_machine_measures_like_the_columns(spark):
    """Similarity exists as columns and inside the step of the replay: both say the same."""
    from types import SimpleNamespace

    from driftloom.functions import similarity
    from driftloom.operators import replay as machine

    rng = random.Random(12)
    hexes = [None, "", "xyz", "ffff0000ffff000g", "ffff0000ffff0000", "0123456789abcdef", "FFFF0000ffff0001"]
    rows = []
    for n in range(120):
        left, right = ([rng.randrange(12) for _ in range(rng.randrange(9))] for _ in range(2))
        rows.append((n, rng.choice("ab"), rng.choice("ab"), sorted(set(left)), sorted(set(right)), rng.choice(hexes), rng.choice(hexes)))
    df = spark.createDataFrame(rows, "n int, h1 string, h2 string, s1 array<long>, s2 array<long>, v1 string, v2 string")
    structural = similarity.structural_similarity(F.col("h1"), F.col("s1"), F.col("h2"), F.col("s2"))
    visual = similarity.visual_similarity(F.col("v1"), F.col("v2"))
    for r in df.select("*", structural.alias("x"), visual.alias("y")).collect():
        entry = {"hash": r.h2, "shingles": r.s2}
        assert r.x == machine._structural(entry, SimpleNamespace(structural_hash=r.h1, shingles=r.s1))
        assert r.y == machine._visual(r.v1, r.v2)
