"""Change log, as-of baselines, sliced sessions and relational matches against plain rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftloom.functions import markup
from driftloom.operators import analytics, drift, matching, skew
from driftloom.operators.replay import registry_after, replay
from driftloom.params import DriftParams, RegistryParams
from driftloom.sources import registry_log, snapshots
from driftloom.sources.derived import DerivedTables
from driftloom.streaming import replay_stream as streams
from driftloom.streaming import windows
from tests import pages

DAY = dt.datetime(2024, 3, 1)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


# ---------------------------------------------------------------- change log


def test_a_batch_writes_its_own_keys_and_can_be_run_again(spark, folder, tmp_path):
    t, out = DerivedTables(spark, folder), str(tmp_path)
    visits, answers = t.shop_visits(6), t.shop_responses(6)
    few = F.col("part_key").between(1, 3)
    batches = [visits.filter("visit <= 2"), visits.filter(F.col("visit").isin(3, 4) & few), visits.filter("visit = 5")]
    late = visits.filter("visit = 1").filter(few).withColumn("visit_id", F.col("visit_id") + 7_000_000)

    def run(number):
        streams.replay_batch(batches[number], answers, out, number, DriftParams(), RegistryParams())

    def written(number):
        return spark.read.schema(registry_log.STATE).parquet(f"{out}/changes/batch={number}")

    run(0)
    run(1)
    assert written(0).count() == visits.select("part_key").distinct().count()
    assert written(1).count() == 3
    once = rows_of(written(1))
    registry_log.compact(spark, out, 1)
    run(1)  # covered by the base meanwhile: it starts from batch 0 all the same
    assert rows_of(written(1)) == once
    registry_log.compact(spark, out, 1)
    batches[2] = batches[2].unionByName(late)
    run(2)
    got = streams.current_registry(spark, out)
    whole = visits.filter((F.col("visit") <= 2) | F.col("visit").isin(3, 4) & few | (F.col("visit") == 5))
    prints = drift.fingerprint(snapshots.usable(whole).select("visit_id", "html"))
    want = registry_after(replay(whole, answers), prints)
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    assert streams.read_table(spark, out, "late_visits").count() == 3
    # Without the base the log alone adds up to the same.
    assert rows_of(registry_log.latest(spark, out, 2)) == rows_of(spark.read.schema(registry_log.STATE).parquet(f"{out}/base/upto=1"))


def test_state_of_some_keys_reads_the_log_by_key(spark, folder, tmp_path):
    assert registry_log.latest(spark, str(tmp_path)).count() == 0
    assert registry_log.entries(registry_log.latest(spark, str(tmp_path), 5)).columns == [f.name for f in registry_log.registry.SCHEMA]


# ---------------------------------------------------------------- as-of baselines


@pytest.mark.parametrize("segment_rows", [1_000_000, 20])
def test_last_accepted_baseline_of_each_visit(spark, segment_rows, monkeypatch):
    monkeypatch.setattr(skew, "PIECES_PER_CORE", 50)
    rng = random.Random(3)
    visits, versions = [], []
    for i in range(400):
        key = "hot" if i % 2 else f"k{i % 7}"
        at = DAY + dt.timedelta(minutes=rng.randrange(300))
        visits.append((i, key, at, f"h{rng.randrange(4)}", sorted({rng.randrange(5) for _ in range(3)}), None))
        if rng.random() < 0.2:
            # Some at the very moment of a visit, some between visits, some of a key never visited.
            then = at if rng.random() < 0.5 else at + dt.timedelta(seconds=30)
            versions.append((rng.choice([key, "other"]), then, f"v{i:03d}", None if i % 5 == 0 else sorted({i % 5, 1}), None))
    v = spark.createDataFrame(visits, "visit_id long, key string, crawled_at timestamp_ntz, structural_hash string, shingles array<long>, visual_hash string")
    b = spark.createDataFrame(versions, "key string, accepted_at timestamp_ntz, structural_hash string, shingles array<long>, visual_hash string")
    found = drift.drift_as_of(v, b, "key", segment_rows=segment_rows)
    got = {r["visit_id"]: (r["previous_structural_hash"], r["structural_similarity"]) for r in found.collect()}
    want = {}
    for i, key, at, hash_, shingles, _ in visits:
        own = max(((then, h, s) for k, then, h, s, _ in versions if k == key and then < at), default=None, key=lambda x: x[:2])
        if own is None:
            want[i] = (None, 1.0)
        else:
            a, c = set(shingles), set(own[2] or [])
            want[i] = (own[1], 1.0 if own[1] == hash_ else len(a & c) / len(a | c) if c else 0.0)
    assert got == want
    assert drift.drift_as_of(v, b.limit(0), "key").filter("previous_structural_hash IS NOT NULL OR has_drift").count() == 0
    assert drift.drift_as_of(v.limit(0), b, "key").count() == 0


# ---------------------------------------------------------------- sessions


def log_of(spark, seed, n=500):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else f"u{rng.randrange(5)}", DAY + dt.timedelta(minutes=rng.randrange(8_000)), rng.random() < 0.3) for _ in range(n)]
    # Over midnight, and exactly one gap apart: one session.
    rows += [("edge", DAY + dt.timedelta(hours=23, minutes=m), False) for m in (30, 50, 70, 100)]
    return spark.createDataFrame(rows, "url string, crawled_at timestamp_ntz, drift_detected boolean").repartition(4)


@pytest.mark.parametrize("slice_seconds", [600, 86_400])
def test_sessions_of_slices_are_whole_sessions(spark, slice_seconds):
    log = log_of(spark, 1)
    plain = log.groupBy(F.session_window("crawled_at", "30 minutes").alias("w"), "url").agg(F.count(F.lit(1)).alias("visits"), F.count_if("drift_detected").alias("drift_events"))
    plain = plain.select("url", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "visits", "drift_events")
    assert rows_of(analytics.audit_sessions(log, "30 minutes", slice_seconds)) == rows_of(plain)
    assert analytics.audit_sessions(log.limit(0)).count() == 0
    # The hot URL's rows have as many groups as slices.
    parts = analytics.partial_sessions(log, "30 minutes", slice_seconds).filter("url = 'hot'")
    assert parts.count() >= min(8_000 * 60 // slice_seconds, 6)


def test_sessions_as_a_stream_with_late_rows(spark, tmp_path):
    where, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "url string, crawled_at timestamp_ntz, drift_detected boolean"
    # 23:50 and 0:10 are one session over midnight; 23:40 comes late but in time, 1:00 too late.
    arrivals = [[(23, 50), (24, 10)], [(23, 40)], [(60, 0)], [(25, 0)], [(200, 0)]]
    for rows in arrivals:
        frame = spark.createDataFrame([("u", DAY + dt.timedelta(hours=h, minutes=m), True) for h, m in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(schema).parquet(where)
        windows.write_sessions(windows.audit_sessions_stream(stream, "30 minutes", "1 hour"), out, state).awaitTermination()
    got = [(r["session_start"], r["session_end"], r["visits"], r["drift_events"]) for r in windows.read_sessions(spark, out).orderBy("session_start").collect()]
    at = lambda h, m: DAY + dt.timedelta(hours=h, minutes=m)
    assert got == [(at(23, 40), at(24, 40), 3, 3), (at(60, 0), at(60, 30), 1, 1)]


# ---------------------------------------------------------------- relational matches

SELECTORS = [
    "#headline", "b", "div p", "ul > li", "ul > li:nth-child(2) a", "body *", "p:nth-of-type(2)", "[data-x]", "[class~=c1]", "[id^=h]", "[href$='.html']",
    "[href*=a]", "[lang|=en]", ".c1.c2", "div.c1 > p.c2", "div div .c2", "h1, .c2", "li:first-child", "script", "a:first-of-type", "x(", "> p", "",
    "*", "table td", "body > div > p", "[title=\"it's\"]", "li:nth-child(1):nth-child(2)", "style", "p[data-x='1']",
]


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "p", "b", "ul", "li", "a", "h1", "td", "script", "style", "br"])
        attrs = "".join(f" {n}=\"{rng.choice(v)}\"" for n, v in (("class", ["c1", "c2", "c1 c2"]), ("id", ["h", "headline", "x"]), ("data-x", ["1", ""]), ("href", ["a.html", "b"]), ("lang", ["en", "en-us"])) if rng.random() < 0.3)
        inner = "" if tag == "br" else f"t{rng.randrange(9)} " + (random_page(rng, depth + 1) if depth < 3 and tag not in ("script", "style") else "")
        out.append(f"<{tag}{attrs}>{inner}" + ("" if tag == "br" else f"</{tag}>"))
    return " ".join(out)


def test_matches_equal_those_of_the_page_reader(spark):
    rng = random.Random(5)
    rows = [(i, "<body>" + random_page(rng) + "</body>") for i in range(40)] + [(90, pages.DESIGN_ONE), (91, ""), (92, None), (93, "just text")]
    wanted = {f"f{j}": s for j, s in enumerate(SELECTORS)} | {"none": None}
    frame = spark.createDataFrame([(i, h, wanted) for i, h in rows], "n long, html string, selectors map<string,string>")
    got = {(r["n"], r["field"]): r["text"] for r in matching.selector_match(frame, "n").collect()}
    want = {(i, f): v for i, h in rows for f, v in markup.extract_fields(markup.read_page(h or ""), wanted).items()}
    assert got == want
    assert any(got.values()) and matching.selector_match(frame.limit(0), "n").count() == 0


def test_no_python_once_pages_are_stored(spark, tmp_path):
    frame = spark.createDataFrame([(1, pages.DESIGN_ONE, {"a": "#headline", "b": "div > p"})], "n long, html string, selectors map<string,string>")
    matching.store_pages(frame, "n", str(tmp_path / "pages"))
    nodes, pieces = matching.stored_pages(spark, str(tmp_path / "pages"))
    wanted = frame.select("n", F.explode("selectors").alias("field", "selector"))
    plan = matching.match_selectors(wanted, nodes, pieces, matching.compiled(wanted), "n")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan


# ---------------------------------------------------------------- pages on the way


def test_answers_survive_a_run_that_ends_early(spark, tmp_path, monkeypatch):
    from driftloom.operators import extraction

    calls = str(tmp_path / "calls")

    def function(html, url):
        with open(calls, "a") as log:
            log.write(f"{url} {html}\n")
        if "bad" in html:
            raise ValueError("no")
        return {"title": html}, {}, 1, 2

    def called():
        return sorted(open(calls).read().splitlines())

    rows = [(i, f"u{i}", f"page {i}" + (" bad" if i == 5 else "")) for i in range(40)] + [(41, "none", None)]
    queue = spark.createDataFrame(rows, "visit_id long, url string, html string").repartition(3)
    own, groups = extraction._answers, []

    def ending(frame, f):
        groups.append(1)
        if len(groups) == 3:
            raise KeyboardInterrupt
        return own(frame, f)

    monkeypatch.setattr(extraction, "_answers", ending)
    folder = str(tmp_path / "kept")
    with pytest.raises(KeyboardInterrupt):
        extraction.run_extractor_resumably(queue, function, folder, group_rows=10)
    before = called()
    assert 0 < len(before) < 41
    monkeypatch.setattr(extraction, "_answers", own)
    found = extraction.run_extractor_resumably(queue, function, folder, group_rows=10)
    assert {r["visit_id"] for r in found.collect()} == {i for i, *_ in rows} and found.count() == 41
    assert called() == sorted(f"{u} {h}" for _, u, h in rows)  # every page once
    # A changed page is called again, an old answer of a page that is not asked for is not given.
    changed = spark.createDataFrame([(1, "u1", "new text"), (2, "u2", "page 2")], "visit_id long, url string, html string")
    answers = {r["visit_id"]: r["raw_text"] for r in extraction.run_extractor_resumably(changed, function, folder).collect()}
    assert "new text" in answers[1] and "page 2" in answers[2] and len(answers) == 2
    assert called().count("u1 new text") == 1 and len(called()) == 42
    assert extraction.run_extractor_resumably(queue.limit(0), function, str(tmp_path / "empty")).count() == 0


def exchanged(plan):
    """Columns of every exchange in a physical plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    out = []
    if name.startswith("ShuffleExchange"):
        columns = plan.output().iterator()
        names = []
        while columns.hasNext():
            names.append(columns.next().name())
        out.append(names)
    children = plan.children().iterator()
    while children.hasNext():
        out += exchanged(children.next())
    return out


def test_a_page_travels_once_in_the_replay(spark, folder, tmp_path):
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = DerivedTables(sibling, folder)
    t.shop_visits(4).write.parquet(str(tmp_path / "visits"))
    visits = sibling.read.parquet(str(tmp_path / "visits"))
    plan = replay(visits, t.shop_responses(4))._jdf.queryExecution().executedPlan()
    assert sum("html" in names for names in exchanged(plan)) == 1
