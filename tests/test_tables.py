"""Registry, stored tables, files, streams and plans."""

import datetime as dt

from pyspark.sql import functions as F

from driftloom.operators import analytics, extraction, registry
from driftloom.operators.replay import replay
from driftloom.sources import snapshots, tables
from driftloom.sources.derived import DerivedTables
from tests import pages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def entries(spark, rows):
    return spark.createDataFrame(
        [(k, dt.datetime(2024, 1, d), None, h, m, 10, 604_800) for k, d, h, m in rows],
        "key string, created_at timestamp_ntz, last_validated_at timestamp_ntz, hit_count long, miss_count long, llm_tokens_spent long, ttl_seconds long",
    )


def test_registry_rules(spark):
    stored = entries(spark, [("a", 1, 3, 1), ("b", 2, 0, 0), ("c", 9, 5, 5)])
    now = F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")
    expired = {r.key: r.x for r in stored.select("key", registry.is_expired(F.col("created_at"), F.col("ttl_seconds"), now).alias("x")).collect()}
    assert expired == {"a": True, "b": False, "c": False}
    stats = registry.stats(stored, now).first()
    assert (stats.total_entries, stats.total_hits, stats.total_misses, stats.total_llm_tokens, stats.expired) == (3, 8, 6, 30, 1)
    assert stats.avg_null_rate == (0.25 + 0.0 + 0.5) / 3
    empty = registry.stats(stored.filter("false"), now).first()
    assert empty.total_entries == 0 and empty.total_hits is None and empty.expired is None
    new = entries(spark, [("a", 5, 9, 9), ("d", 6, 9, 9), ("a", 4, 9, 9)])
    got = {r.key: (r.created_at.day, r.hit_count) for r in registry.upsert(stored, new).collect()}
    assert got == {"a": (5, 0), "b": (2, 0), "c": (9, 5), "d": (6, 0)}
    dropped = spark.createDataFrame([("a", "drift_major"), ("zz", "ttl_expired")], "key string, reason string")
    assert {r.key for r in registry.invalidate(stored, dropped).collect()} == {"b", "c"}
    assert [tuple(r) for r in registry.invalidation_log(stored, dropped).collect()] == [("a", "drift_major")]


def test_registry_round_trip(spark, tmp_path):
    stored = entries(spark, [("a", 1, 3, 1), ("b", 2, 0, 0)])
    path = str(tmp_path / "registry")
    tables.write_registry(stored, path)
    lines = spark.createDataFrame([('{"key": "c", "hit_count": 4}',), ('{"key": "d", "hit_',), ("not json",), ("{}",)], "value string")
    assert [r.hit_count for r in tables.registry_from_lines(lines).collect()] == [4]
    assert sorted(r.line for r in tables.broken_lines(lines).collect()) == ["not json", '{"key": "d", "hit_', "{}"]
    assert {(r.key, r.hit_count) for r in tables.read_registry(spark, path).collect()} == {("a", 3), ("b", 0)}
    assert tables.read_registry(spark, str(tmp_path / "missing")).count() == 0


def test_html_files(spark, tmp_path):
    (tmp_path / "one.html").write_text(pages.DESIGN_ONE)
    (tmp_path / "two.html").write_text(pages.DESIGN_TWO)
    rows = {r.url.rsplit("/", 1)[1]: r.html for r in snapshots.read_html_files(spark, str(tmp_path)).collect()}
    assert rows == {"one.html": pages.DESIGN_ONE, "two.html": pages.DESIGN_TWO}


def test_outcomes_are_appended_and_read_back(spark, folder, tmp_path):
    t = DerivedTables(spark, folder)
    few = F.col("part_key") < 30
    outcomes = replay(t.shop_visits(4).filter(few), t.shop_responses(4).filter(few))
    stored, audit = str(tmp_path / "extractions"), str(tmp_path / "audit")
    tables.save_outcomes(outcomes, stored, audit, "1")
    for _ in range(2):  # a run that is written again replaces itself
        tables.save_outcomes(outcomes.withColumn("visit_id", F.col("visit_id") + 1_000_000), stored, audit, "2")
    rows, log = spark.read.parquet(stored), spark.read.parquet(audit)
    # Four visits of 30 parts twice, less the empty page of every sixth part.
    assert rows.count() == log.count() == 2 * (4 * 30 - 5)
    assert rows.columns == [*tables.EXTRACTIONS, "run"] and log.columns == [*tables.AUDIT, "run"]
    url = rows.filter("method = 'cache_hit'").select("url").first()[0]
    recent = analytics.recent_extractions(rows, url)
    assert [r.url for r in recent.collect()] == [url, url]
    assert "EqualTo(url," in plan(recent)
    history = analytics.null_rate_history(log, url)
    assert "EqualTo(url," in plan(history) and "selectors_used" not in plan(history)
    totals = analytics.summary_stats(rows, log).first()
    assert totals.total_extractions == rows.count() and totals.cache_hits + totals.llm_runs == log.count()


def test_summary_of_nothing(spark, folder):
    log = DerivedTables(spark, folder).crawl_log().filter("false")
    row = analytics.summary_stats(log, log).first()
    assert (row.total_extractions, row.cache_hits, row.total_llm_tokens, row.cache_hit_rate) == (0, 0, 0, 0.0)


def test_page_text_is_read_only_where_needed(spark, folder):
    from driftloom.plans import catalog

    queries = catalog.queries()
    assert "html" not in plan(queries["cache_key"](spark, folder))
    assert "Window" in plan(queries["drift_vs_previous"](spark, folder))
    # Only fingerprints travel: the exchange by host sits above the projection that drops the page.
    text = plan(queries["drift_vs_previous"](spark, folder))
    assert text.index("Exchange hashpartitioning(host") < text.index("sha2(")
    assert plan(queries["summary_stats"](spark, folder)).count("FileScan") == 2
    assert "WindowGroupLimit" in plan(queries["recent_extractions"](spark, folder))
    for name in ("registry_lookup", "summary_stats", "crawl_stats", "drift_report", "visit_replay", "selector_extract"):
        text = plan(queries[name](spark, folder))
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_induced_selectors_find_their_values(spark):
    fields = {"title": "Stove Kettle 2 l", "price": "£64.50", "sku": "No. 88-K", "in_stock": "Available", "x": "absent", "y": None}
    df = spark.createDataFrame([(1, pages.DESIGN_ONE, fields), (2, pages.DESIGN_TWO, fields)], "n int, html string, fields map<string,string>")
    one, two = extraction.induce_selectors(df).orderBy("n").collect()
    assert one.selectors == {"title": "#headline", "price": "#cost", "sku": "#ref", "in_stock": "#stock", "x": None, "y": None}
    assert two.selectors == {"title": ".headline", "price": ".amount", "sku": ".ref", "in_stock": ".stock", "x": None, "y": None}
    found = df.drop("fields").join(extraction.induce_selectors(df), "n")
    for row in extraction.apply_selectors(found).collect():
        assert {k: v for k, v in row.raw.items() if v} == {k: fields[k] for k in ("title", "price", "sku", "in_stock")}


def test_preference_and_uniqueness(spark):
    text = '<p class="u" data-qa="q" id="i">v</p><p class="d" data-qa="r">w</p><b class="d u2">w2</b><i class="d">z</i>'
    df = spark.createDataFrame([(text, {"a": "v", "b": "w", "c": "w2", "d": "z"})], "html string, fields map<string,string>")
    assert extraction.induce_selectors(df).first().selectors == {"a": "#i", "b": '[data-qa="r"]', "c": ".u2", "d": None}


def test_stream_in_several_batches_and_restarts(spark, folder, tmp_path):
    """Small triggers, a stop in between, a hot key and a late visit end where the batch job ends."""
    from driftloom.streaming import replay_stream as streams

    t = DerivedTables(spark, folder)
    few = F.col("part_key") < 12
    visits = t.shop_visits(6).filter(few).withColumn("url", F.when(F.col("part_key") < 3, F.lit("https://hot.example.com/")).otherwise(F.col("url")))
    answers = t.shop_responses(6).filter(few)
    arrived = visits.select("visit_id", "url", "schema_name", "crawled_at", "html", "visual_hash", "visit")
    where, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for first, last in ((1, 3), (4, 6)):
        # One file per visit number, written in order: the source takes the oldest first.
        for visit in range(first, last + 1):
            arrived.filter(F.col("visit") == visit).coalesce(1).write.mode("append").parquet(where)
        stream = snapshots.stream_snapshots(spark, where, arrived.schema, 1_000)
        job = streams.replay_stream(stream, answers, out, state)
        job.awaitTermination()
        assert len(job.recentProgress) > 1
    expected = tables.audit_log(tables.records(replay(visits, answers)))
    # A visit older than what its key has seen is kept aside and changes nothing.
    arrived.filter("visit = 2").withColumn("visit_id", F.col("visit_id") + 7_000_000).coalesce(1).write.mode("append").parquet(where)
    streams.replay_stream(snapshots.stream_snapshots(spark, where, arrived.schema, 1_000), answers, out, state).awaitTermination()
    got = streams.read_table(spark, out, "audit_log").select(*tables.AUDIT)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert streams.read_table(spark, out, "late_visits").count() == 12


def test_windows_drop_late_rows_when_they_close(spark, tmp_path):
    import datetime as dt

    from driftloom.streaming import windows

    where, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "crawled_at timestamp_ntz, method string, drift_detected boolean, llm_tokens_used long"
    day = dt.datetime(2024, 3, 1)
    for hours in ([1, 2, 30], [3], [80]):
        rows = [(day + dt.timedelta(hours=h), "m", False, 1) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(schema).parquet(where)
        windows.write_windows(windows.audit_windows_stream(stream, "1 day"), out, state).awaitTermination()
    got = {r.window_start.day: r.visits for r in windows.read_windows(spark, out).collect()}
    # The row of hour 3 came after its day had closed.
    assert got == {1: 2, 2: 1, 4: 1}


def test_extractor_is_called_once_per_page(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def function(html, url):
        with open(calls, "a") as log:
            log.write(url + "\n")
        return {"title": html}, {}, 1, 1

    answers = extraction.run_extractor(spark.createDataFrame([("a", "x"), ("b", "y")], "html string, url string"), function)
    assert answers.count() == 2 and len(answers.collect()) == 2
    assert sorted(open(calls).read().split()) == ["x", "y"]


def test_files_can_be_replayed(spark, tmp_path):
    (tmp_path / "one.html").write_text(pages.DESIGN_ONE)
    key = lambda address: F.concat(F.lit("https://shop.example.com/"), F.regexp_extract(address, r"([a-z]+)\.html$", 1))
    read = lambda hour: snapshots.read_html_files(spark, str(tmp_path), "product_v1", key, F.lit(f"2024-03-01 0{hour}:00:00").cast("timestamp_ntz"))
    visits = read(1).unionAll(read(2))
    answer = '{"extracted": {}, "selectors": {"title": "#headline"}}'
    answers = visits.select("visit_id", F.lit(answer).alias("raw_text"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    rows = replay(visits, answers).orderBy("crawled_at").collect()
    assert [r.method for r in rows] == ["llm_extraction", "cache_hit"] and rows[0].url == "https://shop.example.com/one"
