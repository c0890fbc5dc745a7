"""What must not grow with the tables: broadcasts, rows of a task, objects in a task."""

import pyarrow as pa
from pyspark.sql import functions as F

from driftloom.operators import drift, extraction, matching, skew
from driftloom.operators.replay import registry_after, replay
from driftloom.plans import catalog
from driftloom.sources import derived, registry_log
from driftloom.sources.derived import DerivedTables


def parts_table(spark, n):
    return spark.createDataFrame([(i, f"n{i}", "b", "t", i % 9, 1.0) for i in range(n)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")


def joins_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_visits_are_never_broadcast(spark, tmp_path):
    parts_table(spark, 50).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("extraction_requests", "method_routing", "registry_lookup", "visit_replay", "registry_covered", "registry_invalidate"):
        assert "BroadcastExchange" not in joins_of(catalog.queries()[name](spark, str(tmp_path))), name
    t = DerivedTables(spark, str(tmp_path))
    outcomes = replay(t.shop_visits(2), t.shop_responses(2))
    left = registry_after(outcomes, drift.fingerprint(t.shop_visits(2).select("visit_id", "html")))
    again = replay(t.shop_visits(2), t.shop_responses(2), stored=left)
    assert "BroadcastExchange" not in joins_of(left) and "BroadcastExchange" not in joins_of(again)


def test_tasks_that_make_pages_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "FAN_OUT_ROWS", 10)
    parts_table(spark, 95).write.parquet(str(tmp_path / "part.parquet"))
    assert DerivedTables(spark, str(tmp_path)).shop_visits(2).rdd.getNumPartitions() == 10


def test_parts_of_a_batch_are_small(monkeypatch):
    monkeypatch.setattr(extraction, "SLICE_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"html": ["x" * 100] * 95 + [None]})
    parts = list(extraction._slices([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= 10 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_maps_read_flat_equal_those_read_row_by_row():
    maps = pa.array([[("a", "b"), ("c", None)], None, [], [("x", "y")], None, [("k", "z")]], pa.map_(pa.string(), pa.string()))
    for part in (maps, maps.slice(1, 3), maps.slice(3), maps.slice(0, 0)):
        assert extraction._values(part) == part.to_pylist()


def test_carried_values_are_sorted_in_tasks_of_some_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    rows = spark.range(95).select((F.col("id") % 20).alias("key"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("value"))
    found = skew.last_over_key(rows, "key", ["id"], "value")
    assert found.rdd.getNumPartitions() == 10
    held, want = {}, []
    for r in rows.orderBy("id").collect():
        held[r.key] = r.value if r.value is not None else held.get(r.key)
        want.append((r.key, r.id, held[r.key]))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_pages_are_stored_once(spark, tmp_path):
    frame = spark.createDataFrame([(1, "<body><b id='a'>x</b></body>")], "n long, html string")
    matching.store_pages(frame, "n", str(tmp_path / "pages"))
    assert [p.name for p in (tmp_path / "pages").iterdir()] == ["trees"]


def test_a_group_of_pages_lists_its_own_files(spark, tmp_path, monkeypatch):
    own, listed = extraction._answers, []

    def answers(frame, function):
        listed.append(len(frame.inputFiles()))
        return own(frame, function)

    monkeypatch.setattr(extraction, "_answers", answers)
    queue = spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(40)], "visit_id long, url string, html string")
    found = extraction.run_extractor_resumably(queue, lambda html, url: ({"title": html}, {}, 1, 1), str(tmp_path / "kept"), group_rows=10)
    assert found.count() == 40 and len(listed) == 4 and max(listed) < sum(listed)


def test_of_two_rows_of_one_entry_the_log_gives_the_one_that_spent_less(spark, tmp_path):
    state = spark.createDataFrame([("k", 600, True), ("k", 0, True)], "key string, llm_tokens_spent long, alive boolean")
    whole = state.select(*[F.col(f.name) if f.name in state.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in registry_log.STATE])
    whole.coalesce(1).write.parquet(str(tmp_path / "changes/batch=0"))
    assert [r.llm_tokens_spent for r in registry_log.latest(spark, str(tmp_path)).collect()] == [0]
