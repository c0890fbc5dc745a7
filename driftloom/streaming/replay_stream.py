"""The visit state machine on a stream of snapshots.

Every micro-batch is a replay of its own, from the entries that the one before left for the keys
it visits: rows are sorted by Spark and pass one by one, so a key may bring any number of visits,
and hot keys are cut as in the batch job. Under ``folder`` a micro-batch writes its own partition of

* ``extractions`` and ``audit_log``,
* ``late_visits``: visits older than the last one of their key, kept but not replayed,
* ``changes``: the registry's change log (``sources.registry_log``), rows of its own keys only.

A micro-batch that is run again starts from the same entries and replaces its own partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import keys
from driftloom.functions.times import epoch_micros
from driftloom.operators import drift as drifts
from driftloom.operators.replay import registry_after, replay
from driftloom.operators.skew import shuffled
from driftloom.params import DriftParams, RegistryParams
from driftloom.sources import registry_log, snapshots, tables
from driftloom.storage import settle


def replay_batch(
    visits: DataFrame, responses: DataFrame, folder: str, number: int, drift: DriftParams, registry: RegistryParams
) -> None:
    """One micro-batch: outcomes, late visits, and what changed in the registry."""
    spark = visits.sparkSession

    def save(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    key = keys.registry_key(F.col("url"), F.col("schema_name"))
    # Pages are read twice, by the replay and for the fingerprints of new entries; all else reads this.
    narrow = settle(visits.select("visit_id", key.alias("key"), epoch_micros(visits, "crawled_at").alias("at_us")))
    state = settle(registry_log.latest(spark, folder, number, narrow.select("key").distinct()))
    stored = registry_log.entries(state)
    before = state.select("key", "seen_us", "seen_id")
    behind = (F.col("at_us") < F.col("seen_us")) | ((F.col("at_us") == F.col("seen_us")) & (F.col("visit_id") <= F.col("seen_id")))
    late = settle(narrow.join(shuffled(before), "key").filter(behind).select("visit_id", "key", "at_us", "seen_us"))
    save(late, "late_visits")
    # Late visits are few: Spark broadcasts their ids unless they exceed its limit.
    timely = visits.join(late.select("visit_id"), "visit_id", "left_anti")
    outcomes = settle(replay(timely, responses, drift, registry, stored=stored))
    rows = tables.records(outcomes)
    save(rows.select(*tables.EXTRACTIONS), "extractions")
    save(rows.select(*tables.AUDIT), "audit_log")
    prints = drifts.fingerprint(snapshots.usable(timely).select("visit_id", "html"), drift.shingle_size)
    newest = narrow.groupBy("key").agg(F.max(F.struct(F.col("at_us").alias("seen_us"), F.col("visit_id").alias("seen_id"))).alias("s"))
    both = newest.unionAll(before.select("key", F.struct("seen_us", "seen_id").alias("s"))).groupBy("key").agg(F.max("s").alias("s"))
    registry_log.write_changes(both.select("key", "s.seen_us", "s.seen_id"), registry_after(outcomes, prints, registry, stored), folder, number)


def replay_stream(
    visits: DataFrame,
    responses: DataFrame,
    folder: str,
    checkpoint: str,
    drift: DriftParams = DriftParams(),
    registry: RegistryParams = RegistryParams(),
):
    """Start replaying a stream of visits into the tables under ``folder``."""

    def save(batch: DataFrame, number: int) -> None:
        replay_batch(batch, responses, folder, number, drift, registry)

    job = visits.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return job.trigger(availableNow=True).start()


def current_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The registry as all finished micro-batches left it."""
    return registry_log.entries(registry_log.latest(spark, folder))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("bigint"))
