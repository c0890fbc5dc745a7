"""The selector registry as a table: one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import quality
from driftloom.functions.times import older_than
from driftloom.operators.skew import latest_per_key, shuffled

SCHEMA = (
    T.StructType()
    .add("key", T.StringType())
    .add("url_pattern", T.StringType())
    .add("schema_name", T.StringType())
    .add("selectors", T.MapType(T.StringType(), T.StringType()))
    .add("structural_hash", T.StringType())
    .add("structural_shingles", T.ArrayType(T.LongType()))
    .add("visual_hash", T.StringType())
    .add("created_at", T.TimestampNTZType())
    .add("last_validated_at", T.TimestampNTZType())
    .add("hit_count", T.LongType())
    .add("miss_count", T.LongType())
    .add("llm_tokens_spent", T.LongType())
    .add("ttl_seconds", T.LongType())
)


def baselines(registry: DataFrame) -> DataFrame:
    """The stored entries as baselines for ``drift.drift_vs_registry``."""
    return registry.select("key", "structural_hash", F.col("structural_shingles").alias("shingles"), "visual_hash")


def is_expired(created_at: Column, ttl_seconds: Column, now: Column) -> Column:
    """Older than the lifetime, strictly."""
    return older_than(created_at, ttl_seconds, now)


def lookup(visits: DataFrame, registry: DataFrame, at: str = "crawled_at") -> DataFrame:
    """Each visit with the entry of its key; an expired entry counts as none (``live`` false).

    Both sides are shuffled by key: the registry has a row per key and grows with the visits.
    """
    entries = registry.select("key", *[F.col(c).alias(f"entry_{c}") for c in registry.columns if c != "key"])
    joined = visits.join(shuffled(entries), "key", "left")
    expired = is_expired(F.col("entry_created_at"), F.col("entry_ttl_seconds"), F.col(at))
    return joined.withColumns(
        {
            "expired": F.coalesce(expired, F.lit(False)),
            "live": F.coalesce(~expired, F.lit(False)),
        }
    )


def _live_pairs(visits: DataFrame, registry: DataFrame):
    joined = visits["key"] == registry["key"]
    return joined & ~is_expired(
        registry["created_at"], registry["ttl_seconds"], visits["crawled_at"]
    )


def covered(visits: DataFrame, registry: DataFrame) -> DataFrame:
    """Visits whose key has a live entry."""
    return visits.join(shuffled(registry), _live_pairs(visits, registry), "left_semi")


def extraction_queue(visits: DataFrame, registry: DataFrame) -> DataFrame:
    """Visits that need an extractor: no live entry for their key."""
    return visits.join(shuffled(registry), _live_pairs(visits, registry), "left_anti")


def queued_pages(visits: DataFrame, pages: DataFrame, registry: DataFrame, ident: str = "visit_id") -> DataFrame:
    """The rows of ``pages`` (``ident``, html and more) that need an extractor.

    ``visits`` are the narrow columns that decide it (``ident``, key, crawled_at); only the ids
    that are wanted meet the pages.
    """
    return pages.join(shuffled(extraction_queue(visits, registry).select(ident)), ident, "left_semi")


def with_selectors(visits: DataFrame, registry: DataFrame, at: str = "crawled_at") -> DataFrame:
    """Every visit with the ``selectors`` of its key's live entry, or NULL.

    ``registry`` has key, created_at, ttl_seconds and selectors.
    """
    entries = registry.select("key", F.struct("created_at", "ttl_seconds", "selectors").alias("_entry"))
    live = ~is_expired(F.col("_entry.created_at"), F.col("_entry.ttl_seconds"), F.col(at))
    joined = visits.join(shuffled(entries), "key", "left")
    return joined.withColumn("selectors", F.when(live, F.col("_entry.selectors"))).drop("_entry")


def upsert(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """New entries replace whole old ones, counters back to zero; the newest per key wins.

    ``entries`` has all columns of ``registry`` but the counters; a new entry counts as validated
    when it is made. Entries made at the same moment are told apart by their whole content.
    """
    fresh = entries.withColumns(
        {
            "hit_count": F.lit(0).cast("bigint"),
            "miss_count": F.lit(0).cast("bigint"),
            "last_validated_at": F.col("created_at"),
            "_new": F.lit(1),
        }
    )
    both = registry.withColumn("_new", F.lit(0)).unionByName(fresh)
    both = both.withColumn("_content", F.to_json(F.struct(*registry.columns)))
    return latest_per_key(both, "key", ["_new", "created_at", "_content"]).drop("_new", "_content", "_rank")


def invalidate(registry: DataFrame, dropped: DataFrame) -> DataFrame:
    """The registry without the keys in ``dropped`` (key, reason)."""
    return registry.join(shuffled(dropped), "key", "left_anti")


def invalidation_log(registry: DataFrame, dropped: DataFrame) -> DataFrame:
    """(key, reason) of the entries that really went; unknown keys are no events."""
    return dropped.join(shuffled(registry), "key", "left_semi")


def stats(registry: DataFrame, now: Column) -> DataFrame:
    """One row over the whole registry. The counters are NULL when it is empty."""
    expired = is_expired(F.col("created_at"), F.col("ttl_seconds"), now)
    rate = quality.failure_rate(F.col("hit_count"), F.col("miss_count"))
    return registry.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.sum(F.coalesce("hit_count", F.lit(0))).alias("total_hits"),
        F.sum(F.coalesce("miss_count", F.lit(0))).alias("total_misses"),
        F.sum(F.coalesce("llm_tokens_spent", F.lit(0))).alias("total_llm_tokens"),
        F.when(F.count(F.lit(1)) > 0, F.count_if(expired)).alias("expired"),
        F.avg(rate).alias("avg_null_rate"),
    )


def route(live: Column, has_drift: Column, has_extractor: Column, response_ok: Column) -> Column:
    """Which way a visit takes."""
    return (
        F.when(live & ~has_drift, F.lit("cache_hit"))
        .when(has_extractor & response_ok, F.lit("llm_extraction"))
        .when(has_extractor, F.lit("error"))
        .otherwise(F.lit("no_extractor"))
    )
