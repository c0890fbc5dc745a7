"""Reads over the extraction and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from driftloom.functions import quality
from driftloom.functions.times import epoch_micros
from driftloom.operators.skew import SEGMENT_ROWS, latest_per_key, window_over_key


def recent_extractions(extractions: DataFrame, url: str | None = None, limit: int = 10) -> DataFrame:
    """The newest ``limit`` rows of one URL, or of every URL."""
    if url is not None:
        rows = extractions.filter(F.col("url") == url)
        return rows.orderBy(F.desc("crawled_at"), F.desc("id")).limit(limit)
    return latest_per_key(extractions, "url", ["crawled_at", "id"], limit).withColumnRenamed(
        "_rank", "recency"
    )


def null_rate_history(audit: DataFrame, url: str | None = None) -> DataFrame:
    """Null rate over time: of one URL, or of all, ordered by a range-partitioned sort."""
    rows = audit if url is None else audit.filter(F.col("url") == url)
    return rows.select("url", "crawled_at", "id", "null_rate", "method", "drift_detected").orderBy(
        "url", "crawled_at", "id"
    )


def null_rate_trend(audit: DataFrame, visits: int = 5, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mean null rate of the last ``visits`` visits of each URL."""
    rows = audit.select("id", "url", "crawled_at", "null_rate")
    mean = {
        "trend": lambda w: F.avg("null_rate").over(w.rowsBetween(1 - visits, Window.currentRow))
    }
    return window_over_key(rows, "url", ["crawled_at", "id"], visits - 1, mean, segment_rows)


def audit_totals(audit: DataFrame, *by: str) -> DataFrame:
    """Dashboard counts of the audit log in one scan, over all of it or per group."""
    return _totals(audit.groupBy(*by))


def _totals(groups: GroupedData, *more: Column) -> DataFrame:
    hits = F.count_if(F.col("cache_hit"))
    others = F.count_if(~F.col("cache_hit"))
    return groups.agg(
        *more,
        others.alias("llm_runs"),
        hits.alias("cache_hits"),
        F.count_if(F.col("drift_detected")).alias("drift_events"),
        F.coalesce(F.sum("llm_tokens_used"), F.lit(0)).alias("total_llm_tokens"),
        F.when(hits + others > 0, hits.cast("double") / (hits + others).cast("double"))
        .otherwise(F.lit(0.0))
        .alias("cache_hit_rate"),
    )


def audit_rollup(audit: DataFrame, *by: str) -> DataFrame:
    """``audit_totals`` for every prefix of ``by``, down to the grand total; one scan.

    ``level`` is the number of columns that count; the others are NULL in that row.
    """
    level = F.lit(len(by)) - F.bit_count(F.grouping_id())
    return _totals(audit.rollup(*by), level.cast("int").alias("level"))


def summary_stats(extractions: DataFrame, audit: DataFrame) -> DataFrame:
    """One row of dashboard figures. The two one-row aggregates are added, not joined."""
    totals = audit_totals(audit).withColumn("total_extractions", F.lit(None).cast("bigint"))
    count = extractions.agg(F.count(F.lit(1)).alias("total_extractions"))
    both = totals.unionByName(count, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in totals.columns])


def key_counters(used: DataFrame, key: str = "key", results: str = "results") -> DataFrame:
    """Hits and misses per registry key of visits served by stored selectors.

    A visit with any selector result missing is a miss. Partial sums are taken before the shuffle.
    """
    missing = quality.null_count(F.col(results))
    return used.groupBy(key).agg(
        F.count_if(missing == 0).alias("hit_count"),
        F.count_if(missing > 0).alias("miss_count"),
    )


def stats_document(registry_stats: DataFrame, summary: DataFrame) -> DataFrame:
    """Both one-row statistics as one JSON document."""
    parts = registry_stats.select(
        F.to_json(F.struct(*registry_stats.columns)).alias("cache"), F.lit(None).cast("string").alias("db")
    ).unionByName(summary.select(F.to_json(F.struct(*summary.columns)).alias("db")), allowMissingColumns=True)
    return parts.agg(
        F.concat(F.lit('{"cache":'), F.max("cache"), F.lit(',"db":'), F.max("db"), F.lit("}")).alias("stats")
    )


def audit_windows(audit: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per time window and method; the same expression serves batch and stream."""
    span = F.window("crawled_at", width, slide) if slide else F.window("crawled_at", width)
    return (
        audit.groupBy(span.alias("w"), "method")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.count_if(F.col("drift_detected")).alias("drift_events"),
            F.sum("llm_tokens_used").alias("tokens"),
        )
        .select(F.col("w.start").alias("window_start"), "method", "visits", "drift_events", "tokens")
    )


def partial_sessions(audit: DataFrame, gap: str = "30 minutes", slice_seconds: int = 86_400) -> DataFrame:
    """Sessions of every URL within time slices; batch or stream.

    Rows are grouped by URL and slice, so a URL that has a large part of all rows is spread over
    as many tasks as it has slices. ``slice_seconds`` changes cost, not results.
    """
    number = F.floor(epoch_micros(audit, "crawled_at") / F.lit(slice_seconds * 1_000_000)).alias("slice")
    return (
        audit.groupBy("url", number, F.session_window("crawled_at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("visits"), F.count_if(F.col("drift_detected")).alias("drift_events"))
        .select("url", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "visits", "drift_events")
    )


def merged_sessions(partial: DataFrame) -> DataFrame:
    """Whole sessions: parts of one URL that overlap, cut apart at the edge of a slice, are one.

    A part ends one gap after its last visit, so it goes on in the next part if that starts by
    then, as in Spark's own session windows. Parts are as many as sessions and slices, whatever the number of visits.
    """
    along = Window.partitionBy("url").orderBy("session_start")
    apart = F.coalesce(F.lag("session_end").over(along) < F.col("session_start"), F.lit(True))
    numbered = partial.withColumn("_new", apart.cast("int")).withColumn("_number", F.sum("_new").over(along))
    return (
        numbered.groupBy("url", "_number")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            F.sum("visits").alias("visits"),
            F.sum("drift_events").alias("drift_events"),
        )
        .drop("_number")
    )


def audit_sessions(audit: DataFrame, gap: str = "30 minutes", slice_seconds: int = 86_400) -> DataFrame:
    """Visits of one URL that follow each other within ``gap``, as sessions."""
    return merged_sessions(partial_sessions(audit, gap, slice_seconds))
