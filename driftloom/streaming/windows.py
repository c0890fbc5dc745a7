"""Windowed counts over a stream of audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.times import epoch_micros, from_epoch_micros
from driftloom.operators.analytics import audit_windows, merged_sessions, partial_sessions


def audit_windows_stream(
    audit: DataFrame, width: str = "1 day", lateness: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Counts per window and method; a window closes ``lateness`` after its end.

    Partial counts are kept per task before the shuffle, so a busy method is no hot spot.
    Watermarks need TIMESTAMP, so the time is taken as UTC and given back without a zone.
    """
    timed = audit.withColumn("crawled_at", F.timestamp_micros(epoch_micros(audit, "crawled_at")))
    counts = audit_windows(timed.withWatermark("crawled_at", lateness), width, slide)
    return counts.withColumn("window_start", from_epoch_micros(F.unix_micros("window_start")))


def write_windows(counts: DataFrame, folder: str, checkpoint: str):
    """Start writing the windows that each micro-batch changed; closed windows leave the state."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    job = counts.writeStream.outputMode("update").foreachBatch(save)
    return job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The last counts of every window and method."""
    rows = spark.read.parquet(folder)
    newest = Window.partitionBy("window_start", "method").orderBy(F.desc("batch"))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "batch")


def audit_sessions_stream(audit: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", slice_seconds: int = 86_400) -> DataFrame:
    """Parts of sessions, cut at the edges of time slices; a part closes ``lateness`` after its end.

    The state of a busy URL is spread over its slices. ``read_sessions`` puts the parts together.
    """
    timed = audit.withColumn("crawled_at", F.timestamp_micros(epoch_micros(audit, "crawled_at")))
    parts = partial_sessions(timed.withWatermark("crawled_at", lateness), gap, slice_seconds)
    return parts.withColumns({c: from_epoch_micros(F.unix_micros(c)) for c in ("session_start", "session_end")})


def write_sessions(parts: DataFrame, folder: str, checkpoint: str):
    """Start writing the parts that have closed; each is written once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    job = parts.writeStream.outputMode("append").foreachBatch(save)
    return job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Whole sessions of the parts that have closed."""
    return merged_sessions(spark.read.parquet(folder).drop("batch"))
