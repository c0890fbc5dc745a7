"""A session with settings that fit the size of the input."""

from __future__ import annotations

from pyspark.sql import SparkSession

TASK_BYTES = 128 << 20


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """About 128 MB per shuffle task, and at least two tasks per core."""
    return max(2 * cores, -(-input_bytes // TASK_BYTES))


def stateful_session(spark: SparkSession, splits: int) -> SparkSession:
    """A sibling session for streaming jobs over ``splits`` input splits.

    The partitions of a stateful operator are fixed when its job first starts, and each costs
    a state store per micro-batch, so small inputs get fewer than the session's setting.
    """
    sibling = spark.newSession()
    limit = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(2 * spark.sparkContext.defaultParallelism, splits)
    sibling.conf.set("spark.sql.shuffle.partitions", min(limit, wanted))
    sibling.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return sibling


def build_session(app: str, input_bytes: int, cores: int, master: str | None = None) -> SparkSession:
    """Session for a job over ``input_bytes`` on ``cores``; adaptive execution merges small tasks."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", shuffle_partitions(input_bytes, cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
