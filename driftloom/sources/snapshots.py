"""Readers of page snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import keys
from driftloom.params import DEFAULT_SCHEMA_NAME


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots stored as Parquet."""
    return spark.read.parquet(path)


def stream_snapshots(
    spark: SparkSession, path: str, schema: T.StructType, max_bytes: int = 1 << 40
) -> DataFrame:
    """Snapshots arriving as Parquet files; ``max_bytes`` bounds what a failed micro-batch repeats."""
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
    return stream.parquet(path)


def read_html_files(
    spark: SparkSession,
    path: str,
    schema_name: str = DEFAULT_SCHEMA_NAME,
    url: Callable[[Column], Column] | None = None,
    crawled_at: Column | None = None,
) -> DataFrame:
    """One visit per HTML file, whole text, ready for ``replay``.

    ``url`` makes the key's URL of the file's address, which stands for itself otherwise;
    ``crawled_at`` is the time of the visit, else that of the file. A visit's id is a hash of
    address and time, so reading the same files again gives the same visits.
    """
    files = spark.read.text(path, wholetext=True)
    address = F.col("_metadata.file_path")
    at = F.col("_metadata.file_modification_time") if crawled_at is None else crawled_at
    return files.select(
        F.xxhash64(address, at.cast("string")).alias("visit_id"),
        (url(address) if url else address).alias("url"),
        F.lit(schema_name).alias("schema_name"),
        at.cast("timestamp_ntz").alias("crawled_at"),
        F.col("value").alias("html"),
        F.lit(None).cast("string").alias("visual_hash"),
    )


def is_unusable() -> Column:
    return F.coalesce(F.col("html") == "", F.lit(True))


def usable(visits: DataFrame) -> DataFrame:
    """Visits with a page."""
    return visits.filter(~is_unusable())


def rejects(visits: DataFrame) -> DataFrame:
    """Visits without a page: reported as errors, never stored."""
    others = [c for c in visits.columns if c not in ("html", "visual_hash")]
    return visits.filter(is_unusable()).select(
        *others, F.lit("error").alias("method"), F.lit("empty page").alias("error")
    )


def site_visits(pages: DataFrame) -> DataFrame:
    """Crawled pages as visits under their host: one site template per host."""
    return pages.select("page_id", "url", keys.host(F.col("url")).alias("host"), "html")
