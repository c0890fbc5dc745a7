"""The selector registry as a keyed change log: what a batch writes is what it changed.

Under a folder

* ``changes/batch=N`` has one row per key that batch N visited: its entry after the batch, or
  ``alive`` false where it has none any more, and the last visit the key has seen;
* ``base/upto=N`` has the latest row per key up to batch N, written by ``compact``;
* ``compactions/upto=N`` says that this base is whole. Only then it is read.

The state before a batch is the latest row per key of the newest base before it and the changes
since. A batch reads it for its own keys only: Spark filters the log by them before anything wide
is sorted. Changes are never rewritten or removed, so a batch that is run again, also one that a
later base already covers, starts from what it started from before and replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators import registry
from driftloom.operators.skew import latest_per_key, shuffled
from driftloom.storage import read_or_empty

STATE = T.StructType(
    [
        *registry.SCHEMA.fields,
        T.StructField("alive", T.BooleanType()),
        T.StructField("seen_us", T.LongType()),
        T.StructField("seen_id", T.LongType()),
    ]
)
_BATCH = T.StructField("batch", T.LongType())


def _base_before(spark: SparkSession, folder: str, number: int) -> int | None:
    """The newest base made of batches before ``number``."""
    done = read_or_empty(spark, f"{folder}/compactions", T.StructType([T.StructField("upto", T.LongType())]))
    return done.filter(F.col("upto") < number).agg(F.max("upto")).first()[0]


def latest(spark: SparkSession, folder: str, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The state (key, entry, alive, seen_us, seen_id) that the batches before ``before`` left.

    ``wanted`` (key) leaves out all other keys.
    """
    number = (1 << 62) if before is None else before
    base = _base_before(spark, folder, number)
    rows = read_or_empty(spark, f"{folder}/changes", T.StructType([*STATE.fields, _BATCH]))
    rows = rows.filter((F.col("batch") < number) & (F.col("batch") > (-1 if base is None else base)))
    if base is not None:
        whole = spark.read.schema(STATE).parquet(f"{folder}/base/upto={base}")
        rows = rows.unionByName(whole.withColumn("batch", F.lit(base).cast("bigint")))
    if wanted is not None:
        rows = rows.join(shuffled(wanted.select("key")), "key", "left_semi")
    # A visit that is there twice makes two rows of one entry: the one that spent less counts.
    rows = rows.withColumn("_saved", -F.col("llm_tokens_spent"))
    return latest_per_key(rows, "key", ["batch", "_saved"]).select(*STATE.fieldNames())


def entries(state: DataFrame) -> DataFrame:
    """The registry: entries of the keys that have one."""
    return state.filter("alive").select(*registry.SCHEMA.fieldNames())


def write_changes(seen: DataFrame, after: DataFrame, folder: str, number: int) -> None:
    """Store batch ``number``: ``seen`` (key, seen_us, seen_id) of its keys, ``after`` their entries.

    Rows are clustered by key, so that later batches skip files and row groups.
    """
    has = after.withColumn("alive", F.lit(True))
    rows = seen.join(shuffled(has), "key", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE])
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the latest row per key up to batch ``upto`` as a base; a job of its own, run beside the stream.

    It may be run again: the same batches give the same base.
    """
    whole = latest(spark, folder, upto + 1)
    whole.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/compactions/number={upto}")
