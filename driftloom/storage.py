"""Where jobs keep tables along the way: a folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    One is made only where none is set, and only on a single machine (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="driftloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once, write as a table in the shared folder, and go on from there.

    Unlike ``checkpoint()``, which runs its input twice. What was written survives the loss of
    executors, and later reads take only the columns they need.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stored table; one that is not there is empty, never an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as problem:  # noqa: BLE001 - analysis errors differ by storage
        if "PATH_NOT_FOUND" not in str(problem) and "does not exist" not in str(problem):
            raise
        return spark.createDataFrame([], schema)
