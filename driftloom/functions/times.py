"""Times that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column."""
    ts = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(ts)
    # timestamp_diff would go through the session's zone and stumble over its clock changes.
    seconds = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    """TIMESTAMP_NTZ from microseconds since 1970."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=micros.cast("decimal(24,0)") / 1_000_000)


def older_than(since: Column, seconds: Column, now: Column) -> Column:
    """More than ``seconds`` between ``since`` and ``now``, strictly."""
    return (now - since) > F.make_dt_interval(secs=seconds)
