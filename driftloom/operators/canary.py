"""Hit and miss history of registry entries: when a failing entry is retired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftloom.operators.fold import Counters, fold_by_key
from driftloom.operators.skew import SEGMENT_ROWS
from driftloom.params import RegistryParams

OUTCOME = (
    T.StructType()
    .add("event_id", T.LongType())
    .add("key", T.StringType())
    .add("op", T.StringType())
    .add("hit_count", T.LongType())
    .add("miss_count", T.LongType())
    .add("retired", T.BooleanType())
)


def make_count(params: RegistryParams):
    """Step over one ``set``, ``hit`` or ``miss``; hits and misses without an entry do nothing."""

    def count(entry: dict | None, row) -> tuple[tuple, dict | None]:
        if row.op == "set":
            entry = {"hits": 0, "misses": 0}
        elif entry is not None:
            entry = {
                "hits": entry["hits"] + (row.op == "hit"),
                "misses": entry["misses"] + (row.op == "miss"),
            }
        if entry is None:
            return (row.event_id, row.key, row.op, None, None, False), None
        hits, misses = entry["hits"], entry["misses"]
        retired = (
            row.op == "miss"
            and hits + misses >= params.min_samples
            and misses / (hits + misses) > params.max_null_rate
        )
        return (row.event_id, row.key, row.op, hits, misses, retired), None if retired else entry

    return count


def canary(
    events: DataFrame,
    params: RegistryParams = RegistryParams(),
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Counters after every event, and the events that retire their entry."""
    return fold_by_key(
        events, "key", ["at_us", "event_id"], make_count(params), OUTCOME, segment_rows, counters=Counters(params.max_null_rate)
    )
