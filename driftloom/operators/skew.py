"""Ordered work per key when one key may hold a large part of all rows.

A key is *hot* when it has more than ``segment_rows`` rows, and more than a fair share of one of
``PIECES_PER_CORE`` pieces per core: finer cuts would not run earlier. Hot keys are cut along their
own order into segments of about that size; all other keys are one segment. Window functions then
run per segment, with the few rows they look back on copied in front of each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.storage import settle

SEGMENT_ROWS = 200_000
PIECES_PER_CORE = 4
TASK_ROWS = 100_000
SEGMENT = "_segment"
HALO = "_halo"


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join whose two sides both grow with the data: never a broadcast.

    Spark's estimate does not see that one small row became many visits, or a page, so it would
    send millions of rows through the driver. Both sides are sorted by key instead; skewed keys are
    split by adaptive execution.
    """
    return df.hint("merge")


def fair_share(df: DataFrame, segment_rows: int) -> int:
    """Rows of a segment: ``segment_rows``, or more if those were over ``PIECES_PER_CORE`` per core."""
    pieces = PIECES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return max(segment_rows, -(-df.count() // pieces))


def row_tasks(df: DataFrame) -> int:
    """Tasks of ``TASK_ROWS`` rows at most on average, and no fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def hot_keys(df: DataFrame, key: str, segment_rows: int) -> list[tuple]:
    """Keys with more than ``segment_rows`` rows, with their counts.

    Reads only the key column and pre-aggregates before its shuffle. With ``fair_share`` rows there
    are at most a few per core, and so are their segments; nothing that reaches the driver or is
    broadcast grows with the data.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [tuple(r) for r in counts.filter(F.col("n") > segment_rows).collect()]


def _cut_points(narrow: DataFrame, key: str, order: list[str], pieces: int) -> DataFrame:
    """For each hot key, the order values at which its segments start, ascending.

    Only key and order columns are sorted into ranges. One value per range reaches the driver,
    hot rows / segment rows of them, and from there they are fixed for all that follows.
    """
    ranges = narrow.select(key, *order).repartitionByRange(pieces, key, *order)
    firsts = ranges.groupBy(key, F.spark_partition_id().alias("_range")).agg(
        F.min(F.struct(*order)).alias("_at")
    )
    cuts = firsts.groupBy(key).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    return _local(narrow.sparkSession, cuts)


def _local(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A small result, computed once and kept as local rows."""
    return spark.createDataFrame(df.collect(), df.schema)


def _segment_number(cuts: Column, at: Column, pieces: int) -> Column:
    """How many cuts are not after ``at``, by binary search."""

    def narrow(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = F.shiftright(low + high, 1)
        return (
            F.when(low >= high, F.struct(low.alias("low"), high.alias("high")))
            .when(F.get(cuts, middle) <= at, F.struct((middle + 1).alias("low"), high.alias("high")))
            .otherwise(F.struct(low.alias("low"), middle.alias("high")))
        )

    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(pieces.bit_length() + 1))
    return F.aggregate(steps, start, narrow, lambda span: span["low"])


def split_segments(
    df: DataFrame,
    key: str,
    order: list[str],
    segment_rows: int = SEGMENT_ROWS,
    counted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys with their segment number).

    The second is None in the common case, no hot key: that costs one narrow count and changes
    nothing in the plan that follows. ``counted`` is a cheaper table with the same key and
    order columns.
    """
    narrow = df if counted is None else counted
    segment_rows = fair_share(narrow, segment_rows)
    hot = hot_keys(narrow, key, segment_rows)
    if not hot:
        return df, None
    names = [k for k, _ in hot]
    is_hot = F.coalesce(F.col(key).isin(names), F.lit(False))
    if None in names:
        is_hot = is_hot | F.col(key).isNull()
    pieces = sum(-(-n // segment_rows) for _, n in hot)
    cuts = _cut_points(narrow.filter(is_hot), key, order, pieces).withColumnRenamed(key, "_key")
    # Broadcast: its size is the number of segments, not of rows.
    marked = df.filter(is_hot).join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_key")))
    number = _segment_number(F.col("_cuts"), F.struct(*order), pieces + len(hot))
    # Several steps read these rows; they are computed once.
    return df.filter(~is_hot), settle(marked.withColumn(SEGMENT, number).drop("_key", "_cuts"))


def _tails(cut: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """For each segment of a hot key, the last ``rows`` rows before it.

    Works on ``rows`` rows per segment only, whatever the number of rows in the key.
    """
    newest = Window.partitionBy(key, SEGMENT).orderBy(*[F.desc(c) for c in order])
    ends = cut.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= rows)
    along = Window.partitionBy(key).orderBy(SEGMENT, *order)
    ends = ends.withColumn("_place", F.row_number().over(along)).drop("_rank")
    starts = ends.groupBy(key, SEGMENT).agg(F.min("_place").alias("_start"))
    wanted = starts.select(
        F.col(key).alias("_key"),
        F.col(SEGMENT).alias("_into"),
        F.explode(F.sequence(F.lit(1), F.lit(rows))).alias("_back"),
        "_start",
    )
    return (
        ends.join(
            wanted,
            F.col(key).eqNullSafe(F.col("_key"))
            & (F.col("_place") == F.col("_start") - F.col("_back")),
        )
        .withColumn(SEGMENT, F.col("_into"))
        .drop("_key", "_into", "_back", "_start", "_place")
    )


def window_over_key(
    df: DataFrame,
    key: str,
    order: list[str],
    look_back: int,
    columns: dict[str, callable],
    segment_rows: int = SEGMENT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add window columns that look at most ``look_back`` rows back in the order of the key.

    ``columns`` maps a name to a function of the ordered window. Exact for hot keys too: their
    segments are windows of their own, with the rows they look back on in front.
    """
    plain, cut = split_segments(df, key, order, segment_rows, counted)

    def add(rows: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumns({name: make(window) for name, make in columns.items()})

    if cut is None:
        return add(plain, [key])
    halo = _tails(cut, key, order, look_back).withColumn(HALO, F.lit(True))
    segments = cut.withColumn(HALO, F.lit(False)).unionByName(halo)
    hot = add(segments, [key, SEGMENT]).filter(~F.col(HALO)).drop(HALO)
    return add(plain, [key]).unionByName(hot.drop(SEGMENT))


def last_over_key(
    df: DataFrame, key: str, order: list[str], column: str, segment_rows: int = SEGMENT_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Replace ``column`` by its last value that is not NULL, up to each row in the order of the key.

    However far back that is: a segment of a hot key starts with the last value of those before
    it, one row per segment.
    """
    plain, cut = split_segments(df, key, order, segment_rows, counted)

    tasks = row_tasks(df if counted is None else counted)

    def add(rows: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # A given number of partitions: by their compressed bytes, adaptive execution would merge
        # what is many times larger when it is sorted.
        return rows.repartition(tasks, *by).withColumn(column, F.last(column, ignorenulls=True).over(window))

    if cut is None:
        return add(plain, [key])
    known = F.max_by(F.when(F.col(column).isNotNull(), F.col(column)), F.when(F.col(column).isNotNull(), F.struct(*order)))
    ends = cut.groupBy(key, SEGMENT).agg(known.alias("_end"))
    before = Window.partitionBy("_key").orderBy("_into").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col(key).alias("_key"), F.col(SEGMENT).alias("_into"), "_end")
    starts = starts.withColumn("_start", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    # Broadcast: one value per segment, a few per core.
    met = add(cut, [key, SEGMENT]).join(F.broadcast(starts), F.col(key).eqNullSafe(F.col("_key")) & (F.col(SEGMENT) == F.col("_into")))
    met = met.withColumn(column, F.coalesce(column, "_start")).drop("_key", "_into", "_start", SEGMENT)
    return add(plain, [key]).unionByName(met)


def previous(column: str) -> callable:
    """``column`` of the row before, for ``window_over_key``."""
    return lambda window: F.lag(column).over(window)


def latest_per_key(df: DataFrame, key: str, order: list[str], rows: int = 1) -> DataFrame:
    """The last ``rows`` rows of each key, newest first in ``_rank``.

    Spark applies the rank limit on the map side before the shuffle, so a hot key sends at most
    ``rows`` rows per task.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= rows)
