"""Connected components by distributed union-find: hook to smaller parents, then halve paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.storage import settle


def components(links: DataFrame) -> DataFrame:
    """v, component: the smallest id reachable from every id that occurs in ``links`` (a, b: long).

    Each round is joins on equal keys and minima that combine before the shuffle; a hub's links
    are never gathered. Parents are stored after every round, so a lost executor costs one round.
    Only the number of changed rows reaches the driver. Self-links, repeats and nulls are ignored.
    """
    one = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = settle(one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parents = settle(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
    while True:
        above = parents.select(F.col("v").alias("p"), F.col("p").alias("g"))
        grand = parents.join(above, "p").select("v", "p", "g")
        near = edges.join(grand.select(F.col("v").alias("b"), "g"), "b").groupBy(F.col("a").alias("v")).agg(F.min("g").alias("m"))
        met = grand.join(near, "v")
        own = met.select("v", F.least("g", "m").alias("c"), F.col("p").alias("old"))
        hooked = met.groupBy(F.col("p").alias("v")).agg(F.min("m").alias("c")).withColumn("old", F.lit(None).cast("long"))
        step = settle(own.unionAll(hooked).groupBy("v").agg(F.min("c").alias("c"), F.max("old").alias("old")).select("v", F.least("c", "old").alias("p"), "old"))
        parents = step.select("v", "p")
        if step.filter("p <> old").isEmpty():
            return parents.select("v", F.col("p").alias("component"))
