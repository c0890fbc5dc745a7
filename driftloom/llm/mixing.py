"""Mixing to target weights: budgets go down a tree of domain, language and source.

The budget of a node is divided among its children by their weights. A child whose share exceeds
what its leaves can give in ``MAX_EPOCHS`` epochs gets just that, and the rest is divided among
its siblings; only what a whole family cannot give is left to the families beside it, since a
node never gets more than its leaves can give. All amounts are whole tokens (a division's
remainder, less than a token per child, is not spent).

A leaf repeats its documents for as many whole epochs as its budget has, and takes the rest as a
prefix of the next epoch, in which documents stand in the order of a seeded hash. The place of
the cut is found from totals per leaf and hash prefix, then inside one prefix; no leaf is sorted
whole, however large it is. What is broadcast has a row per leaf.

A token is a word: a run of bytes other than space, \\t, \\n, \\v, \\f, \\r. Null texts have none.
Null languages and sources are categories named by the empty text. Rows that repeat a doc_id in
a leaf have one place in the order and are taken or left together. Documents without tokens are
taken with the place they have. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.storage import settle

DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
#: Tokens to select, in hundredths of all there are.
PERCENT = 80
MAX_EPOCHS = 2
SEED = "mix-1"
_LEAF = ["domain", "language", "origin"]
_PREFIX_DIGITS = 4


def domain_of(source: Column) -> Column:
    """A fixed assignment of sources to four domains."""
    digit = F.substring(F.md5(source.cast("binary")), 1, 1)
    return F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")


def _order(doc_id: Column, epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with its leaf and its number of tokens, under names that clash with none."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("own"),
        F.col("doc_id").cast("long").alias("id"),
        domain_of(source).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"),
        source.alias("origin"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
    )


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.lit(1)).cast("long")


def _divided(nodes: DataFrame, by: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """``nodes`` (with capacity) and the budget each gets of ``whole``, its parent's."""
    family, filled = Window.partitionBy(*by), F.col("full")
    order = family.orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    weighted = nodes.withColumn("weight", _weight(F.col(name), weights))
    marked = weighted.withColumn("full", F.col("capacity") * after <= (F.col("whole") - before) * F.col("weight"))
    rest = F.col("whole") - F.coalesce(F.sum(F.when(filled, F.col("capacity"))).over(family), F.lit(0))
    shares = F.sum(F.when(~filled, F.col("weight"))).over(family)
    spent = marked.withColumn("rest", rest).withColumn("shares", shares)
    return spent.withColumn("budget", F.when(filled, F.col("capacity")).otherwise(F.expr("(weight * rest) div shares"))).drop("weight", "whole", "full", "rest", "shares")


def budgets(leaves: DataFrame, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, weights: tuple[dict[str, int], ...] = (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """domain, language, origin, supply, budget of every leaf (domain, language, origin, supply)."""
    level = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    families = level.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    domains = families.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    # All domains are siblings; what they can give is a multiple of what there is.
    all_ = F.sum("capacity").over(Window.partitionBy("root"))
    rooted = domains.withColumn("root", F.lit(0)).withColumn("all", all_)
    rooted = rooted.withColumn("whole", F.least(F.expr(f"`all` div {max_epochs} * {percent} div 100"), "all"))
    top = _divided(rooted, ["root"], "domain", weights[0]).select("domain", F.col("budget").alias("whole"))
    middle = _divided(families.join(top, "domain"), ["domain"], "language", weights[1])
    middle = middle.select("domain", "language", F.col("budget").alias("whole"))
    return _divided(level.join(middle, ["domain", "language"]), ["domain", "language"], "origin", weights[2]).drop("capacity")


def cuts(placed: DataFrame, seed: str = SEED, **limits) -> DataFrame:  # noqa: ANN003
    """Per leaf: budget, epochs, and where the prefix of the next epoch ends (order, tokens of the last)."""
    rows = settle(placed.select("id", *_LEAF, "tokens"))
    leaves = rows.groupBy(*_LEAF).agg(F.sum("tokens").alias("supply"))
    wanted = settle(budgets(leaves, **limits))
    # A leaf without any tokens has no epoch to repeat.
    plan = wanted.withColumn("epochs", F.coalesce(F.expr("try_divide(budget - budget % nullif(supply, 0), supply)").cast("long"), F.lit(0)))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    ordered = rows.join(F.broadcast(plan.select(*_LEAF, "epochs", "rest")), _LEAF)
    ordered = ordered.withColumn("order", _order(F.col("id"), F.col("epochs"), seed)).withColumn("prefix", F.substring("order", 1, _PREFIX_DIGITS))
    # At most 16**4 totals per leaf.
    totals = ordered.groupBy(*_LEAF, "prefix").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    running = F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("prefix"))
    at = totals.withColumn("base", running - F.col("n")).filter("base < rest AND base + n >= rest").select(*_LEAF, "prefix", "base")
    inside = ordered.join(at, [*_LEAF, "prefix"]).groupBy(*_LEAF, "order").agg(F.sum("tokens").alias("n"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("order"))
    last = inside.withColumn("upto", upto).filter("upto - n < rest AND upto >= rest")
    last = last.select(*_LEAF, F.col("order").alias("last"), (F.col("rest") - F.col("upto") + F.col("n")).alias("last_tokens"))
    return plan.select(*_LEAF, "budget", "epochs").join(last, _LEAF, "left")


def chosen(docs: DataFrame, seed: str = SEED, **limits) -> DataFrame:  # noqa: ANN003
    """own (the row), id, domain, language, origin, tokens, copies, last_tokens of every document."""
    placed = _placed(docs)
    met = placed.join(F.broadcast(settle(cuts(placed, seed, **limits))), _LEAF).withColumn("order", _order(F.col("id"), F.col("epochs"), seed))
    partial = F.coalesce(F.col("order") <= F.col("last"), F.lit(False))
    cut = F.when(F.col("order") == F.col("last"), F.least("last_tokens", "tokens")).otherwise(F.col("tokens"))
    return met.select("own", "id", *_LEAF, "tokens", (F.col("epochs") + partial.cast("long")).alias("copies"), F.when(partial, cut).otherwise(0).alias("last_tokens"))


def mix(docs: DataFrame, seed: str = SEED, **limits) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs``, each as often as it was chosen; the last one of a leaf stays whole."""
    return chosen(docs, seed, **limits).withColumn("turn", F.explode(F.expr("sequence(1L, nullif(copies, 0L))"))).select("own.*")


def plan_of(docs: DataFrame) -> DataFrame:
    """doc_id, domain, language, origin, n_tokens, copies, taken: what is selected of every document."""
    taken = F.col("tokens") * (F.col("copies") - (F.col("last_tokens") > 0).cast("long")) + F.col("last_tokens")
    return chosen(docs.select("doc_id", "text", "lang", "source")).select(F.col("id").alias("doc_id"), *_LEAF, F.col("tokens").alias("n_tokens"), "copies", taken.alias("taken"))
