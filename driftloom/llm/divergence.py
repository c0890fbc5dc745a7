"""Source divergence audit: how differently the sources of one language use its words.

Each language's documents are vectorised by a CountVectorizer of minimum document frequency 30 and
the largest vocabulary size there is, so nothing but rare terms is left out and counts are exact.
All languages share one fit: a term carries its language in front, so its document frequency and
its dimension are those of the term in that language. Sparse document vectors are summed by
language and source, entry by entry, so a group costs its own terms and not the whole vocabulary.

With ``V`` kept terms and ``N`` occurrences in a group, a term of count c has
p = 1 + floor(10**9 (c + 5) / (N + 5 V)) there. Two sources' distance is the sum over all kept
terms of the difference of their p. It is evaluated from the entries alone: where neither source
has a term both have their p of count zero, once per term; a term of one source adds what it
differs from that; and only a term that both have needs the two entries together. What one source's
terms add depends on their counts, so it is summed over its different counts, not its terms.

All arithmetic is on whole numbers. Null text, lang and source count as ''. Every occurring group
is compared, even one without terms; a language without kept terms has distances of zero and no
terms. Repeated rows count as often as they occur, doc_id is not read. An empty table gives no
rows. Other columns are ignored.

The vocabulary reaches the driver, which fits it: terms in ``min_df`` documents of a language.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.storage import settle

MIN_DF = 30
#: The largest there is: no term is left out for its rank.
VOCABULARY_SIZE = (1 << 31) - 1
SCALE = 1_000_000_000
PRIOR = 5
TOP = 50

#: What stands between terms, the ASCII characters that are no letters.
_BETWEEN = "".join(chr(c) for c in range(0x80) if not chr(c).isalpha())
#: Between language and term; no term holds it.
_MARK = "\x01"


def folded(text: Column) -> Column:
    """The text with A-Z as a-z and a space for whatever stands between terms."""
    return F.translate(text, ascii_uppercase + _BETWEEN, ascii_lowercase + " " * len(_BETWEEN))


def tagged(text: Column, tag: Column) -> Column:
    """The terms of a folded text, in order, with ``tag`` before each.

    Put there by one replacement and one split of the whole text: much cheaper than term by term.
    """
    spread = F.concat(tag, F.replace(text, F.lit(" "), F.concat(F.lit(" "), tag)))
    return F.array_remove(F.split(spread, " "), tag)


def _telling(values: DataFrame, column: str, code: Callable[[int], Column]) -> Column:
    """The first of the codes that no two values of ``column`` share."""
    n, attempt = values.select(column).distinct().count(), 0
    while values.select(code(attempt).alias("code")).distinct().count() < n:
        attempt += 1
    return code(attempt)


def counts(docs: DataFrame, min_df: int = MIN_DF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The groups (lang, source), the kept terms (at, lang, term), and lang, source, at, n; all stored."""
    spark = docs.sparkSession
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source"))
    # Two steps read the texts; folding them costs as much as all that follows.
    own = settle(docs.select(folded(text).alias("text"), lang.alias("lang"), source.alias("source")))
    pairs = own.select("lang", "source").distinct().withColumn("pair", F.to_json(F.struct("lang", "source")))
    groups = settle(pairs)
    # Short codes for languages in terms, and numbers for groups in sums, are cheaper than texts.
    code = _telling(groups, "lang", lambda i: F.left(F.md5(F.col("lang").cast("binary")), F.lit(i + 1)))
    group = _telling(groups, "pair", lambda i: F.xxhash64("lang", "source", F.lit(i)))
    found = own.select(group.alias("group"), tagged(F.col("text"), F.concat(code, F.lit(_MARK))).alias("terms"))
    # A model needs one term: that of these documents, which is in no other.
    extra = spark.range(min_df).select(F.lit(0).cast("long").alias("group"), F.array(F.lit("")).alias("terms"))
    fitting = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=VOCABULARY_SIZE)
    model = fitting.fit(found.unionAll(extra))
    terms = spark.createDataFrame(pa.table({"tagged": pa.array(model.vocabulary, pa.string()), "at": pa.array(range(len(model.vocabulary)), pa.int32())}))
    known = groups.select("lang", code.alias("code")).distinct()
    parts = terms.filter("tagged <> ''").select("at", F.substring_index("tagged", _MARK, 1).alias("code"), F.substring_index("tagged", _MARK, -1).alias("term"))
    kept = settle(parts.join(known, "code").select("at", "lang", "term"))
    entries = model.transform(found).select("group", F.unwrap_udt("vector").alias("v"))
    entries = entries.select("group", F.explode(F.arrays_zip("v.indices", "v.values")).alias("e"))
    sums = entries.groupBy("group", F.col("e.indices").alias("at")).agg(F.sum(F.col("e.values").cast("long")).alias("n"))
    named = sums.join(groups.withColumn("group", group), "group").select("lang", "source", "at", "n")
    return groups.drop("pair"), kept, settle(named)


def _p(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10**9 (n + 5) / (total + 5 size)), exactly."""
    wide = "decimal(38,0)"
    above = (F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")).cast(wide)
    return F.lit(1) + F.call_function("div", above, (total + PRIOR * size).cast(wide))


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    groups, kept, sums = counts(docs, min_df)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["size", "total"])
    zero = F.when(F.col("size") > 0, _p(F.lit(0), F.col("total"), F.col("size"))).otherwise(F.lit(0))
    known = settle(known.withColumn("zero", zero.cast("long")))
    p = _p(F.col("n"), F.col("total"), F.col("size"))
    entries = settle(sums.join(known, ["lang", "source"]).select("lang", "source", "at", p.cast("long").alias("p"), "zero"))
    return _pairs(known, entries).unionAll(_terms(kept, sums, entries, top))


def _pairs(known: DataFrame, entries: DataFrame) -> DataFrame:
    a = known.select("lang", "source", F.col("zero").alias("own"))
    b = known.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), "size")
    both = a.join(b, "lang").filter("source <> item")  # the rows of the result
    apart = F.abs(F.col("own") - F.col("other"))
    # What the terms of the one source add to the difference of two zeros, by their counts.
    levels = entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    added = F.sum(F.col("m") * (F.abs(F.col("p") - F.col("other")) - apart))
    single = both.join(levels, ["lang", "source"]).groupBy("lang", "source", "item").agg(added.alias("added"))
    there = single.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("added").alias("there"))
    # Terms that both have, once per two sources: |p - q| less what the sums above say of the term.
    x = entries.select("lang", "at", "source", "p", F.col("zero").alias("own"))
    y = entries.select("lang", "at", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("other"))
    share = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("other")) - F.abs(F.col("q") - F.col("own")) + apart
    shared = x.join(y, ["lang", "at"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(share).alias("shared"))
    shared = settle(shared)
    shared = shared.unionAll(shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "shared"))
    keys = ["lang", "source", "item"]
    value = F.col("size") * apart + sum(F.coalesce(c, F.lit(0)) for c in ("added", "there", "shared"))
    found = both.join(single, keys, "left").join(there, keys, "left").join(shared, keys, "left").select(*keys, value.cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))


def _terms(kept: DataFrame, sums: DataFrame, entries: DataFrame, top: int) -> DataFrame:
    whole = sums.groupBy("lang", "at").agg(F.sum("n").alias("n"))
    of_lang = whole.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    q = whole.join(of_lang, "lang").select("at", _p(F.col("n"), F.col("total"), F.col("size")).cast("long").alias("q"))
    more = entries.join(q, "at").filter("p > q").select("lang", "source", "at", (F.col("p") - F.col("q")).alias("value"))
    named = more.join(kept.select("at", F.col("term").alias("item")), "at")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    found = named.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return found.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
