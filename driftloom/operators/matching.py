"""Selectors matched against stored pages as joins, without reading the pages again.

``store_pages`` keeps a row per page, read as two tables: elements with their interval (``pos`` to
``last``, in document order) and parent, and pages with their text pieces. ``compiled`` turns selectors into a predicate
table, one row per step. ``match_selectors`` is then relational throughout: the rightmost step of
each wanted selector meets the elements of its page, every further step meets the elements that
contain what is found so far (for a child step the parent alone), and of each field the match with
the least position wins. Its text is cut from the page's pieces only then.

Elements meet steps by equal page, and by equal tag, id or class where the step names one, so a
page's elements are not tried against every selector of the page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import markup
from driftloom.operators.extraction import page_trees
from driftloom.operators.skew import shuffled
from driftloom.shipping import ship_package
from driftloom.storage import settle, work_folder

#: Steps of a selector, from the right: ``child`` says that the step's element is the parent of
#: the one before it. ``hook`` is what an element must have to be tried at all.
PREDICATE = (
    "selector string, alternative int, step int, steps int, child boolean, hook string, tag string, "
    "tests array<struct<op:string,name:string,value:string>>, rank int, type_rank int"
)


def _steps(selector: str) -> Iterator[tuple]:
    """Predicate rows of one selector; none if it uses syntax outside the grammar."""
    try:
        alternatives = markup.compile_selector(selector)
    except markup.BadSelector:
        return
    for number, steps in enumerate(alternatives):
        right = list(reversed(steps))
        for i, (_, tests) in enumerate(right):
            tag = next((name for kind, name, _ in tests if kind == "tag" and name != "*"), None)
            others = [{"op": k, "name": n, "value": v} for k, n, v in tests if k not in ("tag", "child", "of-type")]
            places = {k: max((n for kind, n, _ in tests if kind == k), default=None) for k in ("child", "of-type")}
            if any(kind in places and n != places[kind] for kind, n, _ in tests):
                break  # two places at once: nothing is there
            hook = next((f"#{t['value']}" for t in others if t["op"] == "=" and t["name"] == "id"), None)
            hook = hook or next((f".{t['value']}" for t in others if t["op"] == "~=" and t["name"] == "class"), None)
            child = i > 0 and right[i - 1][0] == ">"
            yield (selector, number, i, len(right), child, hook or tag or "*", tag, others, places["child"], places["of-type"])


def compiled(selectors: DataFrame) -> DataFrame:
    """The predicate table of the different values of ``selector``; stored."""
    ship_package(selectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PREDICATE.replace("op:string,name:string,value:string", "").split(", ")]
        test = pa.struct([("op", pa.string()), ("name", pa.string()), ("value", pa.string())])
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.list_(test), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [row for s in batch.column("selector").to_pylist() for row in _steps(s)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    wanted = selectors.select("selector").filter("selector IS NOT NULL AND selector <> ''").distinct()
    return settle(wanted.mapInArrow(run, PREDICATE))


def store_pages(pages: DataFrame, page: str, folder: str) -> None:
    """Write the elements and the text pieces of ``pages`` (a page id and html) below ``folder``, a row per page."""
    page_trees(pages.select(page, "html"), pieces=True).write.parquet(f"{folder}/trees")


def stored_pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Elements and text pieces that ``store_pages`` wrote."""
    trees = spark.read.parquet(f"{folder}/trees")
    page = [c for c in trees.columns if c not in ("nodes", "pieces")]
    return trees.select(*page, F.inline("nodes")).drop("text"), trees.select(*page, "pieces")


def _passes() -> Column:
    """Whether the element of a row passes the predicate of the row."""
    attrs = F.col("attrs")

    def holds(test: Column) -> Column:
        actual, op, value = F.try_element_at(attrs, test["name"]), test["op"], test["value"]
        part = value != ""
        return F.coalesce(
            F.when(op == "has", actual.isNotNull())
            .when(op == "=", actual == value)
            .when(op == "~=", F.array_contains(F.split(actual, r"\s+"), value))
            .when(op == "*=", part & F.contains(actual, value))
            .when(op == "^=", part & F.startswith(actual, value))
            .when(op == "$=", part & F.endswith(actual, value))
            .when(op == "|=", (actual == value) | F.startswith(actual, F.concat(value, F.lit("-")))),
            F.lit(False),
        )

    place = F.coalesce(F.col("wanted_rank") == F.col("rank"), F.lit(True)) & F.coalesce(F.col("wanted_type_rank") == F.col("type_rank"), F.lit(True))
    return F.coalesce(F.col("wanted_tag") == F.col("tag"), F.lit(True)) & place & F.forall("tests", holds)


def match_selectors(wanted: DataFrame, nodes: DataFrame, pieces: DataFrame, predicates: DataFrame, page: str) -> DataFrame:
    """page, field, text of the first match of every ``wanted`` (page, field, selector); NULL without one.

    Fields of one page may share a selector; a field that is wanted twice has the earliest match.
    """
    steps = predicates.withColumnsRenamed({"tag": "wanted_tag", "rank": "wanted_rank", "type_rank": "wanted_type_rank"})
    hooks = F.concat(
        F.array(F.lit("*"), F.col("tag")),
        F.when(F.col("id").isNotNull(), F.array(F.concat(F.lit("#"), "id"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.array_distinct("classes"), lambda c: F.concat(F.lit("."), c)),
    )
    # Elements that no step asks for stay where they are; the others are read out of the pages once.
    hooked = nodes.withColumn("hook", F.explode(hooks)).drop("id", "classes").join(steps.select("hook").distinct(), "hook", "left_semi")
    hooked = shuffled(settle(hooked))
    place = F.struct("pos", F.col("tag").alias("tag"), "first_piece", "end_piece")
    asked = wanted.filter("selector IS NOT NULL").select(page, "selector").distinct()
    own = ["selector", "alternative", "steps"]
    first = asked.join(steps.filter("step = 0"), "selector").join(hooked, [page, "hook"]).filter(_passes())
    found = first.select(page, *own, place.alias("match"), F.col("pos").alias("at"), F.col("parent").alias("up"))
    done = found.filter("steps = 1").select(page, "selector", "match")
    longest = predicates.agg(F.max("steps")).first()[0] or 1  # of the compiled selectors, a few
    for i in range(1, longest):
        # What is found so far meets the elements around it, and the next step's predicate.
        next_ = found.filter(F.col("steps") > i).join(steps.filter(F.col("step") == i).drop("steps"), ["selector", "alternative"])
        met = next_.join(hooked, [page, "hook"])
        around = F.when(F.col("child"), F.col("pos") == F.col("up")).otherwise((F.col("pos") < F.col("at")) & (F.col("at") <= F.col("last")))
        kept = met.filter(around & _passes())
        found = kept.select(page, *own, "match", F.col("pos").alias("at"), F.col("parent").alias("up")).distinct()
        done = done.unionAll(found.filter(F.col("steps") == i + 1).select(page, "selector", "match"))
    least = done.groupBy(page, "selector").agg(F.min("match").alias("match"))
    best = wanted.join(shuffled(least), [page, "selector"], "left").groupBy(page, "field").agg(F.min("match").alias("match"))
    places = best.select(page, "field", "match.*")
    # Pieces of scripts and styles belong to these elements alone.
    raw = F.when(F.col("tag").isin(*sorted(markup.RAW_TEXT)), F.col("tag"))
    within = F.slice("pieces", F.col("first_piece") + 1, F.col("end_piece") - F.col("first_piece"))
    texts = F.transform(F.filter(within, lambda p: p["kind"].eqNullSafe(raw)), lambda p: p["text"])
    text = F.when(F.col("pos").isNotNull() & (F.size(texts) > 0), F.array_join(texts, " "))
    return places.join(shuffled(pieces), page, "left").select(page, "field", text.alias("text"))


def selector_match(visits: DataFrame, page: str = "visit_id") -> DataFrame:
    """page, field, text for ``visits`` (page, html, selectors): stored as elements, then matched."""
    folder = work_folder(visits.sparkSession)
    store_pages(visits, page, folder)
    nodes, pieces = stored_pages(visits.sparkSession, folder)
    wanted = visits.select(page, F.explode("selectors").alias("field", "selector"))
    return match_selectors(wanted, nodes, pieces, compiled(wanted), page)
