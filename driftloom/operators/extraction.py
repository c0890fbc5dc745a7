"""Selectors applied to pages, the node table, content sections and selector induction.

The Arrow jobs here are narrow: they add columns to each row and drop the page text, so only
small columns travel on. Which selectors a page gets is decided by a join beforehand.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Event

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from driftloom.functions import markup, parsing, quality
from driftloom.functions.columns import values as _values
from driftloom.operators.skew import shuffled
from driftloom.params import MAX_SECTION_CHARS, MIN_SECTION_CHARS
from driftloom.shipping import ship_package
from driftloom.storage import read_or_empty, settle, work_folder

TEXT_MAP = T.MapType(T.StringType(), T.StringType())

NODE = (
    T.StructType()
    .add("pos", T.IntegerType())
    .add("parent", T.IntegerType())
    .add("last", T.IntegerType())
    .add("tag", T.StringType())
    .add("id", T.StringType())
    .add("classes", T.ArrayType(T.StringType()))
    .add("attrs", TEXT_MAP)
    .add("text", T.StringType())
    .add("rank", T.IntegerType())
    .add("type_rank", T.IntegerType())
    .add("first_piece", T.IntegerType())
    .add("end_piece", T.IntegerType())
)
PIECE = T.StructType().add("kind", T.StringType()).add("text", T.StringType())


#: Bytes of a batch that are Python objects at a time: they and the results take several times that.
SLICE_BYTES = 4 << 20


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``SLICE_BYTES``."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _per_slice(
    df: DataFrame,
    inputs: list[str],
    outputs: list[tuple[str, T.DataType]],
    function: Callable[..., Iterable[pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns computed from lists of the inputs' values; ``drop`` leaves input columns out."""
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in outputs])

    def run(batches):
        for batch in _slices(batches):
            added = function(*(_values(batch.column(name)) for name in inputs))
            same = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*same, *added], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def _per_row(
    df: DataFrame,
    inputs: list[str],
    outputs: list[tuple[str, T.DataType]],
    function: Callable[..., tuple],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns computed row by row inside Arrow batches; ``drop`` leaves input columns out."""

    def rows(*values: list) -> list[pa.Array]:
        results = [function(*row) for row in zip(*values)]
        columns = zip(*results) if results else ([] for _ in outputs)
        return [pa.array(c, type=to_arrow_type(t)) for c, (_, t) in zip(columns, outputs)]

    return _per_slice(df, inputs, outputs, rows, drop)


def apply_selectors(df: DataFrame, keep_html: bool = False) -> DataFrame:
    """Add ``raw`` (field -> text of the first match) from ``html`` and the map ``selectors``.

    A page or selector map that is missing gives an empty result.
    """

    def extract(html, selectors):
        if not html or not selectors:
            return ([],)
        return (list(markup.extract_fields(markup.read_page(html), dict(selectors)).items()),)

    return _per_row(
        df, ["html", "selectors"], [("raw", TEXT_MAP)], extract, () if keep_html else ("html",)
    )


def _nodes(trees: list[markup.Page], texts: bool) -> pa.Array:
    """The elements of each page, put together column by column."""
    pages, classes, attrs = [0], [0], [0]  # where those of a page or an element end
    own, names, values = [], [], []
    ids, text, rank, type_rank = [], [], [], []
    nodes = []
    for page in trees:
        nodes += page.nodes
        pages.append(len(nodes))
        of_parent: dict = {}
        of_type: dict = {}
        for i, n in enumerate(page.nodes):
            kin = n.parent, n.tag
            of_parent[n.parent] = place = of_parent.get(n.parent, 0) + 1
            rank.append(place)
            of_type[kin] = place = of_type.get(kin, 0) + 1
            type_rank.append(place)
            if n.attrs:
                names += n.attrs
                values += n.attrs.values()
                own += n.attrs.get("class", "").split()
            ids.append(n.attrs.get("id"))
            classes.append(len(own))
            attrs.append(len(names))
            if texts:
                text.append(page.text(i))
    whole, strings = pa.int32(), pa.string()
    columns = [
        pa.array([i for page in trees for i in range(len(page.nodes))], whole),
        pa.array([n.parent for n in nodes], whole),
        pa.array([n.last for n in nodes], whole),
        pa.array([n.tag for n in nodes], strings),
        pa.array(ids, strings),
        pa.ListArray.from_arrays(pa.array(classes, whole), pa.array(own, strings)),
        pa.MapArray.from_arrays(pa.array(attrs, whole), pa.array(names, strings), pa.array(values, strings)),
        pa.array(text, strings) if texts else pa.nulls(len(nodes), strings),
        pa.array(rank, whole),
        pa.array(type_rank, whole),
        pa.array([n.first_piece for n in nodes], whole),
        pa.array([n.end_piece for n in nodes], whole),
    ]
    found = pa.StructArray.from_arrays(columns, fields=list(to_arrow_type(NODE)))
    return pa.ListArray.from_arrays(pa.array(pages, whole), found)


def _pieces(trees: list[markup.Page]) -> pa.Array:
    """The text pieces of each page."""
    ends = [0]
    for page in trees:
        ends.append(ends[-1] + len(page.pieces))
    columns = [pa.array([p[i] for page in trees for p in page.pieces], pa.string()) for i in (0, 1)]
    found = pa.StructArray.from_arrays(columns, fields=list(to_arrow_type(PIECE)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def page_trees(df: DataFrame, pieces: bool = False) -> DataFrame:
    """Replace ``html`` by ``nodes``: the page's elements in document order.

    An element's text pieces are those from ``first_piece`` to before ``end_piece``; ``rank`` and
    ``type_rank`` are its places among its parent's children. With ``pieces`` the page's pieces are
    a column of their own, and elements carry no text: nested ones would repeat it.
    """

    def trees(texts: list) -> list[pa.Array]:
        read = [markup.read_page(html or "") for html in texts]
        return [_nodes(read, not pieces), _pieces(read)] if pieces else [_nodes(read, True)]

    more = [("pieces", T.ArrayType(PIECE))] if pieces else []
    return _per_slice(df, ["html"], [("nodes", T.ArrayType(NODE)), *more], trees, ("html",))


def page_nodes(df: DataFrame) -> DataFrame:
    """One row per element."""
    trees = page_trees(df)
    others = [c for c in trees.columns if c != "nodes"]
    return trees.select(*others, F.inline("nodes"))


def _nodes_of(pages: pa.Array) -> pa.Array:
    """The elements of a column of pages, with their texts."""
    batch = pa.RecordBatch.from_arrays([pages], names=["html"])
    parts = [_nodes([markup.read_page(html or "") for html in _values(part.column(0))], True) for part in _slices([batch])]
    return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(T.ArrayType(NODE)))


def register_page_nodes(spark: SparkSession, name: str = "page_nodes") -> None:
    """Let SQL read pages as elements: ``SELECT ... FROM visits, LATERAL page_nodes(visits.html)``.

    Pages become lists of elements by Arrow batches; a Python table function would pass element by element.
    """
    ship_package(spark)
    spark.udf.register(f"{name}_of_page", F.arrow_udf(_nodes_of, T.ArrayType(NODE)))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODE)
    body = f"SELECT * FROM inline({name}_of_page(html))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(html STRING) RETURNS TABLE ({columns}) RETURN {body}")


def content_sections(
    df: DataFrame, max_chars: int = MAX_SECTION_CHARS, min_chars: int = MIN_SECTION_CHARS
) -> DataFrame:
    """Replace ``html`` by the cleaned page, the chosen section's selector and its text."""

    def section(html):
        return markup.content_section(html or "", max_chars, min_chars)

    text = T.StringType()
    return _per_row(
        df,
        ["html"],
        [("cleaned", text), ("section_selector", text), ("section", text)],
        section,
        ("html",),
    )


def request_text(url: Column, section: Column) -> Column:
    """What an extractor is asked for one page."""
    return F.concat(F.lit("Page address: "), url, F.lit("\n\n"), section)


def run_extractor(
    queue: DataFrame, function: Callable[[str, str], tuple[dict, dict, int, int]]
) -> DataFrame:
    """Answers of a user's extractor for a work queue of ``url`` and ``html``.

    ``function(html, url)`` gives (fields, selectors, input tokens, output tokens). What it
    raises becomes an answer that is no JSON, so it is recorded as an error of that visit.
    Calls may be paid for, so the answers are stored before anything reads them.
    """
    return settle(_answers(queue, function))


def _answers(queue: DataFrame, function: Callable[[str, str], tuple[dict, dict, int, int]]) -> DataFrame:
    def answer(html, url):
        try:
            fields, selectors, given, made = function(html, url)
        except Exception as problem:  # noqa: BLE001 - one page must not end the job
            return f"extractor failed: {problem}", 0, 0
        return json.dumps({"extracted": fields, "selectors": selectors}), given, made

    count = T.LongType()
    outputs = [("raw_text", T.StringType()), ("input_tokens", count), ("output_tokens", count)]
    return _per_row(queue, ["html", "url"], outputs, answer, ("html",))


#: Groups of a resumable run that are called at a time.
GROUPS_AT_ONCE = 4


def _side_by_side(spark: SparkSession, job: Callable[[int], None], count: int) -> None:
    """``job`` for all numbers, some at a time, as one has few tasks and costs its start; none begins after one failed."""
    ended = Event()

    def run(number: int) -> None:
        if ended.is_set():
            return
        try:
            job(number)
        except BaseException:
            ended.set()
            raise

    with ThreadPoolExecutor(GROUPS_AT_ONCE) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), number) for number in range(count)]
        try:
            for each in jobs:
                each.result()
        finally:
            ended.set()


ANSWER = "visit_id long, content string, raw_text string, input_tokens long, output_tokens long"


def run_extractor_resumably(
    queue: DataFrame, function: Callable[[str, str], tuple[dict, dict, int, int]], folder: str, group_rows: int = 10_000
) -> DataFrame:
    """``run_extractor`` over a queue (visit_id, url, html) whose answers survive a run that ends early.

    Answers are kept in ``folder`` by visit and content. What is there already is taken off the
    queue before any call; the rest is called in groups of about ``group_rows`` pages, each stored
    when it is done. A run that is started again pays for the pages of the groups that were under
    way, ``GROUPS_AT_ONCE`` at most. A page whose text has changed since is called again.
    """
    spark = queue.sparkSession
    content = F.sha2(F.coalesce("html", F.lit("")), 256).alias("content")
    wanted = settle(queue.select("visit_id", content).distinct())
    known = read_or_empty(spark, f"{folder}/answers", ANSWER)
    left = settle(wanted.join(shuffled(known.select("visit_id", "content")), ["visit_id", "content"], "left_anti"))
    groups = -(-left.count() // group_rows)
    if groups:
        # Pages are dealt into their groups once; a group reads its own files only.
        pages = work_folder(spark)
        group = F.pmod(F.xxhash64("visit_id", "content"), F.lit(groups)).alias("group")
        asked = queue.select("visit_id", "url", "html", content).join(shuffled(left), ["visit_id", "content"], "left_semi").dropDuplicates(["visit_id", "content"])
        asked.select("*", group).repartition("group", F.pmod(F.xxhash64("visit_id"), F.lit(64))).write.partitionBy("group").parquet(pages)
        run = uuid.uuid4().hex

        def ask(number: int) -> None:
            # Only its own files are listed: all groups' would be read by the driver at each.
            dealt = read_or_empty(spark, f"{pages}/group={number}", "visit_id long, content string, url string, html string")
            answers = _answers(dealt, function)
            answers.select("visit_id", "content", "raw_text", "input_tokens", "output_tokens").write.parquet(f"{folder}/answers/run={run}-{number:06d}")

        _side_by_side(spark, ask, groups)
    known = read_or_empty(spark, f"{folder}/answers", ANSWER).dropDuplicates(["visit_id", "content"])
    return known.join(shuffled(wanted), ["visit_id", "content"], "left_semi").drop("content", "run")


# Rank of a candidate selector by how it starts: ids, then data attributes, then classes.
_PREFERENCE = (("#", 1), ("[", 2), (".", 3))


_CANDIDATE = T.ArrayType(T.StructType().add("text", T.StringType()).add("pos", T.IntegerType()).add("token", T.StringType()))


def _candidates(html: str | None, fields) -> tuple[list[dict]]:
    """Selectors of one part that match one element alone, of elements whose text is a wanted value.

    Lengths tell most elements apart, so few texts are put together.
    """
    page = markup.read_page(html or "")
    wanted = {v for v in dict(fields or ()).values() if v}
    sizes = {len(v) for v in wanted}
    ends = [0]
    for kind, text in page.pieces:
        ends.append(ends[-1] + (len(text) + 1 if kind is None else 0))
    tokens, found = [], []
    for i, node in enumerate(page.nodes):
        ident = node.attrs.get("id")
        own = [f"#{ident}"] if ident else []
        own += [f'[{name}="{value}"]' for name, value in node.attrs.items() if name.startswith("data-")]
        own += [f".{c}" for c in dict.fromkeys(node.attrs.get("class", "").split())]
        tokens.append(own)
        if own and (node.tag in markup.RAW_TEXT or ends[node.end_piece] - ends[node.first_piece] - 1 in sizes):
            text = page.text(i)
            if text in wanted:
                found.append((text, i))
    times = Counter(t for own in tokens for t in own)
    return ([{"text": text, "pos": i, "token": t} for text, i in found for t in tokens[i] if times[t] == 1],)


def induce_selectors(df: DataFrame) -> DataFrame:
    """Replace ``html`` by ``selectors``: for each known value in ``fields``, the best selector that finds it.

    A candidate must match exactly one element of the page; ids come before data attributes
    before classes, then the earliest element and the text decide. All within the row, and only
    candidates leave the task that reads the page.
    """
    listed = _per_row(df, ["html", "fields"], [("_found", _CANDIDATE)], _candidates, ("html",))

    def rank(token: Column) -> Column:
        value = F.lit(9)
        for start, number in _PREFERENCE:
            value = F.when(F.startswith(token, F.lit(start)), F.lit(number)).otherwise(value)
        return value

    def best(value: Column) -> Column:
        own = F.filter(F.col("_found"), lambda c: c["text"] == value)
        ranked = F.transform(own, lambda c: F.struct(rank(c["token"]).alias("rank"), c["pos"].alias("pos"), c["token"].alias("token")))
        return F.array_min(ranked)["token"]

    return listed.withColumn("selectors", F.transform_values("fields", lambda k, v: F.when(v.isNotNull(), best(v)))).drop("_found")


def typed_product(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the nine typed fields of the raw text map, with ``null_rate`` and ``confidence``.

    Columns ``price_number`` and ``in_stock_flag``, when there, are values that were already
    typed and pass through.
    """
    values = F.col(raw)
    typed = parsing.parse_product(lambda name: F.try_element_at(values, F.lit(name)))
    if "price_number" in df.columns:
        typed["price"] = F.coalesce(F.col("price_number"), typed["price"])
    if "in_stock_flag" in df.columns:
        typed["in_stock"] = F.coalesce(F.col("in_stock_flag"), typed["in_stock"])
    return df.withColumns(typed).withColumns(
        {"null_rate": quality.record_null_rate(), "confidence": quality.record_confidence()}
    )
