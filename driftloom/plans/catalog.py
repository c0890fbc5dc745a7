"""Every query over one folder of given tables.

Each entry runs an operator over whole tables: the given ones, or tables Spark derives from
them (see ``sources.derived``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import dom, keys, parsing, quality, responses, similarity
from driftloom.operators import analytics, drift, extraction, matching, registry
from driftloom.operators.canary import canary
from driftloom.operators.replay import registry_after, replay
from driftloom.operators.skew import previous, shuffled, window_over_key
from driftloom.params import DEFAULT_SCHEMA_NAME, PRODUCT_FIELDS
from driftloom.session import stateful_session
from driftloom.sources import registry_log, snapshots, tables
from driftloom.sources.derived import SPARK_WORDS, DerivedTables
from driftloom.storage import settle, work_folder
from driftloom.streaming import replay_stream as streams
from driftloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Lifetime of stored selectors where most visits are to find some.
COVERING_TTL = 60 * 86_400

# Selector maps of the two page designs of the derived shop pages.
DESIGN_ONE = {
    "title": "#pd-title",
    "price": "div#pd-price",
    "currency": "#pd-currency",
    "in_stock": ".listing > #pd-stock",
    "rating": "[id='pd-rating']",
    "review_count": "body #pd-reviews",
    "sku": "#pd-sku",
    "brand": "#pd-brand",
    "description": "p[id*=text]",
}


def query(function: Callable[[DerivedTables], DataFrame]) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(DerivedTables(spark, folder))

    _QUERIES[function.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _text_map(values: dict) -> F.Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _keyed(visits: DataFrame) -> DataFrame:
    return visits.withColumn("key", keys.registry_key(F.col("url"), F.col("schema_name")))


def _at(seconds: int) -> F.Column:
    return F.expr(SPARK_WORDS["at"](seconds))


# ------------------------------------------------------------------ sources


@query
def scan_pages(t: DerivedTables) -> DataFrame:
    html = F.col("html")
    return t.table("pages").select("page_id", "url", F.length(html).alias("n_chars"), F.md5(html).alias("digest"))


@query
def page_rejects(t: DerivedTables) -> DataFrame:
    return snapshots.rejects(t.shop_visits()).select("visit_id", "url", "crawled_at", "method", "error")


@query
def registry_load(t: DerivedTables) -> DataFrame:
    entries = t.registry()
    line = F.to_json(F.struct(*entries.columns))
    broken = F.col("miss_count") == 3
    lines = entries.select(F.when(broken, F.left(line, F.lit(40))).otherwise(line).alias("value"))
    return tables.registry_from_lines(lines).select("key", "url_pattern", "created_at", "hit_count", "llm_tokens_spent")


@query
def response_ingest(t: DerivedTables) -> DataFrame:
    parsed = responses.parse_responses(t.shop_responses())
    return parsed.select(
        "visit_id", "ok", "confidence", "tokens", "error",
        F.size("extracted").alias("n_extracted"),
        F.size("selectors").alias("n_selectors"),
        F.try_element_at("extracted", F.lit("title")).alias("title"),
        F.try_element_at("selectors", F.lit("currency")).alias("currency_selector"),
    )


# ------------------------------------------------------------------ keys and fingerprints


@query
def cache_key(t: DerivedTables) -> DataFrame:
    url = F.col("url")
    return t.table("pages").select(
        "page_id",
        keys.host(url).alias("host"),
        keys.url_pattern(url).alias("pattern"),
        keys.registry_key(url, F.lit(DEFAULT_SCHEMA_NAME)).alias("key"),
    )


def _lines(pages: DataFrame) -> DataFrame:
    return pages.withColumn("lines", dom.skeleton_lines(F.col("html"))).drop("html")


@query
def dom_skeleton(t: DerivedTables) -> DataFrame:
    lines = F.col("lines")
    return _lines(t.pages()).select(
        "page_id", F.size(lines).alias("n_lines"), dom.skeleton_text(lines).alias("skeleton")
    )


@query
def dom_shingles(t: DerivedTables) -> DataFrame:
    sets = _lines(t.pages()).select("page_id", dom.shingles(F.col("lines")).alias("s"))
    return sets.select(
        "page_id",
        F.size("s").alias("n_shingles"),
        F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"),
    )


@query
def dom_fingerprint(t: DerivedTables) -> DataFrame:
    visits = t.shop_visits().select("visit_id", "html", "visual_hash")
    printed = drift.fingerprint(snapshots.usable(visits))
    return printed.select("visit_id", "structural_hash", F.size("shingles").alias("n_shingles"), "visual_hash")


@query
def visual_similarity(t: DerivedTables) -> DataFrame:
    pairs = t.shop_visits().select(
        "visit_id",
        "visual_hash",
        F.left(F.md5("url"), F.lit(16)).alias("left_hash"),
        F.left(F.md5("title"), F.lit(16)).alias("right_hash"),
    )
    return pairs.select(
        "visit_id",
        similarity.visual_similarity(F.col("left_hash"), F.col("right_hash")).alias("similarity"),
        similarity.visual_similarity(F.col("visual_hash"), F.lit("ffff0000ffff0000")).alias("to_fixed"),
        similarity.visual_similarity(F.col("visual_hash"), F.lit("not a hash")).alias("to_invalid"),
    )


# ------------------------------------------------------------------ drift


@query
def drift_vs_previous(t: DerivedTables) -> DataFrame:
    visits = snapshots.site_visits(t.pages())
    return drift.drift_vs_previous(visits, "host", ["page_id"]).select("page_id", "host", *drift.REPORT_COLUMNS)


@query
def drift_vs_first(t: DerivedTables) -> DataFrame:
    visits = snapshots.site_visits(t.pages())
    return drift.drift_vs_first(visits, "host", ["page_id"]).select("page_id", "host", *drift.REPORT_COLUMNS)


@query
def structural_similarity(t: DerivedTables) -> DataFrame:
    visits = snapshots.site_visits(t.pages())
    printed = drift.fingerprint(visits, text_shingles=True).select("page_id", "host", "shingles")
    pairs = window_over_key(printed, "host", ["page_id"], 1, {"before": previous("shingles")})
    pairs = pairs.filter(F.col("before").isNotNull())
    return pairs.select(
        "page_id",
        F.size(F.array_intersect("shingles", "before")).alias("shared"),
        F.size(F.array_union("shingles", "before")).alias("combined"),
        similarity.jaccard(F.col("shingles"), F.col("before")).alias("similarity"),
    )


@query
def drift_as_of(t: DerivedTables) -> DataFrame:
    """Every visit against the baseline accepted before it: some from its own visits, some from between them."""
    prints = settle(drift.fingerprint(_keyed(snapshots.usable(t.shop_visits())).select("visit_id", "visit", "key", "crawled_at", "html", "visual_hash")))
    half = F.col("crawled_at") + F.expr("INTERVAL 12 HOURS")
    accepted = F.when(F.col("visit") % 3 == 1, half).otherwise(F.col("crawled_at"))
    versions = prints.filter("visit % 3 <> 0").withColumn("accepted_at", accepted)
    return drift.drift_as_of(prints.drop("visit"), versions, "key").select("visit_id", "key", *drift.REPORT_COLUMNS)


@query
def drift_report(t: DerivedTables) -> DataFrame:
    visits = _keyed(snapshots.usable(t.shop_visits()))
    stored = visits.filter((F.col("visit") == 1) & (F.col("part_key") % 5 != 0))
    baselines = drift.fingerprint(stored.select("key", "html", "visual_hash"))
    report = drift.drift_vs_registry(visits.select("visit_id", "key", "html", "visual_hash"), baselines, "key")
    return report.select("visit_id", "key", *drift.REPORT_COLUMNS)


@query
def drift_diff(t: DerivedTables) -> DataFrame:
    return drift.drift_diff(snapshots.site_visits(t.pages()).drop("url"), "host", ["page_id"])


# ------------------------------------------------------------------ field parsers


@query
def parse_text(t: DerivedTables) -> DataFrame:
    return t.raw_fields().select(
        "part_key", *[parsing.parse_text(F.col(f), n).alias(f) for f, n in parsing.TEXT_CAPS.items()]
    )


def _parsed(t: DerivedTables, field: str, parser) -> DataFrame:
    return t.raw_fields().select("part_key", F.col(field).alias("raw"), parser(F.col(field)).alias("value"))


@query
def parse_price(t: DerivedTables) -> DataFrame:
    return _parsed(t, "price", parsing.parse_price)


@query
def parse_currency(t: DerivedTables) -> DataFrame:
    return _parsed(t, "currency", parsing.parse_currency)


@query
def parse_rating(t: DerivedTables) -> DataFrame:
    return _parsed(t, "rating", parsing.parse_rating)


@query
def parse_review_count(t: DerivedTables) -> DataFrame:
    return _parsed(t, "review_count", parsing.parse_review_count)


@query
def parse_in_stock(t: DerivedTables) -> DataFrame:
    return _parsed(t, "in_stock", parsing.parse_in_stock)


# ------------------------------------------------------------------ quality


@query
def record_quality(t: DerivedTables) -> DataFrame:
    raw = t.raw_fields()
    values = F.create_map(*[x for f in PRODUCT_FIELDS for x in (F.lit(f), F.col(f))])
    typed = extraction.typed_product(raw.select("part_key", values.alias("raw")))
    return typed.select("part_key", "null_rate", "confidence")


@query
def selector_coverage(t: DerivedTables) -> DataFrame:
    parsed = responses.parse_responses(t.shop_responses())
    return parsed.select("visit_id", quality.selector_coverage(F.col("selectors")).alias("coverage"))


@query
def known_fields(t: DerivedTables) -> DataFrame:
    parsed = responses.parse_responses(t.shop_responses())
    kept = quality.known_fields(F.col("extracted"))
    return parsed.select(
        "visit_id",
        F.size("extracted").alias("n_given"),
        F.size(kept).alias("n_known"),
        F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("fields"),
    )


# ------------------------------------------------------------------ extraction


def _covering(t: DerivedTables) -> DataFrame:
    """The derived registry with entries that outlive the visits: four fifths of them have selectors."""
    return t.registry().withColumns({"selectors": _text_map(DESIGN_ONE), "ttl_seconds": F.lit(COVERING_TTL).cast("bigint")})


def _extracted(t: DerivedTables) -> DataFrame:
    visits = snapshots.usable(t.shop_visits()).select("visit_id", "html")
    return extraction.apply_selectors(visits.withColumn("selectors", _text_map(DESIGN_ONE)))


@query
def selector_extract(t: DerivedTables) -> DataFrame:
    """Stored selectors of live entries, applied to every visit; without an entry all is NULL.

    Which selectors a visit has is decided on narrow columns.
    """
    visits = _keyed(snapshots.usable(t.shop_visits())).select("visit_id", "key", "crawled_at", "html")
    found = extraction.apply_selectors(registry.with_selectors(visits, _covering(t)))
    return found.select("visit_id", *[F.try_element_at("raw", F.lit(f)).alias(f) for f in PRODUCT_FIELDS])


@query
def selector_match(t: DerivedTables) -> DataFrame:
    """``selector_extract`` as joins over stored elements."""
    visits = _keyed(snapshots.usable(t.shop_visits())).select("visit_id", "key", "crawled_at", "html")
    found = matching.selector_match(registry.with_selectors(visits, _covering(t)).select("visit_id", "html", "selectors"))
    fields = found.groupBy("visit_id").agg(*[F.max(F.when(F.col("field") == f, F.col("text"))).alias(f) for f in PRODUCT_FIELDS])
    return visits.select("visit_id").join(shuffled(fields), "visit_id", "left")


# Selectors for the template the crawled pages share.
SITE_SELECTORS = {
    "title": "article > h1",
    "brand": "div.ad",
    "sku": "nav li:nth-child(2) a",
    "description": "footer",
    "price": ".price",
}


@query
def site_extract(t: DerivedTables) -> DataFrame:
    """Crawled pages under the selectors stored for their host."""
    visits = snapshots.site_visits(t.pages()).select("page_id", "host", "html")
    stored = snapshots.site_visits(t.table("pages")).select("host").distinct()
    stored = stored.withColumn("selectors", _text_map(SITE_SELECTORS))
    found = extraction.apply_selectors(visits.join(stored, "host"))
    fields = [F.try_element_at("raw", F.lit(f)).alias(f) for f in SITE_SELECTORS]
    return found.select("page_id", *fields)


@query
def selector_report(t: DerivedTables) -> DataFrame:
    report = _extracted(t).select("visit_id", F.explode(quality.validity_report(F.col("raw"))).alias("field", "r"))
    return report.select("visit_id", "field", F.col("r.valid").alias("valid"), F.col("r.value").alias("value"))


@query
def extract_null_rate(t: DerivedTables) -> DataFrame:
    return _extracted(t).select("visit_id", quality.result_null_rate(F.col("raw")).alias("null_rate"))


@query
def hit_miss(t: DerivedTables) -> DataFrame:
    missing = quality.null_count(F.col("raw"))
    return _extracted(t).select("visit_id", missing.alias("null_count"), (missing == 0).alias("hit"))


@query
def page_nodes(t: DerivedTables) -> DataFrame:
    """Every element of every page with all it is known by, through the table function."""
    extraction.register_page_nodes(t.spark, "driftloom_page_nodes")
    visits = snapshots.usable(t.shop_visits()).select("visit_id", "html")
    nodes = t.spark.sql("SELECT v.visit_id, n.* FROM {visits} AS v, LATERAL driftloom_page_nodes(v.html) AS n", visits=visits)
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return nodes.select("visit_id", "pos", "parent", "last", "tag", "id", F.array_join("classes", " ").alias("classes"), attrs.alias("attrs"), "text", "rank", "type_rank")


@query
def clean_html(t: DerivedTables) -> DataFrame:
    done = extraction.content_sections(t.pages())
    return done.select("page_id", F.length("cleaned").alias("n_chars"), F.md5("cleaned").alias("digest"))


@query
def content_section(t: DerivedTables) -> DataFrame:
    done = extraction.content_sections(t.pages())
    return done.select("page_id", "section_selector", F.length("section").alias("n_chars"), F.md5("section").alias("digest"))


@query
def extraction_requests(t: DerivedTables) -> DataFrame:
    """Request texts for the visits of pages no live registry entry covers."""
    visits = _keyed(snapshots.usable(t.shop_visits()))
    queue = registry.queued_pages(visits.select("visit_id", "key", "crawled_at"), visits.select("visit_id", "url", "html"), t.registry())
    done = extraction.content_sections(queue.select("visit_id", "url", "html"))
    request = extraction.request_text(F.col("url"), F.col("section"))
    return done.select("visit_id", F.length(request).alias("n_chars"), F.md5(request).alias("digest"))


def _page_heading(html: str, url: str) -> tuple[dict, dict, int, int]:
    """A stand-in extractor: the first heading of a page, and the length of what it read."""
    match = re.search(r"<h1[^>]*>([^<]*)</h1>", html)
    if match is None:
        raise ValueError(f"no heading at {url}")
    return {"title": match.group(1)}, {"title": "h1"}, len(html), 1


@query
def extractor_run(t: DerivedTables) -> DataFrame:
    """A user's extractor over the work queue, its answers ingested like any others."""
    visits = _keyed(snapshots.usable(t.shop_visits()))
    queue = registry.queued_pages(visits.select("visit_id", "key", "crawled_at"), visits.select("visit_id", "url", "html"), t.registry())
    parsed = responses.parse_responses(extraction.run_extractor(queue, _page_heading))
    return parsed.select("visit_id", "ok", F.try_element_at("extracted", F.lit("title")).alias("title"), "tokens")


@query
def extractor_resumed(t: DerivedTables) -> DataFrame:
    """The same in groups whose answers are kept, after a run that only saw a part of the queue."""
    visits = _keyed(snapshots.usable(t.shop_visits()))
    queue = registry.queued_pages(visits.select("visit_id", "key", "crawled_at"), visits.select("visit_id", "url", "html"), t.registry())
    folder = work_folder(t.spark)
    extraction.run_extractor_resumably(queue.filter("visit_id % 3 = 0"), _page_heading, folder)
    parsed = responses.parse_responses(extraction.run_extractor_resumably(queue, _page_heading, folder))
    return parsed.select("visit_id", "ok", F.try_element_at("extracted", F.lit("title")).alias("title"), "tokens")


@query
def selector_induction(t: DerivedTables) -> DataFrame:
    known = {"title": F.col("title"), "price": F.concat(F.lit("$"), F.col("price")), "in_stock": F.col("stock"),
             "rating": F.col("rating"), "sku": F.col("sku"), "brand": F.col("brand"),
             "description": F.col("descr"), "currency": F.lit("no such text")}
    fields = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)])
    visits = snapshots.usable(t.shop_visits()).select("visit_id", "html", fields.alias("fields"))
    found = extraction.induce_selectors(visits)
    return found.select("visit_id", *[F.try_element_at("selectors", F.lit(f)).alias(f) for f in known])


# ------------------------------------------------------------------ registry


def _visits_without_html(t: DerivedTables) -> DataFrame:
    return _keyed(t.shop_visits()).select("visit_id", "part_key", "visit", "key", "url", "schema_name", "crawled_at")


@query
def registry_lookup(t: DerivedTables) -> DataFrame:
    found = registry.lookup(_visits_without_html(t), t.registry())
    return found.select("visit_id", "key", "entry_created_at", "entry_hit_count", "expired", "live")


@query
def registry_covered(t: DerivedTables) -> DataFrame:
    return registry.covered(_visits_without_html(t), t.registry()).select("visit_id", "key")


@query
def extraction_queue(t: DerivedTables) -> DataFrame:
    return registry.extraction_queue(_visits_without_html(t), t.registry()).select("visit_id", "key")


@query
def registry_expired(t: DerivedTables) -> DataFrame:
    expired = registry.is_expired(F.col("created_at"), F.col("ttl_seconds"), _at(0))
    return t.registry().select("key", "created_at", expired.alias("expired"))


@query
def registry_upsert(t: DerivedTables) -> DataFrame:
    visits = _visits_without_html(t).filter(F.col("visit").isin(2, 3) & (F.col("part_key") % 4 == 0))
    entries = visits.select(
        "key", F.col("url").alias("url_pattern"), "schema_name", F.col("crawled_at").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_validated_at"), (F.col("visit") + 700).cast("bigint").alias("llm_tokens_spent"),
        F.lit(604800).cast("bigint").alias("ttl_seconds"),
    )
    return registry.upsert(t.registry(), entries)


def _dropped(t: DerivedTables) -> DataFrame:
    visits = _visits_without_html(t).filter((F.col("visit") == 1) & (F.col("part_key") % 3 == 0))
    return visits.select("key", F.lit("drift_major").alias("reason"))


@query
def registry_invalidate(t: DerivedTables) -> DataFrame:
    return registry.invalidate(t.registry(), _dropped(t)).select("key", "created_at", "hit_count")


@query
def registry_invalidation_log(t: DerivedTables) -> DataFrame:
    return registry.invalidation_log(t.registry(), _dropped(t))


@query
def registry_stats(t: DerivedTables) -> DataFrame:
    return registry.stats(t.registry(), _at(0)).withColumn("avg_null_rate", F.round("avg_null_rate", 9))


@query
def method_routing(t: DerivedTables) -> DataFrame:
    """Live entry and drift against its baseline and extractor response, visit by visit."""
    visits = _keyed(snapshots.usable(t.shop_visits()))
    stored = visits.filter((F.col("visit") == 1) & (F.col("part_key") % 5 != 0))
    baselines = drift.fingerprint(stored.select("key", "html", "visual_hash"))
    report = drift.drift_vs_registry(
        visits.select("visit_id", "key", "crawled_at", "html", "visual_hash"), baselines, "key"
    )
    found = registry.lookup(report, t.registry())
    answers = responses.parse_responses(t.shop_responses()).select("visit_id", "ok")
    joined = found.join(shuffled(answers), "visit_id", "left")
    method = registry.route(
        F.col("live"), F.col("live") & F.col("has_drift"), F.col("ok").isNotNull(), F.coalesce("ok", F.lit(False))
    )
    return joined.select("visit_id", method.alias("method"))


@query
def canary_fold(t: DerivedTables) -> DataFrame:
    return canary(t.cache_events())


# ------------------------------------------------------------------ replay


def _replay(t: DerivedTables, visits: int = DerivedTables.VISITS) -> DataFrame:
    return replay(t.shop_visits(visits), t.shop_responses(visits))


@query
def visit_replay(t: DerivedTables) -> DataFrame:
    return _replay(t).select(
        "visit_id", "method", "drift_detected", "drift_severity", "structural_similarity",
        "visual_similarity", "llm_tokens_used", "ended", "origin", "hit_count", "miss_count",
    )


@query
def four_run_demo(t: DerivedTables) -> DataFrame:
    visit = (F.col("visit_id") % 100).alias("visit")
    return (
        _replay(t, 4)
        .groupBy(visit, "method", "drift_severity")
        .agg(F.count(F.lit(1)).alias("products"), F.sum("llm_tokens_used").alias("tokens"))
    )


@query
def registry_after_replay(t: DerivedTables) -> DataFrame:
    outcomes = settle(_replay(t))
    visits = snapshots.usable(t.shop_visits()).select("visit_id", "html")
    left = registry_after(outcomes, drift.fingerprint(visits))
    return left.select(
        "key", "url_pattern", "schema_name", F.to_json("selectors").alias("selectors"), "structural_hash",
        F.size("structural_shingles").alias("n_shingles"), "visual_hash", "created_at", "last_validated_at",
        "hit_count", "miss_count", "llm_tokens_spent", "ttl_seconds",
    )


def _resumed(t: DerivedTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes of visits 1 to 5, the registry they leave, stored and read back, and the later outcomes."""
    visits, answers, folder = t.shop_visits(), t.shop_responses(), work_folder(t.spark)
    early, late = visits.filter("visit <= 5"), visits.filter("visit > 5")
    before = settle(replay(early, answers))
    prints = drift.fingerprint(snapshots.usable(early).select("visit_id", "html"))
    tables.write_registry(registry_after(before, prints), folder)
    stored = tables.read_registry(t.spark, folder)
    return before, stored, replay(late, answers, stored=stored)


@query
def replay_resumed(t: DerivedTables) -> DataFrame:
    """A history in two parts, the second from the stored registry: the same as in one."""
    before, _, after = _resumed(t)
    return before.unionByName(after).select(
        "visit_id", "method", "drift_detected", "drift_severity", "structural_similarity",
        "visual_similarity", "llm_tokens_used", "ended", "hit_count", "miss_count",
    )


@query
def registry_after_resume(t: DerivedTables) -> DataFrame:
    _, stored, after = _resumed(t)
    late = snapshots.usable(t.shop_visits().filter("visit > 5")).select("visit_id", "html")
    left = registry_after(settle(after), drift.fingerprint(late), stored=stored)
    return left.select(
        "key", "url_pattern", "schema_name", F.to_json("selectors").alias("selectors"), "structural_hash",
        F.size("structural_shingles").alias("n_shingles"), "visual_hash", "created_at", "last_validated_at",
        "hit_count", "miss_count", "llm_tokens_spent", "ttl_seconds",
    )


@query
def drift_vs_stored_registry(t: DerivedTables) -> DataFrame:
    """Every visit against the stored registry that the whole history leaves."""
    folder = work_folder(t.spark)
    outcomes = settle(_replay(t))
    prints = settle(drift.fingerprint(_keyed(snapshots.usable(t.shop_visits())).select("visit_id", "key", "html", "visual_hash")))
    tables.write_registry(registry_after(outcomes, prints), folder)
    stored = tables.read_registry(t.spark, folder)
    report = drift.drift_vs_registry(prints, registry.baselines(stored), "key")
    return report.select("visit_id", "has_drift", "drift_severity", "structural_similarity", "visual_similarity")


@query
def extractions(t: DerivedTables) -> DataFrame:
    rows = tables.records(_replay(t))
    return rows.select(*tables.EXTRACTIONS, F.left("structural_hash", F.lit(12)).alias("short_hash"))


@query
def results(t: DerivedTables) -> DataFrame:
    found = tables.results(tables.records(_replay(t)))
    product = F.to_json("product", {"ignoreNullFields": "false"})
    return found.select("id", "url", "crawled_at", "method", product.alias("product"), F.to_json("selectors").alias("selectors"), "short_hash")


@query
def audit_log(t: DerivedTables) -> DataFrame:
    return tables.audit_log(tables.records(_replay(t)))


@query
def replay_stream(t: DerivedTables) -> DataFrame:
    """The same history as a stream: three arrivals, one job resumed for each."""
    folder = work_folder(t.spark)
    visits, answers = t.shop_visits(), t.shop_responses()
    arrived = visits.select("visit_id", "visit", "url", "schema_name", "crawled_at", "html", "visual_hash")
    for low, high in ((1, 3), (4, 6), (7, t.VISITS)):
        arrived.filter(F.col("visit").between(low, high)).write.mode("append").parquet(f"{folder}/in")
        stream = snapshots.stream_snapshots(t.spark, f"{folder}/in", arrived.schema)
        streams.replay_stream(stream, answers, folder, f"{folder}/state").awaitTermination()
    return streams.read_table(t.spark, folder, "audit_log").select(*tables.AUDIT)


@query
def registry_change_log(t: DerivedTables) -> DataFrame:
    """The registry that a stream's change log adds up to, with a base made on the way."""
    folder = work_folder(t.spark)
    visits, answers = t.shop_visits(), t.shop_responses()
    arrived = visits.select("visit_id", "visit", "url", "schema_name", "crawled_at", "html", "visual_hash")
    for low, high in ((1, 2), (3, 5), (6, t.VISITS)):
        arrived.filter(F.col("visit").between(low, high)).write.mode("append").parquet(f"{folder}/in")
        stream = snapshots.stream_snapshots(t.spark, f"{folder}/in", arrived.schema)
        streams.replay_stream(stream, answers, folder, f"{folder}/state").awaitTermination()
        if low == 3:
            registry_log.compact(t.spark, folder, 1)
    left = streams.current_registry(t.spark, folder)
    return left.select(
        "key", "url_pattern", "schema_name", F.to_json("selectors").alias("selectors"), "structural_hash",
        F.size("structural_shingles").alias("n_shingles"), "visual_hash", "created_at", "last_validated_at",
        "hit_count", "miss_count", "llm_tokens_spent", "ttl_seconds",
    )


@query
def audit_sessions_stream(t: DerivedTables) -> DataFrame:
    folder = work_folder(t.spark)
    session = stateful_session(t.spark, t.table("events").rdd.getNumPartitions())
    log = DerivedTables(session, t.folder).crawl_log().select("url", "crawled_at", "drift_detected")
    log.write.parquet(f"{folder}/in")
    # A row long after all others closes what is open; its own session stays so.
    end = log.agg(F.max("crawled_at").alias("last")).select(F.lit("").alias("url"), (F.col("last") + F.expr("INTERVAL 30 DAYS")).alias("crawled_at"), F.lit(False).alias("drift_detected"))
    stream = session.readStream.schema(log.schema).parquet(f"{folder}/in")
    for more in (None, end):
        if more is not None:
            more.write.mode("append").parquet(f"{folder}/in")
        windows.write_sessions(windows.audit_sessions_stream(stream, "12 hours"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return windows.read_sessions(t.spark, f"{folder}/out")


@query
def audit_windows_stream(t: DerivedTables) -> DataFrame:
    folder = work_folder(t.spark)
    session = stateful_session(t.spark, t.table("events").rdd.getNumPartitions())
    log = DerivedTables(session, t.folder).crawl_log()
    log.write.parquet(f"{folder}/in")
    stream = session.readStream.schema(log.schema).parquet(f"{folder}/in")
    counts = windows.audit_windows_stream(stream, "1 day")

    windows.write_windows(counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return windows.read_windows(t.spark, f"{folder}/out")


@query
def scan_html_files(t: DerivedTables) -> DataFrame:
    """Pages as HTML files of a hundred pages each, read back as whole texts."""
    folder = work_folder(t.spark)
    bucket = F.floor(F.col("page_id") / 100).alias("bucket")
    pages = t.table("pages").select(bucket, "page_id", F.regexp_replace("html", "\\n", " ").alias("value"))
    dealt = pages.repartition("bucket").sortWithinPartitions("bucket", "page_id").select("bucket", "value")
    dealt.write.partitionBy("bucket").option("maxRecordsPerFile", 0).text(folder)
    files = snapshots.read_html_files(t.spark, f"{folder}/bucket=*")
    number = F.regexp_extract("url", r"bucket=(\d+)", 1).cast("bigint")
    return files.select(number.alias("bucket"), F.length("html").alias("n_chars"), F.md5("html").alias("digest"))


# ------------------------------------------------------------------ analytics


@query
def recent_extractions(t: DerivedTables) -> DataFrame:
    recent = analytics.recent_extractions(t.crawl_log(), limit=10)
    return recent.select("id", "url", "crawled_at", "method", "recency")


@query
def recent_for_url(t: DerivedTables) -> DataFrame:
    recent = analytics.recent_extractions(t.crawl_log(), "https://site.example.com/u/7")
    return recent.select("id", "url", "crawled_at", "method")


@query
def null_rate_history(t: DerivedTables) -> DataFrame:
    return analytics.null_rate_history(t.crawl_log())


@query
def null_rate_trend(t: DerivedTables) -> DataFrame:
    trend = analytics.null_rate_trend(t.crawl_log())
    return trend.withColumn("trend", F.round("trend", 9))


@query
def key_counters(t: DerivedTables) -> DataFrame:
    """Hits and misses of selector results, per registry key, over the cached visits of a replay."""
    used = _replay(t).filter(F.col("method") == "cache_hit").select("key", "raw", "selectors")
    results = F.from_json("raw", "map<string,string>")
    return analytics.key_counters(used.withColumn("results", results), "key", "results")


@query
def summary_stats(t: DerivedTables) -> DataFrame:
    log = t.crawl_log()
    return analytics.summary_stats(log.filter(F.col("method") != "error"), log)


@query
def crawl_stats(t: DerivedTables) -> DataFrame:
    log = t.crawl_log()
    counts = analytics.summary_stats(log.filter(F.col("method") != "error"), log)
    counts = counts.withColumn("cache_hit_rate", F.round("cache_hit_rate", 6))
    entries = registry.stats(t.registry(), _at(0)).withColumn("avg_null_rate", F.round("avg_null_rate", 6))
    return analytics.stats_document(entries, counts)


@query
def audit_rollup(t: DerivedTables) -> DataFrame:
    """Totals by host, day, method and severity, with subtotals up to the grand total."""
    log = t.crawl_log().withColumns({"host": keys.host(F.col("url")), "day": F.to_date("crawled_at").cast("string")})
    return analytics.audit_rollup(log, "host", "day", "method", "drift_severity")


@query
def audit_windows(t: DerivedTables) -> DataFrame:
    return analytics.audit_windows(t.crawl_log(), "1 day")


@query
def audit_windows_sliding(t: DerivedTables) -> DataFrame:
    return analytics.audit_windows(t.crawl_log(), "2 days", "1 day")


@query
def audit_sessions(t: DerivedTables) -> DataFrame:
    return analytics.audit_sessions(t.crawl_log(), "12 hours")
