"""Input tables derived from the given ones by plain SQL.

The same text, with a few dialect words filled in, is also what the SQL checks run on, so
both sides see equal inputs. Numbers reach text only through integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A table below this size is one split at most.
ONE_SPLIT_BYTES = 128 << 20

# Rows of a task where each row becomes pages: bytes of the table do not tell the work.
FAN_OUT_ROWS = 5_000

# Dialect words: one row per value, 64-bit integer division, a timestamp some seconds after the
# epoch of the derived tables, microseconds since 1970.
SPARK_WORDS = {
    "each": lambda values: f"explode(array({', '.join(map(str, values))}))",
    "idiv": lambda a, b: f"(({a}) div ({b}))",
    "at": lambda secs: f"timestampadd(SECOND, CAST({secs} AS BIGINT), TIMESTAMP_NTZ '2024-03-01 00:00:00')",
    "micros": lambda ts: (
        f"(CAST(unix_date(to_date({ts})) * 1440L + hour({ts}) * 60 + minute({ts}) AS BIGINT) * 60000000 "
        f"+ CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT))"
    ),
}
ANSI_WORDS = {
    "each": lambda values: f"unnest([{', '.join(map(str, values))}])",
    "idiv": lambda a, b: f"(({a}) // ({b}))",
    "at": lambda secs: f"(TIMESTAMP '2024-03-01 00:00:00' + to_seconds(CAST({secs} AS BIGINT)))",
    "micros": lambda ts: f"epoch_us({ts})",
}


def _money(words) -> str:
    cents = "(90000 + p_partkey * 10)"
    return (
        f"concat(CAST({words['idiv'](cents, 100)} AS STRING), '.', "
        f"lpad(CAST({cents} % 100 AS STRING), 2, '0'))"
    )


def _stock() -> str:
    return (
        "CASE WHEN p_size % 7 = 0 THEN 'Sold out' WHEN p_size % 7 = 1 THEN 'Currently Unavailable' "
        "ELSE 'In Stock' END"
    )


def shop_visits_sql(words, visits: int) -> str:
    """``part`` x visits: two page designs, a slow growth, gaps in time, missing responses.

    ``p_partkey % 6`` picks the history: 0 redesign at visit 3; 1 no currency node and so no
    currency selector; 2 steady; 3 a gap longer than the lifetime after visit 4; 4 empty pages
    and missing, broken or fenced responses; 5 slow growth and a changed screenshot at visit 6.
    """
    parts = f"SELECT *, {words['each'](range(1, visits + 1))} AS visit FROM part "
    rows = f"""
      SELECT p_partkey AS part_key, CAST(v.visit AS INT) AS visit,
             p_partkey * 100 + v.visit AS visit_id, p_partkey % 6 AS story,
             concat(p_name, ' no ', CAST(p_partkey AS STRING)) AS title, p_brand AS brand,
             {_money(words)} AS price, {_stock()} AS stock,
             concat('4.', CAST(p_size % 10 AS STRING), ' out of 5') AS rating,
             CAST(p_size * 37 + 5 AS STRING) AS reviews,
             concat('SKU-', CAST(p_partkey AS STRING)) AS sku,
             concat('A ', p_name, ' of type ', p_type, '.') AS descr,
             CASE WHEN p_partkey % 6 = 0 AND v.visit >= 3 THEN 2 ELSE 1 END AS design,
             CASE WHEN p_partkey % 6 = 5 THEN v.visit ELSE 1 END AS growth
      FROM ({parts}) AS v
    """
    tips = "".join(
        f", CASE WHEN growth >= {k} THEN '<p class=\"tip t{k}\">Tip {k}</p>' ELSE '' END"
        for k in range(2, visits + 1)
    )
    page_one = f"""concat(
        '<html><head><title>', title, '</title></head><body><ul id="crumbs"><li><a href="/">Start</a></li></ul>',
        CASE WHEN story = 3 THEN '<svg id="mark"><svg><path id="in"/></svg><path id="out"/></svg>' ELSE '' END,
        '<section class="listing"><b id="pd-stock">', stock, '</b><label id="pd-sku">', sku, '</label>',
        CASE WHEN story = 1 THEN '' ELSE '<b id="pd-currency">$</b>' END,
        '<blockquote><div id="pd-price">$', price, '</div></blockquote></section>',
        '<p id="pd-text">', descr, '</p>'{tips},
        '<dl class="facts"><dt>Liked</dt><dd id="pd-reviews">(', reviews, ' reviews)</dd><dd id="pd-rating">', rating,
        '</dd><dt>Made by</dt><dd id="pd-brand">', brand, '</dd></dl>',
        '<h1 id="pd-title">', title, '</h1><!-- build 1 --></body></html>')"""
    page_two = """concat(
        '<html><head><title>', title, '</title><script>var p = "<div>";</script></head><body>',
        '<main class="offer"><h1 class="headline">', title, '</h1><em class="maker">', brand, '</em>',
        '<div class="scores"><i class="score">', rating, '</i><i class="tally">(', reviews, ' reviews)</i></div>',
        '<section class="buy"><span class="amount">$', price, '</span><span class="unit">USD</span>',
        '<span class="stock">', stock, '</span></section><small class="ref">', sku, '</small>',
        '<p class="lead">', descr, '</p></main></body></html>')"""
    return f"""
      SELECT part_key, visit, visit_id, story, design, title, brand, price, stock, rating, reviews, sku, descr,
             concat('https://shop', CAST(part_key % 20 AS STRING), '.example.com/item/', CAST(part_key AS STRING),
                    '?v=', CAST(visit AS STRING)) AS url,
             'product_v1' AS schema_name,
             {words['at']('part_key % 3600 + visit * 86400 + CASE WHEN story = 3 AND visit > 4 THEN 864000 ELSE 0 END')}
               AS crawled_at,
             CASE WHEN story = 4 AND visit = 3 THEN ''
                  WHEN story = 4 AND visit = 5 THEN NULL
                  WHEN design = 2 THEN {page_two} ELSE {page_one} END AS html,
             CASE WHEN story = 2 THEN NULL
                  WHEN story = 5 AND visit >= 6 THEN 'ffff00000000ffff' ELSE 'ffff0000ffff0000' END AS visual_hash
      FROM ({rows}) AS r
    """


def shop_responses_sql(words, visits: int) -> str:
    """Extractor responses for ``shop_visits``: JSON, some fenced, some broken, some missing."""
    one = {
        "title": "#pd-title",
        "price": "#pd-price",
        "currency": "#pd-currency",
        "in_stock": "#pd-stock",
        "rating": "#pd-rating",
        "review_count": "#pd-reviews",
        "sku": "#pd-sku",
        "brand": "#pd-brand",
        "description": "#pd-text",
    }
    two = {
        "title": ".headline",
        "price": ".amount",
        "currency": ".unit",
        "in_stock": ".stock",
        "rating": ".score",
        "review_count": ".tally",
        "sku": ".ref",
        "brand": ".maker",
        "description": ".lead",
    }

    def selectors(choice: dict, no_currency: bool) -> str:
        shown = (
            f'"{k}": null' if no_currency and k == "currency" else f'"{k}": "{v}"'
            for k, v in choice.items()
        )
        return "'{" + ", ".join(shown) + "}'"

    return f"""
      SELECT part_key, visit, visit_id,
             CASE WHEN story = 4 AND visit = 1 THEN concat('sorry, no product ', CAST(part_key AS STRING))
             ELSE concat(
               CASE WHEN visit % 3 = 0 THEN '```json ' ELSE '' END,
               '{{"extracted": {{"title": "', title, '", "price": "$', price, '", "currency": "$", "in_stock": "', stock,
               '", "rating": "', rating, '", "review_count": "', reviews, '", "sku": "', sku, '", "brand": "', brand,
               '", "description": "', descr, '", "colour": "red"}}, "selectors": ',
               CASE WHEN design = 2 THEN {selectors(two, False)}
                    WHEN story = 1 THEN {selectors(one, True)}
                    ELSE {selectors(one, False)} END,
               ', "confidence": 0.9}}',
               CASE WHEN visit % 3 = 0 THEN ' ```' ELSE '' END,
               CASE WHEN story = 4 AND visit = 4 THEN ' and more' ELSE '' END) END AS raw_text,
             500 + part_key % 100 AS input_tokens, CAST(100 + visit AS BIGINT) AS output_tokens
      FROM ({shop_visits_sql(words, visits)}) AS s
      WHERE NOT (story = 4 AND visit IN (2, 3, 5))
    """


def raw_fields_sql(words) -> str:
    """Dirty field texts of every part."""
    k = "CAST(p_partkey AS STRING)"
    money = _money(words)
    return f"""
      SELECT p_partkey AS part_key,
        CASE p_partkey % 9 WHEN 0 THEN concat('$', {money}) WHEN 1 THEN concat('  ', {money}, ' EUR ')
             WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN concat('$1.', {money}) WHEN 5 THEN 'call us'
             WHEN 6 THEN concat('-', {k}) WHEN 7 THEN concat('Only ', {k}, '.')
             ELSE concat('1,', lpad({k}, 3, '0'), '.50') END AS price,
        CASE p_partkey % 10 WHEN 0 THEN '$' WHEN 1 THEN ' € ' WHEN 2 THEN '£' WHEN 3 THEN '¥' WHEN 4 THEN '₹'
             WHEN 5 THEN 'usd' WHEN 6 THEN 'US Dollar' WHEN 7 THEN '' WHEN 8 THEN NULL
             ELSE concat('$', {k}) END AS currency,
        CASE p_partkey % 8 WHEN 0 THEN concat('4.', CAST(p_size % 10 AS STRING), ' out of 5') WHEN 1 THEN '4,7'
             WHEN 2 THEN concat('Top ', {k}, ': 4.5') WHEN 3 THEN NULL WHEN 4 THEN 'none' WHEN 5 THEN '-1.5'
             WHEN 6 THEN '5' ELSE concat(CAST(p_size % 9 AS STRING), '.5 stars') END AS rating,
        CASE p_partkey % 6 WHEN 0 THEN concat('(', {k}, ' reviews)') WHEN 1 THEN concat('1,', lpad({k}, 3, '0'))
             WHEN 2 THEN '1.2k' WHEN 3 THEN NULL WHEN 4 THEN 'no reviews'
             ELSE concat('99999999999999999999', {k}) END AS review_count,
        CASE p_size % 11 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'OUT OF STOCK' WHEN 2 THEN 'Currently unavailable'
             WHEN 3 THEN 'Sold Out today' WHEN 4 THEN 'Add to Cart' WHEN 5 THEN 'Buy now' WHEN 6 THEN 'not available'
             WHEN 7 THEN 'out-of-stock' WHEN 8 THEN NULL WHEN 9 THEN '' ELSE concat('ships in ', {k}) END AS in_stock,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('  ', p_name, ' é ', {k}, chr(9), chr(10)) END AS title,
        CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END AS brand,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(repeat(concat('S', {k}, '-'), 60), ' ') END AS sku,
        concat(chr(10), repeat(concat(p_name, '€ ', p_type, ' '), 50)) AS description
      FROM part
    """


def crawl_log_sql(words) -> str:
    """``events`` read as an audit log: one visit per event, one page per user."""
    cents = "CAST(round(value * 100) AS BIGINT)"
    return f"""
      SELECT event_id AS id, concat('https://site.example.com/u/', CAST(user_id AS STRING)) AS url,
             CAST(ts AS {words.get('ts_type', 'TIMESTAMP')}) AS crawled_at,
             CASE event_type WHEN 'click' THEN 'llm_extraction' WHEN 'error' THEN 'error'
                             WHEN 'signup' THEN 'no_extractor' ELSE 'cache_hit' END AS method,
             event_type IN ('view', 'purchase') AS cache_hit,
             event_type = 'click' AND {cents} % 3 = 0 AS drift_detected,
             CASE WHEN event_type = 'click' AND {cents} % 3 = 0
                  THEN CASE WHEN {cents} % 2 = 0 THEN 'major' ELSE 'moderate' END ELSE 'none' END AS drift_severity,
             CAST({cents} % 10 AS DOUBLE) / CAST(9 AS DOUBLE) AS null_rate,
             CASE WHEN event_type = 'click' THEN 600 + {cents} % 600 ELSE 0 END AS llm_tokens_used
      FROM events
    """


def cache_events_sql(words) -> str:
    """``events`` read as a log of registry operations per user key."""
    return f"""
      SELECT event_id, concat('product_v1:', CAST(user_id AS STRING)) AS key,
             {words['micros']('ts')} AS at_us,
             CASE WHEN event_type = 'signup' THEN 'set' WHEN event_type = 'error' THEN 'miss' ELSE 'hit' END AS op
      FROM events
    """


def registry_sql(words) -> str:
    """A registry with one entry per third part not divisible by five, some of them expired."""
    return f"""
      SELECT concat('product_v1:', left(md5(concat('shop', CAST(p_partkey % 20 AS STRING), '.example.com/item/',
                    CAST(p_partkey AS STRING))), 12)) AS key,
             concat('https://shop', CAST(p_partkey % 20 AS STRING), '.example.com/item/',
                    CAST(p_partkey AS STRING)) AS url_pattern,
             'product_v1' AS schema_name,
             {words['at']('p_partkey % 3600 - (p_partkey % 12) * 86400')} AS created_at,
             {words['at']('p_partkey % 3600 - (p_partkey % 12) * 86400 + 60')} AS last_validated_at,
             CAST(p_size * 3 AS BIGINT) AS hit_count, CAST(p_partkey % 7 AS BIGINT) AS miss_count,
             600 + p_partkey % 600 AS llm_tokens_spent, CAST(604800 AS BIGINT) AS ttl_seconds
      FROM part WHERE p_partkey % 5 <> 0
    """


def one_split_spread(df: DataFrame) -> DataFrame:
    """Deal a table that fits one split out to all cores; larger ones have splits of their own.

    By Spark's own size estimate; what is moved is never more than one split.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < ONE_SPLIT_BYTES else df


def fan_out_spread(df: DataFrame) -> DataFrame:
    """Deal small rows that become many pages out by their number: tasks stay as long on larger tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // FAN_OUT_ROWS)))


class DerivedTables:
    """The given tables of one folder and everything derived from them."""

    VISITS = 10

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def pages(self) -> DataFrame:
        """Crawled pages."""
        return one_split_spread(self.table("pages"))

    def _sql(self, text: str, *tables: str, fan_out: bool = False) -> DataFrame:
        # Named parameters keep the session's catalog untouched.
        frames = {name: self.table(name) for name in tables}
        if fan_out:
            # Small rows become whole pages, so they are spread before they grow.
            frames = {name: fan_out_spread(frame) for name, frame in frames.items()}
        for name in tables:
            text = text.replace(f"FROM {name}\n", f"FROM {{{name}}}\n").replace(
                f"FROM {name} ", f"FROM {{{name}}} "
            )
        return self.spark.sql(_escape(text, tables), **frames)

    def shop_visits(self, visits: int = VISITS) -> DataFrame:
        return self._sql(shop_visits_sql(SPARK_WORDS, visits), "part", fan_out=True)

    def shop_responses(self, visits: int = VISITS) -> DataFrame:
        return self._sql(shop_responses_sql(SPARK_WORDS, visits), "part", fan_out=True)

    def raw_fields(self) -> DataFrame:
        return self._sql(raw_fields_sql(SPARK_WORDS), "part", fan_out=True)

    def crawl_log(self) -> DataFrame:
        return self._sql(crawl_log_sql({**SPARK_WORDS, "ts_type": "TIMESTAMP_NTZ"}), "events")

    def cache_events(self) -> DataFrame:
        return self._sql(cache_events_sql(SPARK_WORDS), "events")

    def registry(self) -> DataFrame:
        return self._sql(registry_sql(SPARK_WORDS), "part")


def _escape(text: str, tables: tuple[str, ...]) -> str:
    """Double the braces of JSON text, leaving the table placeholders."""
    out = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        out = out.replace(f"{{{{{name}}}}}", f"{{{name}}}")
    return out
