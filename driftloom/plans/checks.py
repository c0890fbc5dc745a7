"""The queries of the catalog in DuckDB's SQL, for side-by-side comparison.

Apart from the derived inputs, which are inputs, nothing here shares text with the Spark side:
tokenising, extraction and the visit history are written a second time, in another way.
"""

from __future__ import annotations

from driftloom.sources import derived
from driftloom.sources.derived import ANSI_WORDS as WORDS

VISITS = derived.DerivedTables.VISITS
_EPOCH = WORDS["at"](0)

_PRODUCT = ("title", "price", "currency", "in_stock", "rating", "review_count", "sku", "brand", "description")
_ROLLED = ("host", "day", "method", "drift_severity")
_NOISE = ("script", "style", "noscript", "svg", "iframe")
_KEPT = ("aria-label", "class", "data-testid", "id", "name", "role", "type")


def shop(visits: int = VISITS) -> str:
    return derived.shop_visits_sql(WORDS, visits)


def _log() -> str:
    return derived.crawl_log_sql(WORDS)


def _pattern(url: str) -> str:
    bare = f"regexp_replace(regexp_replace({url}, '^[a-z]+://', ''), '[?#].*$', '')"
    return f"regexp_replace({bare}, '/+$', '')"


def _key(url: str) -> str:
    return f"concat('product_v1:', left(md5({_pattern(url)}), 12))"


def _host(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)"


def _lines(html: str) -> str:
    """Skeleton lines of a page as a list."""
    text = f"regexp_replace({html}, '(?is)<!--.*?-->', '', 'g')"
    # Drawings inside drawings go first: those without another tag's end or a further "sv" within.
    text = f"regexp_replace({text}, '(?is)<svg[^>]*>([^<]|<[^/s]|<s[^v])*</svg>', '', 'g')"
    for tag in _NOISE:
        text = f"regexp_replace({text}, '(?is)<{tag}[^>]*>.*?</{tag}[^>]*>', '', 'g')"
    tags = f"regexp_extract_all({text}, '<([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>', 0)"
    tags = f"list_filter({tags}, lambda t: lower(regexp_extract(t, '^<([a-zA-Z0-9:-]+)', 1)) NOT IN ('img', {', '.join(repr(n) for n in _NOISE)}))"
    parts = []
    for name in _KEPT:
        value = f"regexp_extract(t, '(?is)[ ]{name}=\"([^\"]*)\"', 1)"
        if name == "class":
            value = f"array_to_string(list_sort(string_split({value}, ' ')), '\", \"')"
            shown = f"'\"class\": [\"' || {value} || '\"]'"
        else:
            shown = f"'\"{name}\": \"' || {value} || '\"'"
        parts.append(f"CASE WHEN regexp_matches(t, '(?is)[ ]{name}=\"[^\"]') THEN {shown} END")
    line = (
        "lower(regexp_extract(t, '^<([a-zA-Z0-9:-]+)', 1)) || ':{' || concat_ws(', ', "
        + ", ".join(parts)
        + ") || '}'"
    )
    return f"list_transform({tags}, lambda t: {line})"


def _shingles(lines: str) -> str:
    return (
        f"CASE WHEN len({lines}) < 3 THEN list_distinct({lines}) ELSE list_distinct(list_transform("
        f"range(1, len({lines}) - 1), lambda i: array_to_string({lines}[i:i+2], chr(10)))) END"
    )


def _printed(source: str, columns: str) -> str:
    """``source`` with structural_hash and shingles instead of html."""
    return f"""
      SELECT {columns}, sha256(array_to_string(lines, chr(10))) AS structural_hash, {_shingles('lines')} AS shingles
      FROM (SELECT *, {_lines('html')} AS lines FROM ({source}) AS src) AS lined"""


def _jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0::DOUBLE ELSE {shared}::DOUBLE / {union}::DOUBLE END"


def _structural(h: str, s: str, bh: str, bs: str) -> str:
    return f"CASE WHEN {bh} = {h} THEN 1.0::DOUBLE WHEN len({bs}) > 0 THEN {_jaccard(s, bs)} ELSE 0.0::DOUBLE END"


def _visual(a: str, b: str) -> str:
    ok = f"regexp_full_match({a}, '[0-9a-fA-F]{{16}}') AND regexp_full_match({b}, '[0-9a-fA-F]{{16}}')"
    bits = f"bit_count(xor(TRY_CAST(('0x' || {a}) AS UBIGINT), TRY_CAST(('0x' || {b}) AS UBIGINT)))"
    # bit_count of 64 set bits overflows its one-byte result only past 127, so it is safe here.
    return f"CASE WHEN {ok} THEN 1.0::DOUBLE - {bits}::DOUBLE / 64.0::DOUBLE ELSE 1.0::DOUBLE END"


def _severity(drift: str, sim: str) -> str:
    return f"CASE WHEN NOT ({drift}) THEN 'none' WHEN {sim} < 0.5 THEN 'major' WHEN {sim} < 0.8 THEN 'moderate' ELSE 'minor' END"


def _report(compared: str, ids: str) -> str:
    """Report columns over (ids, structural_hash, shingles, visual_hash, b_hash, b_shingles, b_visual)."""
    scored = f"""
      SELECT *, CASE WHEN b_hash IS NULL THEN 1.0::DOUBLE
                ELSE {_structural('structural_hash', 'shingles', 'b_hash', 'b_shingles')} END AS ss,
             CASE WHEN b_hash IS NULL THEN 1.0::DOUBLE ELSE {_visual('visual_hash', 'b_visual')} END AS vs
      FROM ({compared}) AS c"""
    drift = "ss < 0.85 OR vs < 0.80"
    return f"""
      SELECT {ids}, structural_hash, visual_hash, b_hash AS previous_structural_hash, b_visual AS previous_visual_hash,
             ss AS structural_similarity, vs AS visual_similarity, ss < 0.85 AS structural_drift,
             vs < 0.80 AS visual_drift, {drift} AS has_drift, {_severity(drift, 'ss')} AS drift_severity
      FROM ({scored}) AS r"""


def _sites() -> str:
    source = f"SELECT page_id, url, html, {_host('url')} AS host, CAST(NULL AS VARCHAR) AS visual_hash FROM pages"
    return _printed(source, "page_id, host, visual_hash")


def _usable(visits: int = VISITS) -> str:
    return f"SELECT *, {_key('url')} AS key FROM ({shop(visits)}) AS sv WHERE html IS NOT NULL AND html <> ''"


def _keyed() -> str:
    return f"SELECT *, {_key('url')} AS key FROM ({shop()}) AS sv"


def _drift_report(extra: str = "") -> str:
    printed = _printed(_usable(), "visit_id, part_key, visit, key, visual_hash, crawled_at")
    compared = f"""
      WITH p AS MATERIALIZED ({printed}),
           b AS (SELECT * FROM p WHERE visit = 1 AND part_key % 5 <> 0)
      SELECT p.*, b.structural_hash AS b_hash, b.shingles AS b_shingles, b.visual_hash AS b_visual
      FROM p LEFT JOIN b USING (key)"""
    return _report(compared, "visit_id, key" + extra)


# ------------------------------------------------------------------ field parsers


def _strip(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, '^\\s+', ''), '\\s+$', '')"


def _price(v: str) -> str:
    return f"TRY_CAST(nullif(regexp_replace({v}, '[^0-9.]', '', 'g'), '') AS DOUBLE)"


def _currency(v: str) -> str:
    t = _strip(v)
    return (
        f"CASE {t} WHEN '' THEN NULL WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' "
        f"WHEN '¥' THEN 'JPY' WHEN '₹' THEN 'INR' ELSE left(upper({t}), 3) END"
    )


def _rating(v: str) -> str:
    n = f"TRY_CAST(nullif(regexp_extract({v}, '-?[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE)"
    return f"CASE WHEN {n} BETWEEN 0 AND 5 THEN {n} END"


def _count(v: str) -> str:
    return f"TRY_CAST(nullif(regexp_replace({v}, '[^0-9]', '', 'g'), '') AS BIGINT)"


def _in_stock(v: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({v}), 'out of stock|unavailable|sold out') THEN false "
        f"WHEN regexp_matches(lower({v}), 'in stock|available|add to cart|buy now') THEN true END"
    )


def _parser(field: str, sql: str) -> str:
    return f"SELECT part_key, {field} AS raw, {sql} AS value FROM ({derived.raw_fields_sql(WORDS)}) AS r"


# ------------------------------------------------------------------ extraction

_DESIGN_ONE_IDS = {
    "title": "pd-title",
    "price": "pd-price",
    "currency": "pd-currency",
    "in_stock": "pd-stock",
    "rating": "pd-rating",
    "review_count": "pd-reviews",
    "sku": "pd-sku",
    "brand": "pd-brand",
    "description": "pd-text",
}


def _entities(text: str) -> str:
    """Decoded text, with or without the closing semicolon as browsers do.

    ``&amp;`` comes last, or what it leaves would be decoded again.
    """
    decoded = text
    signs = {"copy": "©", "middot": "·", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "amp": "&"}
    for name, sign in signs.items():
        decoded = f"regexp_replace({decoded}, '&{name};?', '{sign}', 'g')"
    return f"nullif(trim({decoded}), '')"


def _by_id(ident: str) -> str:
    return f"nullif(regexp_extract(html, ' id=\"{ident}\">([^<]*)<', 1), '')"


def _extracted() -> str:
    fields = ", ".join(f"{_by_id(i)} AS {f}" for f, i in _DESIGN_ONE_IDS.items())
    return f"SELECT visit_id, key, crawled_at, {fields} FROM ({_usable()}) AS u"


def _missing() -> str:
    return " + ".join(f"({f} IS NULL)::INT" for f in _DESIGN_ONE_IDS)


def _page_nodes() -> str:
    """Elements by counting open tags: an element ends where as many are open as before it."""
    source = "replace(regexp_replace(html, '<!--.*?-->', '', 'g'), 'var p = \"<div>\";', 'RAW')"
    attribute = "[ ]([a-z-]+)=\"([^\"]*)\""
    return f"""
        WITH t AS MATERIALIZED (SELECT visit_id, unnest(k) AS t, unnest(range(1, len(k) + 1)) AS i
                   FROM (SELECT visit_id, regexp_extract_all({source}, '<[^>]*>|[^<]+', 0) AS k FROM ({_usable()}) AS u) AS s),
          o AS (SELECT *, sum(CASE WHEN t LIKE '</%' THEN -1 WHEN t LIKE '<%' AND t NOT LIKE '%/>' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY visit_id ORDER BY i) AS open FROM t),
          n AS MATERIALIZED (SELECT visit_id, i, t, CAST(open + (t LIKE '%/>')::INT AS INT) AS depth,
                  CAST(row_number() OVER (PARTITION BY visit_id ORDER BY i) - 1 AS INT) AS pos,
                  regexp_extract(t, '^<([a-z0-9]+)', 1) AS tag
                FROM o WHERE t LIKE '<%' AND t NOT LIKE '</%'),
          e AS (SELECT n.visit_id, n.i, CASE WHEN any_value(n.t) LIKE '%/>' THEN n.i ELSE min(o.i) END AS stop
                FROM n LEFT JOIN o ON o.visit_id = n.visit_id AND o.i > n.i AND o.t LIKE '</%' AND o.open = n.depth - 1 GROUP BY 1, 2),
          p AS (SELECT n.visit_id, n.i, max(b.pos) AS parent FROM n JOIN n AS b
                  ON b.visit_id = n.visit_id AND b.i < n.i AND b.depth = n.depth - 1 GROUP BY 1, 2),
          l AS (SELECT e.visit_id, e.i, max(b.pos) AS last FROM e JOIN n AS b ON b.visit_id = e.visit_id AND b.i >= e.i AND b.i <= e.stop GROUP BY 1, 2),
          x AS (SELECT e.visit_id, e.i, string_agg(trim(o.t), ' ' ORDER BY o.i) FILTER (o.t <> 'RAW') AS text,
                  count(*) FILTER (o.t = 'RAW') AS raw
                FROM e JOIN o ON o.visit_id = e.visit_id AND o.i > e.i AND o.i < e.stop AND o.t NOT LIKE '<%' AND trim(o.t) <> '' GROUP BY 1, 2)
        SELECT n.visit_id, n.pos, coalesce(p.parent, -1) AS parent, l.last, n.tag, nullif(regexp_extract(n.t, ' id="([^"]*)"', 1), '') AS id,
          regexp_extract(n.t, ' class="([^"]*)"', 1) AS classes,
          array_to_string(list_sort(list_transform(regexp_extract_all(n.t, '{attribute}', 0),
            lambda a: replace(substr(a, 2), '"', ''))), '|') AS attrs,
          CASE WHEN n.tag = 'script' THEN CASE WHEN x.raw > 0 THEN 'var p = "<div>";' END ELSE x.text END AS text,
          CAST(row_number() OVER (PARTITION BY n.visit_id, p.parent ORDER BY n.i) AS INT) AS rank,
          CAST(row_number() OVER (PARTITION BY n.visit_id, p.parent, n.tag ORDER BY n.i) AS INT) AS type_rank
        FROM n JOIN e USING (visit_id, i) LEFT JOIN p USING (visit_id, i) JOIN l USING (visit_id, i) LEFT JOIN x USING (visit_id, i)"""


def _cleaned() -> str:
    text = "regexp_replace(html, '(?is)<head>.*?</head>', '')"
    for _ in range(2):
        text = f"regexp_replace({text}, '(?is)<svg[^>]*>([^<]|<[^/s]|<s[^v])*</svg>', '', 'g')"
    for tag in ("script", "style"):
        text = f"regexp_replace({text}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    return text


def _section(cleaned: str, kind: str = "article") -> str:
    found = f"regexp_extract({cleaned}, '(?s)<{kind}.*?</{kind}>', 0)"
    chosen = f"CASE WHEN length({found}) > 500 THEN {found} ELSE {cleaned} END"
    return f"CASE WHEN length({chosen}) > 15000 THEN left({chosen}, 15000) || '... [truncated]' ELSE {chosen} END"


# ------------------------------------------------------------------ registry


def _registry() -> str:
    return derived.registry_sql(WORDS)


def _expired(now: str) -> str:
    return f"epoch_us({now}) - epoch_us(created_at) > ttl_seconds * 1000000"


def _live_keys_join() -> str:
    return f"""
      FROM ({_keyed()}) AS v LEFT JOIN ({_registry()}) AS g ON g.key = v.key"""


def _rate() -> str:
    return (
        "CASE WHEN hit_count + miss_count > 0 "
        "THEN miss_count::DOUBLE / (hit_count + miss_count)::DOUBLE ELSE 0.0::DOUBLE END"
    )


def _registry_stats(now: str) -> str:
    return f"""
      SELECT count(*) AS total_entries, CAST(sum(hit_count) AS BIGINT) AS total_hits,
             CAST(sum(miss_count) AS BIGINT) AS total_misses, CAST(sum(llm_tokens_spent) AS BIGINT) AS total_llm_tokens,
             count(*) FILTER (WHERE {_expired(now)}) AS expired, round(avg({_rate()}), 9) AS avg_null_rate
      FROM ({_registry()}) AS g"""


# ------------------------------------------------------------------ visit history


def _history(visits: int = VISITS) -> str:
    """CTEs ending in ``run``: the outcome of every visit, by recursion over the visit number."""
    facts = f"""
      SELECT s.*, r.raw_text IS NOT NULL AS answered, coalesce(json_valid({_unfenced('r.raw_text')}), false) AS ok,
             r.input_tokens + r.output_tokens AS tokens, {_unfenced('r.raw_text')} AS body,
             {WORDS['micros']('s.crawled_at')} AS at_us
      FROM ({shop(visits)}) AS s LEFT JOIN ({derived.shop_responses_sql(WORDS, visits)}) AS r USING (visit_id)"""
    printed = _printed(facts, "* EXCLUDE (html, lines), html IS NULL OR html = '' AS blank, html")
    drift = "e_ss < 0.85 OR e_vs < 0.80"

    # Selector sets: 1 design one, 3 design one without currency, 2 design two.
    def step(previous: str) -> str:
        """One visit after the state columns (origin, hits, misses) of the row before."""
        return f"""
      SELECT part_key, visit, visit_id,
        CASE WHEN blank THEN 'error' WHEN kept THEN 'cache_hit' WHEN NOT answered THEN 'no_extractor'
             WHEN ok THEN 'llm_extraction' ELSE 'error' END AS method,
        NOT blank AND had AND ({drift}) AS drift_detected,
        CASE WHEN blank OR NOT had THEN 'none' ELSE {_severity(drift, 'e_ss')} END AS drift_severity,
        CASE WHEN blank THEN NULL WHEN had THEN e_ss ELSE 1.0::DOUBLE END AS structural_similarity,
        CASE WHEN blank THEN NULL WHEN had THEN e_vs ELSE 1.0::DOUBLE END AS visual_similarity,
        CASE WHEN NOT blank AND NOT kept AND answered AND ok THEN tokens ELSE 0 END AS llm_tokens_used,
        CASE WHEN blank THEN NULL WHEN stale THEN 'ttl_expired'
             WHEN had AND ({drift}) THEN concat('drift_', {_severity(drift, 'e_ss')})
             WHEN kept AND n_misses > misses AND n_hits + n_misses >= 5
                  AND n_misses::DOUBLE / (n_hits + n_misses) > 0.25 THEN 'high_null_rate' END AS ended,
        CASE WHEN blank THEN NULL WHEN kept THEN origin WHEN answered AND ok THEN visit_id END AS shown_origin,
        CASE WHEN blank THEN NULL WHEN kept THEN n_hits WHEN answered AND ok THEN 0 END AS hit_count,
        CASE WHEN blank THEN NULL WHEN kept THEN n_misses WHEN answered AND ok THEN 0 END AS miss_count,
        CASE WHEN blank THEN origin
             WHEN kept AND n_misses > misses AND n_hits + n_misses >= 5
                  AND n_misses::DOUBLE / (n_hits + n_misses) > 0.25 THEN NULL
             WHEN kept THEN origin WHEN answered AND ok THEN visit_id END AS origin,
        CASE WHEN blank THEN hits WHEN kept THEN n_hits ELSE 0 END AS hits,
        CASE WHEN blank THEN misses WHEN kept THEN n_misses ELSE 0 END AS misses
      FROM (
        SELECT *, hits + (NOT lacking)::INT AS n_hits, misses + lacking::INT AS n_misses
        FROM (
          SELECT *, had AND NOT ({drift}) AS kept
          FROM (
            SELECT v.*, {previous},
                   o.visit_id IS NOT NULL AND v.at_us - o.at_us > 604800000000 AS stale,
                   o.visit_id IS NOT NULL AND v.at_us - o.at_us <= 604800000000 AS had,
                   {_structural('v.structural_hash', 'v.shingles', 'o.structural_hash', 'o.shingles')} AS e_ss,
                   {_visual('v.visual_hash', 'o.visual_hash')} AS e_vs,
                   o.design <> v.design OR o.story = 1 AS lacking
            FROM {{source}}
          ) AS a
        ) AS b
      ) AS c"""

    first = step("CAST(NULL AS BIGINT) AS origin, 0 AS hits, 0 AS misses").replace(
        "{source}", "facts AS v LEFT JOIN facts AS o ON false WHERE v.visit = 1"
    )
    later = step("w.origin, w.hits, w.misses").replace(
        "{source}",
        "run AS w JOIN facts AS v ON v.part_key = w.part_key AND v.visit = w.visit + 1 "
        "LEFT JOIN facts AS o ON o.visit_id = w.origin",
    )
    return f"WITH RECURSIVE facts AS MATERIALIZED ({printed}), run AS ({first} UNION ALL {later})"


def _unfenced(raw: str) -> str:
    return f"regexp_replace(regexp_replace(trim({raw}), '^```(json)?\\s*', ''), '\\s*```$', '')"


def _stored() -> str:
    """Typed records of the visits with a page, over ``run`` and ``facts``."""
    got = "r.method IN ('cache_hit', 'llm_extraction')"
    unit = (
        f"CASE WHEN {got} AND NOT (r.method = 'cache_hit' AND f.story = 1) THEN 'USD' END"
    )
    fields = f"""
      CASE WHEN {got} THEN f.title END AS title,
      CASE WHEN {got} THEN {_price("concat('$', f.price)")} END AS price, {unit} AS currency,
      CASE WHEN {got} THEN f.stock = 'In Stock' END AS in_stock,
      CASE WHEN {got} THEN TRY_CAST(left(f.rating, 3) AS DOUBLE) END AS rating,
      CASE WHEN {got} THEN CAST(f.reviews AS BIGINT) END AS review_count,
      CASE WHEN {got} THEN f.sku END AS sku, CASE WHEN {got} THEN f.brand END AS brand,
      CASE WHEN {got} THEN f.descr END AS description"""
    nulls = " + ".join(
        f"({c} IS NULL)::INT"
        for c in "title price currency in_stock rating review_count sku brand description".split()
    )
    present = " + ".join(f"({c} IS NOT NULL)::INT" for c in ("title", "price", "in_stock"))
    return f"""
      SELECT *, ({nulls})::DOUBLE / 9.0::DOUBLE AS null_rate, ({present})::DOUBLE / 3.0::DOUBLE AS confidence
      FROM (SELECT f.visit_id AS id, f.url, f.crawled_at, f.story, f.design, {fields}, r.method,
                   r.method = 'cache_hit' AS cache_hit, r.drift_detected, r.drift_severity, f.structural_hash,
                   f.visual_hash, r.llm_tokens_used, f.body, r.shown_origin
            FROM run AS r JOIN facts AS f USING (visit_id) WHERE NOT f.blank) AS x"""


def _selector_text(number: int) -> str:
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
    source = two if number == 2 else {f: f"#{i}" for f, i in _DESIGN_ONE_IDS.items()}
    shown = (
        f'"{f}":null' if number == 3 and f == "currency" else f'"{f}":"{source[f]}"'
        for f in sorted(source)
    )
    return "'{" + ",".join(shown) + "}'"


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL."""
    log, shop_all, sites = _log(), shop(), _sites()
    answers = f"""
      SELECT *, {_unfenced('raw_text')} AS body, json_valid({_unfenced('raw_text')}) AS ok
      FROM ({derived.shop_responses_sql(WORDS, VISITS)}) AS r"""
    raw = derived.raw_fields_sql(WORDS)
    pages_cleaned = f"SELECT *, {_cleaned()} AS cleaned FROM pages"
    new_entries = f"""
      SELECT key, url AS url_pattern, schema_name, crawled_at AS created_at, crawled_at AS last_validated_at, 0::BIGINT AS hit_count, 0::BIGINT AS miss_count,
             (visit + 700)::BIGINT AS llm_tokens_spent, 604800::BIGINT AS ttl_seconds
      FROM ({_keyed()}) AS v WHERE visit = 3 AND part_key % 4 = 0"""
    dropped = f"SELECT key FROM ({_keyed()}) AS v WHERE visit = 1 AND part_key % 3 = 0"
    totals = """count(*) FILTER (WHERE NOT cache_hit) AS llm_runs, count(*) FILTER (WHERE cache_hit) AS cache_hits,
             count(*) FILTER (WHERE drift_detected) AS drift_events,
             CAST(coalesce(sum(llm_tokens_used), 0) AS BIGINT) AS total_llm_tokens"""
    hit_rate = "count(*) FILTER (WHERE cache_hit)::DOUBLE / count(*)::DOUBLE AS cache_hit_rate"
    history = _history()
    cache_events = derived.cache_events_sql(WORDS)

    checks = {
        "scan_pages": "SELECT page_id, url, CAST(length(html) AS INT) AS n_chars, md5(html) AS digest FROM pages",
        "page_rejects": f"""SELECT visit_id, url, crawled_at, 'error' AS method, 'empty page' AS error
            FROM ({shop_all}) AS s WHERE html IS NULL OR html = ''""",
        "registry_load": f"""SELECT key, url_pattern, created_at, hit_count, llm_tokens_spent
            FROM ({_registry()}) AS g WHERE miss_count <> 3""",
        "response_ingest": f"""SELECT visit_id, ok, CASE WHEN ok THEN 0.9::DOUBLE END AS confidence,
              input_tokens + output_tokens AS tokens,
              CASE WHEN NOT ok THEN concat('invalid JSON response: ', left(body, 500)) END AS error,
              CASE WHEN ok THEN CAST(len(json_keys(body, '$.extracted')) AS INT) ELSE 0 END AS n_extracted,
              CASE WHEN ok THEN CAST(len(json_keys(body, '$.selectors')) AS INT) ELSE 0 END AS n_selectors,
              CASE WHEN ok THEN json_extract_string(body, '$.extracted.title') END AS title,
              CASE WHEN ok THEN json_extract_string(body, '$.selectors.currency') END AS currency_selector
            FROM ({answers}) AS a""",
        "cache_key": f"""SELECT page_id, {_host('url')} AS host, {_pattern('url')} AS pattern, {_key('url')} AS key
            FROM pages""",
        "dom_skeleton": f"""SELECT page_id, CAST(len(lines) AS INT) AS n_lines, array_to_string(lines, chr(10)) AS skeleton
            FROM (SELECT page_id, {_lines('html')} AS lines FROM pages) AS l""",
        "dom_shingles": f"""SELECT page_id, CAST(len(shingles) AS INT) AS n_shingles,
              md5(array_to_string(list_sort(shingles), '|')) AS digest FROM ({sites}) AS p""",
        "dom_fingerprint": f"""SELECT visit_id, structural_hash, CAST(len(shingles) AS INT) AS n_shingles, visual_hash
            FROM ({_printed(_usable(), 'visit_id, visual_hash')}) AS p""",
        "visual_similarity": f"""SELECT visit_id, {_visual('left(md5(url), 16)', 'left(md5(title), 16)')} AS similarity,
              {_visual('visual_hash', "'ffff0000ffff0000'")} AS to_fixed, 1.0::DOUBLE AS to_invalid
            FROM ({shop_all}) AS s""",
        "drift_vs_previous": _report(
            f"""SELECT *, lag(structural_hash) OVER w AS b_hash, lag(shingles) OVER w AS b_shingles,
                  CAST(NULL AS VARCHAR) AS b_visual FROM ({sites}) AS p WINDOW w AS (PARTITION BY host ORDER BY page_id)""",
            "page_id, host",
        ),
        "drift_vs_first": _report(
            f"""SELECT *, CAST(NULL AS VARCHAR) AS b_visual,
                  first_value(structural_hash) OVER w AS b_hash, first_value(shingles) OVER w AS b_shingles
                FROM ({sites}) AS p WINDOW w AS (PARTITION BY host ORDER BY page_id)""",
            "page_id, host",
        ),
        "structural_similarity": f"""
            SELECT page_id, CAST(len(list_intersect(shingles, b)) AS INT) AS shared,
              CAST(len(list_distinct(list_concat(shingles, b))) AS INT) AS combined, {_jaccard('shingles', 'b')} AS similarity
            FROM (SELECT page_id, shingles, lag(shingles) OVER (PARTITION BY host ORDER BY page_id) AS b FROM ({sites}) AS p)
            WHERE b IS NOT NULL""",
        "drift_report": _drift_report(),
        "drift_diff": f"""
            WITH p AS (SELECT *, lag(shingles) OVER (PARTITION BY host ORDER BY page_id) AS before FROM ({sites}) AS s)
            SELECT host, page_id, 'added' AS change, unnest(list_filter(shingles, lambda x: NOT list_contains(before, x))) AS piece
            FROM p WHERE before IS NOT NULL UNION ALL
            SELECT host, page_id, 'removed' AS change, unnest(list_filter(before, lambda x: NOT list_contains(shingles, x))) AS piece
            FROM p WHERE before IS NOT NULL""",
        "parse_text": f"""SELECT part_key, left({_strip('title')}, 500) AS title, left({_strip('brand')}, 200) AS brand,
              left({_strip('sku')}, 100) AS sku, left({_strip('description')}, 1000) AS description FROM ({raw}) AS r""",
        "parse_price": _parser("price", _price("price")),
        "parse_currency": _parser("currency", _currency("currency")),
        "parse_rating": _parser("rating", _rating("rating")),
        "parse_review_count": _parser("review_count", _count("review_count")),
        "parse_in_stock": _parser("in_stock", _in_stock("in_stock")),
        "record_quality": f"""
            SELECT part_key, ((title IS NULL)::INT + (p IS NULL)::INT + (c IS NULL)::INT + (s IS NULL)::INT + (r IS NULL)::INT
              + (n IS NULL)::INT + (sku IS NULL)::INT + (brand IS NULL)::INT + (description IS NULL)::INT)::DOUBLE / 9.0::DOUBLE
              AS null_rate,
              ((title IS NOT NULL)::INT + (p IS NOT NULL)::INT + (s IS NOT NULL)::INT)::DOUBLE / 3.0::DOUBLE AS confidence
            FROM (SELECT part_key, title, sku, brand, description, {_price('price')} AS p, {_currency('currency')} AS c,
                    {_in_stock('in_stock')} AS s, {_rating('rating')} AS r, {_count('review_count')} AS n FROM ({raw}) AS r0)""",
        "selector_coverage": f"""SELECT visit_id, CASE WHEN NOT ok THEN 0.0::DOUBLE
              WHEN json_extract_string(body, '$.selectors.currency') IS NULL THEN 8.0::DOUBLE / 9.0::DOUBLE
              ELSE 1.0::DOUBLE END AS coverage FROM ({answers}) AS a""",
        "known_fields": f"""SELECT visit_id, CASE WHEN ok THEN 10 ELSE 0 END AS n_given, CASE WHEN ok THEN 9 ELSE 0 END AS n_known,
              CASE WHEN ok THEN array_to_string(list_sort(list_filter(json_keys(body, '$.extracted'),
                lambda k: k <> 'colour')), ',') ELSE '' END AS fields FROM ({answers}) AS a""",
        "selector_extract": f"""SELECT e.visit_id, {', '.join(f"CASE WHEN NOT ({_expired('e.crawled_at')}) THEN {f} END AS {f}" for f in _DESIGN_ONE_IDS)}
            FROM ({_extracted()}) AS e LEFT JOIN (SELECT * REPLACE (5184000::BIGINT AS ttl_seconds) FROM ({_registry()}) AS r) AS g
              ON g.key = e.key""",
        "site_extract": f"""
            SELECT page_id, {_entities("regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)")} AS title,
              {_entities("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS brand,
              {_entities("regexp_extract(html, '<nav><ul><li>.*?</li><li><a[^>]*>([^<]*)</a>', 1)")} AS sku,
              {_entities("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")} AS description,
              CAST(NULL AS VARCHAR) AS price FROM pages""",
        "selector_report": " UNION ALL ".join(
            f"SELECT visit_id, '{f}' AS field, {f} IS NOT NULL AS valid, {f} AS value FROM e" for f in _DESIGN_ONE_IDS
        ).join((f"WITH e AS MATERIALIZED ({_extracted()}) ", "")),
        "extract_null_rate": f"SELECT visit_id, ({_missing()})::DOUBLE / 9.0::DOUBLE AS null_rate FROM ({_extracted()}) AS e",
        "hit_miss": f"SELECT visit_id, {_missing()} AS null_count, ({_missing()}) = 0 AS hit FROM ({_extracted()}) AS e",
        "page_nodes": _page_nodes(),
        "clean_html": f"SELECT page_id, CAST(length(cleaned) AS INT) AS n_chars, md5(cleaned) AS digest FROM ({pages_cleaned}) AS p",
        "content_section": f"""
            SELECT page_id, CASE WHEN length(regexp_extract(cleaned, '(?s)<article.*?</article>', 0)) > 500
                THEN 'article' END AS section_selector, CAST(length(section) AS INT) AS n_chars, md5(section) AS digest
            FROM (SELECT page_id, cleaned, {_section('cleaned')} AS section FROM ({pages_cleaned}) AS p) AS s""",
        "extraction_requests": f"""
            SELECT visit_id, CAST(length(request) AS INT) AS n_chars, md5(request) AS digest
            FROM (SELECT v.visit_id, concat('Page address: ', v.url, chr(10), chr(10), {_section(_cleaned(), 'main')}) AS request
                  FROM ({_usable()}) AS v LEFT JOIN ({_registry()}) AS g
                    ON g.key = v.key AND NOT ({_expired('v.crawled_at')})
                  WHERE g.key IS NULL) AS q""",
        "extractor_run": f"""
            SELECT v.visit_id, true AS ok, v.title, length(v.html) + 1 AS tokens
            FROM ({_usable()}) AS v LEFT JOIN ({_registry()}) AS g ON g.key = v.key AND NOT ({_expired('v.crawled_at')})
            WHERE g.key IS NULL""",
        "selector_induction": f"""
            SELECT visit_id, {', '.join(
                f"CASE design WHEN 1 THEN '#{i}' ELSE {two!r} END AS {f}" for f, i, two in (
                    ('title', 'pd-title', '.headline'), ('price', 'pd-price', '.amount'), ('in_stock', 'pd-stock', '.stock'),
                    ('rating', 'pd-rating', '.score'), ('sku', 'pd-sku', '.ref'), ('brand', 'pd-brand', '.maker'),
                    ('description', 'pd-text', '.lead')))}, CAST(NULL AS VARCHAR) AS currency
            FROM ({_usable()}) AS u""",
        "registry_lookup": f"""SELECT v.visit_id, v.key, g.created_at AS entry_created_at, g.hit_count AS entry_hit_count,
              coalesce({_expired('v.crawled_at')}, false) AS expired, coalesce(NOT ({_expired('v.crawled_at')}), false) AS live
            {_live_keys_join()}""",
        "registry_covered": f"""SELECT v.visit_id, v.key {_live_keys_join()} WHERE NOT ({_expired('v.crawled_at')})""",
        "extraction_queue": f"""SELECT v.visit_id, v.key {_live_keys_join()}
            WHERE NOT coalesce(NOT ({_expired('v.crawled_at')}), false)""",
        "registry_expired": f"SELECT key, created_at, {_expired(_EPOCH)} AS expired FROM ({_registry()}) AS g",
        "registry_upsert": f"""
            WITH n AS ({new_entries}) SELECT * FROM n UNION ALL
            SELECT key, url_pattern, schema_name, created_at, last_validated_at, hit_count, miss_count, llm_tokens_spent, ttl_seconds
            FROM ({_registry()}) AS g WHERE key NOT IN (SELECT key FROM n)""",
        "registry_invalidate": f"""SELECT key, created_at, hit_count FROM ({_registry()}) AS g
            WHERE key NOT IN ({dropped})""",
        "registry_invalidation_log": f"""SELECT key, 'drift_major' AS reason FROM ({_registry()}) AS g
            WHERE key IN ({dropped})""",
        "registry_stats": _registry_stats(_EPOCH),
        "method_routing": f"""
            WITH d AS ({_drift_report(', crawled_at')}),
              j AS (SELECT d.visit_id, d.has_drift, coalesce(NOT ({_expired('d.crawled_at')}), false) AS live, a.ok
                    FROM d LEFT JOIN ({_registry()}) AS g ON g.key = d.key LEFT JOIN ({answers}) AS a ON a.visit_id = d.visit_id)
            SELECT visit_id, CASE WHEN live AND NOT has_drift THEN 'cache_hit' WHEN ok THEN 'llm_extraction'
              WHEN ok IS NOT NULL THEN 'error' ELSE 'no_extractor' END AS method FROM j""",
        "canary_fold": f"""
            WITH RECURSIVE e AS MATERIALIZED (
                SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_us, event_id) AS n FROM ({cache_events}) AS c),
              run AS (
                SELECT event_id, key, op, n, CASE WHEN op = 'set' THEN 0 END AS h, CASE WHEN op = 'set' THEN 0 END AS m,
                  false AS retired FROM e WHERE n = 1
                UNION ALL
                SELECT event_id, key, op, n, h, m,
                  coalesce(op = 'miss' AND h + m >= 5 AND m::DOUBLE / (h + m) > 0.25, false) AS retired
                FROM (SELECT e.event_id, e.key, e.op, e.n,
                        CASE WHEN e.op = 'set' THEN 0 WHEN run.retired THEN NULL ELSE run.h + (e.op = 'hit')::INT END AS h,
                        CASE WHEN e.op = 'set' THEN 0 WHEN run.retired THEN NULL ELSE run.m + (e.op = 'miss')::INT END AS m
                      FROM run JOIN e ON e.key = run.key AND e.n = run.n + 1) AS x)
            SELECT event_id, key, op, h::BIGINT AS hit_count, m::BIGINT AS miss_count, retired FROM run""",
        "visit_replay": f"""{history}
            SELECT visit_id, method, drift_detected, drift_severity, structural_similarity, visual_similarity,
              llm_tokens_used::BIGINT AS llm_tokens_used, ended, shown_origin AS origin, hit_count::BIGINT AS hit_count,
              miss_count::BIGINT AS miss_count FROM run""",
        "four_run_demo": f"""{_history(4)}
            SELECT visit::BIGINT AS visit, method, drift_severity, count(*) AS products,
              CAST(sum(llm_tokens_used) AS BIGINT) AS tokens FROM run GROUP BY 1, 2, 3""",
        "extractions": f"""{history}
            SELECT id, url, crawled_at, title, price, currency, in_stock, rating, review_count, sku, brand, description,
              confidence, method, cache_hit, drift_detected, left(structural_hash, 12) AS short_hash FROM ({_stored()}) AS s""",
        "results": f"""{history}
            SELECT id, url, crawled_at, method, to_json({{{', '.join(f"'{f}': {f}" for f in _PRODUCT)}}})::VARCHAR AS product,
              CASE WHEN method NOT IN ('cache_hit', 'llm_extraction') THEN NULL WHEN design = 2 THEN {_selector_text(2)}
                   WHEN story = 1 THEN {_selector_text(3)} ELSE {_selector_text(1)} END AS selectors,
              left(structural_hash, 12) AS short_hash FROM ({_stored()}) AS s""",
        "audit_log": f"""{history}
            SELECT id, url, crawled_at, method, cache_hit, drift_detected, drift_severity, structural_hash, visual_hash,
              null_rate, confidence, llm_tokens_used::BIGINT AS llm_tokens_used,
              CASE WHEN method NOT IN ('cache_hit', 'llm_extraction') THEN NULL WHEN design = 2 THEN {_selector_text(2)}
                   WHEN story = 1 THEN {_selector_text(3)} ELSE {_selector_text(1)} END AS selectors_used,
              CASE WHEN method = 'error' THEN concat('invalid JSON response: ', left(body, 500)) END AS error
            FROM ({_stored()}) AS s""",
        "registry_after_replay": f"""{history},
            last AS (SELECT * FROM run JOIN facts USING (visit_id) WHERE NOT blank
                     QUALIFY row_number() OVER (PARTITION BY run.part_key ORDER BY run.visit DESC) = 1),
            kept AS (SELECT shown_origin, hit_count, miss_count FROM last
                     WHERE shown_origin IS NOT NULL AND ended IS DISTINCT FROM 'high_null_rate')
            SELECT {_key('f.url')} AS key, f.url AS url_pattern, 'product_v1' AS schema_name,
              CASE WHEN f.design = 2 THEN {_selector_text(2)} WHEN f.story = 1 THEN {_selector_text(3)}
                   ELSE {_selector_text(1)} END AS selectors,
              f.structural_hash, CAST(len(f.shingles) AS INT) AS n_shingles, f.visual_hash, f.crawled_at AS created_at,
              f.crawled_at AS last_validated_at, kept.hit_count::BIGINT AS hit_count, kept.miss_count::BIGINT AS miss_count,
              f.tokens AS llm_tokens_spent, 604800::BIGINT AS ttl_seconds
            FROM kept JOIN facts AS f ON f.visit_id = kept.shown_origin""",
        "recent_extractions": f"""SELECT id, url, crawled_at, method, CAST(rn AS INT) AS recency
            FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, id DESC) AS rn FROM ({log}) AS l)
            WHERE rn <= 10""",
        "recent_for_url": f"""SELECT id, url, crawled_at, method FROM ({log}) AS l
            WHERE url = 'https://site.example.com/u/7' ORDER BY crawled_at DESC, id DESC LIMIT 10""",
        "null_rate_history": f"""SELECT url, crawled_at, id, null_rate, method, drift_detected FROM ({log}) AS l
            ORDER BY url, crawled_at, id""",
        "null_rate_trend": f"""SELECT id, url, crawled_at, null_rate, round(avg(null_rate) OVER (
              PARTITION BY url ORDER BY crawled_at, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS trend
            FROM ({log}) AS l""",
        # Only products without a currency node have a selector without a result.
        "key_counters": f"""{history}
            SELECT {_key('f.url')} AS key, count(*) FILTER (WHERE f.story <> 1) AS hit_count,
              count(*) FILTER (WHERE f.story = 1) AS miss_count
            FROM run JOIN facts AS f USING (visit_id) WHERE method = 'cache_hit' GROUP BY 1""",
        "summary_stats": f"""SELECT {totals}, {hit_rate}, count(*) FILTER (WHERE method <> 'error') AS total_extractions
            FROM ({log}) AS l""",
        "crawl_stats": f"""
            WITH g AS ({_registry_stats(_EPOCH)}), a AS (SELECT {totals}, round({hit_rate.removesuffix(' AS cache_hit_rate')}, 6) AS cache_hit_rate,
                count(*) FILTER (WHERE method <> 'error') AS total_extractions FROM ({log}) AS l)
            SELECT concat('{{"cache":{{"total_entries":', g.total_entries, ',"total_hits":', g.total_hits, ',"total_misses":',
              g.total_misses, ',"total_llm_tokens":', g.total_llm_tokens, ',"expired":', g.expired,
              ',"avg_null_rate":', round(g.avg_null_rate, 6),
              '}},"db":{{"llm_runs":', a.llm_runs, ',"cache_hits":', a.cache_hits, ',"drift_events":', a.drift_events,
              ',"total_llm_tokens":', a.total_llm_tokens, ',"cache_hit_rate":', a.cache_hit_rate, ',"total_extractions":', a.total_extractions, '}}}}') AS stats
            FROM g, a""",
        "audit_rollup": "UNION ALL ".join(
            f"""SELECT {', '.join(c if i < n else f"NULL AS {c}" for i, c in enumerate(_ROLLED))}, {n} AS level, {totals}, {hit_rate}
                FROM (SELECT *, {_host('url')} AS host, CAST(CAST(crawled_at AS DATE) AS VARCHAR) AS day FROM ({log}) AS o) AS l
                {'GROUP BY ' + ', '.join(_ROLLED[:n]) if n else ''} """ for n in range(len(_ROLLED) + 1)),
        "audit_windows_sliding": f"""SELECT date_trunc('day', crawled_at)::TIMESTAMP - to_days(back) AS window_start, method, count(*) AS visits,
              count(*) FILTER (WHERE drift_detected) AS drift_events, CAST(sum(llm_tokens_used) AS BIGINT) AS tokens
            FROM (SELECT *, unnest([0, 1]) AS back FROM ({log}) AS l) AS l GROUP BY 1, 2""",
        "audit_sessions": f"""
            WITH l AS (SELECT url, crawled_at, drift_detected, id, coalesce(crawled_at - lag(crawled_at) OVER o > INTERVAL 12 HOUR, true) AS starts
                FROM ({log}) AS l WINDOW o AS (PARTITION BY url ORDER BY crawled_at, id)),
              s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY url ORDER BY crawled_at, id) AS n FROM l)
            SELECT url, min(crawled_at)::TIMESTAMP AS session_start, max(crawled_at)::TIMESTAMP + INTERVAL 12 HOUR AS session_end,
              count(*) AS visits, count(*) FILTER (WHERE drift_detected) AS drift_events FROM s GROUP BY url, n""",
        "audit_windows": f"""SELECT date_trunc('day', crawled_at)::TIMESTAMP AS window_start, method, count(*) AS visits,
              count(*) FILTER (WHERE drift_detected) AS drift_events, CAST(sum(llm_tokens_used) AS BIGINT) AS tokens
            FROM ({log}) AS l GROUP BY 1, 2""",
        "scan_html_files": """
            SELECT bucket, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest
            FROM (SELECT page_id // 100 AS bucket, string_agg(replace(html, chr(10), ' ') || chr(10), '' ORDER BY page_id) AS t
                  FROM pages GROUP BY 1) AS b""",
    }
    # A history in two parts ends where the whole one does.
    checks["replay_resumed"] = f"SELECT * EXCLUDE (origin) FROM ({checks['visit_replay']}) AS whole"
    checks["registry_after_resume"] = checks["registry_after_replay"]
    last = f"""SELECT run.*, f.key AS k FROM run JOIN ({_usable()}) AS f USING (visit_id)
               QUALIFY row_number() OVER (PARTITION BY run.part_key ORDER BY run.visit DESC) = 1"""
    checks["drift_vs_stored_registry"] = f"""
        WITH p AS MATERIALIZED ({_printed(_usable(), "visit_id, part_key, key, visual_hash")}),
          o AS MATERIALIZED (SELECT k, shown_origin FROM ({history} {last}) AS l
                             WHERE shown_origin IS NOT NULL AND ended IS DISTINCT FROM 'high_null_rate'),
          c AS (SELECT p.*, b.structural_hash AS b_hash, b.shingles AS b_shingles, b.visual_hash AS b_visual
                FROM p LEFT JOIN o ON o.k = p.key LEFT JOIN p AS b ON b.visit_id = o.shown_origin)
        SELECT visit_id, has_drift, drift_severity, structural_similarity, visual_similarity
        FROM ({_report('SELECT * FROM c', 'visit_id')}) AS r"""
    # The last version accepted before the visit, by DuckDB's own as-of join.
    as_of = f"""
        WITH p AS MATERIALIZED ({_printed(_usable(), "visit_id, visit, key, crawled_at, visual_hash")}),
          b AS (SELECT key, structural_hash, shingles, visual_hash,
                  crawled_at + CASE WHEN visit % 3 = 1 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS accepted_at
                FROM p WHERE visit % 3 <> 0)
        SELECT p.*, b.structural_hash AS b_hash, b.shingles AS b_shingles, b.visual_hash AS b_visual
        FROM p ASOF LEFT JOIN b ON p.key = b.key AND p.crawled_at > b.accepted_at"""
    checks["drift_as_of"] = _report(as_of, "visit_id, key")
    checks["selector_match"] = checks["selector_extract"]
    checks["extractor_resumed"] = checks["extractor_run"]
    # The streams must end where the batch jobs do.
    checks["registry_change_log"] = checks["registry_after_replay"]
    checks["audit_sessions_stream"] = checks["audit_sessions"]
    checks["replay_stream"] = checks["audit_log"]
    checks["audit_windows_stream"] = checks["audit_windows"]
    return checks
