"""One query per operator, over whole tables: (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from driftloom.llm import alignment, codes, divergence, line_dedup, mixing, packing, pieces, piecewise, quality, simhash, substring_dedup, templates, toxicity
from driftloom.llm.common import table
from driftloom.storage import work_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.deduplicate(table(spark, folder, "documents")))


def op2_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark)
    codes.write_codes(table(spark, folder, "documents"), path)
    return codes.checksums(codes.read_documents(spark, path))


def op3_fuzzy_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines, n_kept and the hash of what stays of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    n_lines = [F.size(F.split(F.coalesce(c, F.lit("")), "\n")).cast("long") for c in ("whole", "text")]
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return line_dedup.deduplicate(docs).select("doc_id", n_lines[0].alias("n_lines"), n_lines[1].alias("n_kept"), kept.alias("kept_sha256"))


def op4_template_removal(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract(table(spark, folder, "pages"))


def op5_piecewise_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return piecewise.compare_with_next(table(spark, folder, "documents"))


def op6_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.learn(docs, table(spark, folder, "labels")))


def op8_target_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_of(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), with_ids=False).drop("ids")


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest(pieces.decode(pieces.encode(table(spark, folder, "documents"))))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM starts
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _divided_sql(name: str, nodes: str, parents: str, by: str, label: str, weights: dict[str, int]) -> str:
    known = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    weight = f"CASE {label} {known} ELSE 1 END" if known else "1"
    return f"""
{name}_a AS (
  SELECT n.*, p.whole, {weight} AS weight FROM {nodes} n JOIN {parents} p USING ({by})
), {name}_b AS (
  SELECT *, capacity * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (whole - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled
  FROM {name}_a WINDOW w AS (PARTITION BY {by} ORDER BY CAST(capacity AS DOUBLE) / weight, {label})
), {name} AS (
  SELECT *, CASE WHEN filled THEN capacity ELSE
    (weight * (whole - coalesce(sum(capacity) FILTER (filled) OVER (PARTITION BY {by}), 0)))
    // sum(weight) FILTER (NOT filled) OVER (PARTITION BY {by}) END AS budget
  FROM {name}_b
)"""


OP8_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    CASE WHEN left(md5(coalesce(source, '')), 1) < '4' THEN 'd0' WHEN left(md5(coalesce(source, '')), 1) < '8' THEN 'd1'
         WHEN left(md5(coalesce(source, '')), 1) < 'c' THEN 'd2' ELSE 'd3' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, language, origin, sum(n_tokens) AS supply, sum(n_tokens) * {mixing.MAX_EPOCHS} AS capacity FROM docs GROUP BY ALL
), families AS (
  SELECT domain, language, sum(capacity) AS capacity FROM leaves GROUP BY ALL
), domains AS (
  SELECT 0 AS root, domain, sum(capacity) AS capacity FROM families GROUP BY ALL
), root AS (
  SELECT 0 AS root, least(sum(supply) * {mixing.PERCENT} // 100, sum(capacity)) AS whole FROM leaves
), {_divided_sql("top", "domains", "root", "root", "domain", mixing.DOMAIN_WEIGHTS)}
, top_whole AS (SELECT domain, budget AS whole FROM top)
, {_divided_sql("middle", "families", "top_whole", "domain", "language", mixing.LANGUAGE_WEIGHTS)}
, middle_whole AS (SELECT domain, language, budget AS whole FROM middle)
, {_divided_sql("bottom", "leaves", "middle_whole", "domain, language", "origin", mixing.SOURCE_WEIGHTS)}
, planned AS (
  SELECT *, coalesce(budget // nullif(supply, 0), 0) AS epochs FROM bottom
), ordered AS (
  SELECT d.*, p.epochs, p.budget - p.epochs * p.supply AS rest,
    md5('{mixing.SEED}:' || CAST(p.epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS o
  FROM docs d JOIN planned p USING (domain, language, origin)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY o) - n_tokens AS before FROM ordered
), last AS (
  SELECT domain, language, origin, max(o) FILTER (before < rest) AS last FROM summed GROUP BY ALL
)
SELECT doc_id, domain, language, origin, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(epochs + coalesce(o <= last AND rest > 0, FALSE)::INT AS BIGINT) AS copies,
  CAST(epochs * n_tokens + CASE WHEN o <= last AND rest > 0 THEN least(n_tokens, rest - before) ELSE 0 END AS BIGINT) AS taken
FROM summed LEFT JOIN last USING (domain, language, origin)
"""


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DF}
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), found AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n,
    1 + ({divergence.SCALE} * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM dense JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, sum(n) AS n FROM found GROUP BY ALL
), q AS (
  SELECT lang, term, 1 + ({divergence.SCALE} * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM whole JOIN sizes USING (lang)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    every = (
        op1_substring_dedup,
        op2_token_codes,
        op3_fuzzy_line_dedup,
        op4_template_removal,
        op5_piecewise_fingerprints,
        op6_toxic_segments,
        op7_quality_rules,
        op8_target_mixing,
        op9_packing,
        op10_simhash_near_dedup,
        op11_sentencepiece,
        op12_source_divergence,
        op13_tokenizer_alignment,
        pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL expresses; the others are tested against brute force."""
    return {"op1_substring_dedup": OP1_SQL, "op8_target_mixing": OP8_SQL, "op12_source_divergence": OP12_SQL}
