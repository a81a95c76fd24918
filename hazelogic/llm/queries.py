"""The registered queries of the ten operators, and SQL for those it can express.

Each query applies its operator with production parameters to its whole table
and derives the digest columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazelogic.llm import decontam, html_extract, langid, licenses, lm_score, mixing, quality, simhash, tokens, warc
from hazelogic.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.digest(decontam.find_contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    docs = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    plan = mixing.plan_mix(docs)
    return plan.select("row.doc_id", "row.size", "source_size", "target", (F.col("copies") * F.col("row.size")).alias("taken"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("matches")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, langid.train(docs))
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_decontamination, op3_html_extraction, op4_source_mixing, op5_lm_scoring, op6_warc, op7_license_scan, op8_simhash_dedup, op9_language_id, op10_quality_rules)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hit AS (
  SELECT a.doc_id, a.i, a.k, win.item_id
  FROM pos a JOIN win ON win.k = a.k AND win.g = list_slice(a.w, a.i, a.i + a.k - 1)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)""",
    "op4_source_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT k, sum(size)::DOUBLE AS total, CAST(((row_number() OVER (ORDER BY k) - 1) % 3) + 1 AS DOUBLE) AS weight
  FROM d GROUP BY k),
t AS (SELECT sum(total) AS all_words FROM s),
fill AS (
  SELECT 0 AS step, (SELECT all_words FROM t) / (SELECT sum(weight) FROM s) AS level
  UNION ALL
  SELECT step + 1, ((SELECT all_words FROM t) - (SELECT coalesce(sum(3 * total), 0) FROM s WHERE 3 * total < weight * level))
    / (SELECT sum(weight) FROM s WHERE 3 * total >= weight * level)
  FROM fill WHERE step < 40),
src AS (SELECT k, total, least(3 * total, weight * (SELECT max(level) FROM fill)) AS target,
  CAST('0x' || substr(md5('42|' || k), 1, 5) AS BIGINT)::DOUBLE / 1048576 AS u FROM s),
o AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE (length(bin(size)) - 5) * 16 + (size >> (length(bin(size)) - 5)) END AS c,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c, h, CAST(doc_id AS VARCHAR), size) AS n FROM o)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target,
  CAST(CASE WHEN total > 0 THEN floor(u + n * (target / total)) - floor(u + (n - 1) * (target / total)) ELSE 0 END AS BIGINT) * size AS taken
FROM r JOIN src USING (k)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS least_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND least_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND least_id <> page_id THEN least_id END AS refers_to
FROM q""",
}
