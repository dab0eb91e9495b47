"""Queries of the training-data operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_extract, masked_lm, neardup, quality, substring, token_counts, toxicity, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scored(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.shared_passages(_table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(_table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, _table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_masked_lm": op1_masked_lm,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_html": op4_html,
    "op5_neardup": op5_neardup,
    "op6_substring": op6_substring,
    "op7_urls": op7_urls,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "pipeline": pipeline,
}

#: Every window of 50 words is compared with every other: the brute force that recompression saves.
_SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS pos, len(x) AS n
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), g AS (
  SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS gram FROM w
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY gram) AS c FROM g WHERE pos + 50 <= n
), s AS (
  SELECT doc_id, pos, k > 1 AS later, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r WHERE c > 1
), t AS (
  SELECT doc_id, pos, later, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM s
), l AS (
  SELECT doc_id, span, least(50, pos - lag(pos, 1, pos - 50) OVER (PARTITION BY doc_id, span ORDER BY pos)) AS more FROM t WHERE later
)
SELECT a.doc_id, a.start_word, a.end_word, coalesce(b.later_words, 0)::BIGINT AS later_words
FROM (SELECT doc_id, span, min(pos)::BIGINT AS start_word, (max(pos) + 50)::BIGINT AS end_word FROM t GROUP BY ALL) a
LEFT JOIN (SELECT doc_id, span, sum(more) AS later_words FROM l GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.span = b.span
"""

#: All pairs of equal runs of 5 words in a document; those on one diagonal in a row make a repeat.
_QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') END AS x FROM documents
), w AS (
  SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS pos, len(x) AS n FROM d
), g AS (
  SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM w
), r AS (
  SELECT doc_id, pos, gram FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE pos + 5 <= n) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(least(5, gap))::BIGINT AS covered FROM (SELECT doc_id, pos - lag(pos, 1, pos - 5) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM r) GROUP BY doc_id
), p AS (
  SELECT a.doc_id, b.pos - a.pos AS apart, a.pos - row_number() OVER (PARTITION BY a.doc_id, b.pos - a.pos ORDER BY a.pos) AS run FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.pos < b.pos
), lon AS (
  SELECT doc_id, max(c) + 4 AS longest FROM (SELECT doc_id, apart, run, count(*) AS c FROM p GROUP BY ALL) GROUP BY doc_id
), t AS (
  SELECT d.doc_id, len(x)::BIGINT AS n_words, coalesce(covered, 0)::BIGINT AS covered_words, CASE WHEN len(x) > 0 THEN coalesce(covered, 0)::DOUBLE / len(x) ELSE 0.0::DOUBLE END AS covered_fraction, coalesce(longest, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN lon ON d.doc_id = lon.doc_id
)
SELECT *, covered_fraction <= 0.3 AND longest_repeat <= 50 AS keep FROM t
"""

#: Every URL is compared with every rule: the cross join that the sweep saves.
_URLS_SQL = r"""
WITH u AS (
  SELECT page_id, lower(regexp_replace(regexp_extract(url, '{host}', 1), '\.+$', '')) AS host, regexp_extract(url, '{rest}', 1) AS rest FROM pages
), k AS (
  SELECT page_id, CASE WHEN host IS NULL OR host = '' THEN NULL ELSE CASE WHEN regexp_full_match(host, '[0-9]+(\.[0-9]+){{3}}') THEN host ELSE array_to_string(list_reverse(string_split(host, '.')), '.') END || '.' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS url_key FROM u
), r0 (rule, action) AS (VALUES {rules}), r1 AS (
  SELECT rule, action, array_to_string(list_reverse(string_split(split_part(rule, '/', 1), '.')), '.') || '.' || CASE WHEN contains(rule, '/') THEN substr(rule, strpos(rule, '/')) ELSE '' END AS prefix FROM r0
), m AS (
  SELECT page_id, url_key, count(prefix)::INT AS n_rules, max_by(rule, length(prefix)) AS rule, max_by(action, length(prefix)) AS action
  FROM (SELECT *, row_number() OVER () AS nr FROM k) LEFT JOIN r1 ON starts_with(url_key, prefix) GROUP BY nr, page_id, url_key
)
SELECT *, coalesce(action <> 'block', true) AS keep FROM m
""".format(host=url_rules._HOST, rest=url_rules._REST, rules=", ".join(f"('{a}', '{b}')" for a, b in url_rules.RULES))

ORACLE_SQL: dict[str, str] = {"op6_substring": _SUBSTRING_SQL, "op7_urls": _URLS_SQL, "op8_quality": _QUALITY_SQL}
