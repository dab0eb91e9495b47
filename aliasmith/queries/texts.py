"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import querylog, typelm
from ..sources import files, pages
from .fixtures import PAGES, table, wiki_pages


def _docs(f):  # noqa: ANN001, ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("result"))

    return query


_STRIP = r"regexp_replace(strip_accents({}), '[\x{{300}}-\x{{36F}}\p{{Lm}}\p{{Sk}}]+', '', 'g')"
_SPACED = r"regexp_replace({}, '[\s\x00-\x1f\x7f]+', ' ', 'g')"
_PUNCT = "regexp_replace({}, '[[:punct:]]+', '{}', 'g')"
_ALNUM = r"[^\p{L}\p{Nd}]+"


def _sql(e: str) -> str:
    return f"SELECT doc_id, {e} AS result FROM documents"


def normalize_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.normalize_with_spans(F.col("text"))).alias("ix", "s"))
    return d.select("conv_id", "turn", "ix", F.col("s.text").alias("word"), F.col("s.start").alias("first"), F.col("s.end").alias("last"))


_SPANS_SQL = r"""
WITH a AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{Nd}]+') AS w, regexp_split_to_array(text, '[\p{L}\p{Nd}]+') AS g FROM conversations),
b AS (SELECT conv_id, turn, unnest(range(len(w)))::INT AS ix, unnest(w) AS word, unnest(g[1:len(w)]) AS gap FROM a),
c AS (SELECT *, (sum(length(word) + length(gap)) OVER (PARTITION BY conv_id, turn ORDER BY ix))::INT AS last FROM b)
SELECT conv_id, turn, ix, lower(word) AS word, (last - length(word))::INT AS first, last FROM c
"""


def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    q = F.concat(F.col("p_name"), F.lit(" of the "), F.lower("p_type"))
    e = F.concat(F.initcap(F.element_at(F.split("p_name", " "), 2)), F.lit("_%28"), F.col("p_type"), F.lit("%29"))
    return p.select("p_partkey", text.intent_part(q, e).alias("intent"))


_INTENT_SQL = "SELECT p_partkey, replace(replace(replace(p_name || ' of the ' || lower(p_type), ' the ', ' '), ' of ', ' '), string_split(p_name, ' ')[2], '') AS intent FROM part"


def urls_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", "url")
    return u.select("page_id", text.encode(F.col("url")).alias("encoded"), text.decode(text.encode(F.col("url"))).alias("decoded"))


def capitalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.capitalize_first(F.col("p_name")).alias("name"))


def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_unescape_twice(F.regexp_extract("html", "(?s)<footer>(.*?)</footer>", 1)).alias("footer"))


_UNESCAPED_SQL = "SELECT page_id, replace(replace(replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS footer FROM pages"


def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select(F.explode(text.trigrams(text.tokens(F.col("text")))).alias("ngram"))
    return t.groupBy("ngram").agg(F.count("*").alias("n"))


_TRIGRAM_SQL = r"""
WITH t AS (SELECT string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' ') AS w FROM benchmark),
i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM t),
g AS (SELECT unnest([w[i], CASE WHEN i < len(w) THEN w[i] || '_' || w[i + 1] END, CASE WHEN i + 1 < len(w) THEN w[i] || '_' || w[i + 1] || '_' || w[i + 2] END]) AS ngram FROM i)
SELECT ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY 1
"""


def context_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select(F.explode(text.context_words(text.tokens(F.col("text")))).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("n"))


_CONTEXT_SQL = r"""
WITH t AS (SELECT string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' ') AS w FROM benchmark),
i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM t),
g AS (SELECT unnest([w[i], CASE WHEN i > 1 THEN w[i - 1] || '_' || w[i] END]) AS word FROM i)
SELECT word, count(*) AS n FROM g WHERE word IS NOT NULL GROUP BY 1
"""


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    d = n.crossJoin(n.select(F.col("p_name").alias("other")))
    return d.select("p_name", "other", F.round(text.lexical_similarity(F.col("p_name"), F.col("other")), 9).alias("similarity"))


_LEXICAL_SQL = """
WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(upper(p_name), ' ')) AS w FROM n),
p AS (SELECT p_name, substr(w, i, 2) AS pair, count(*) AS c FROM (SELECT p_name, w, unnest(range(1, length(w))) AS i FROM w) GROUP BY ALL),
t AS (SELECT p_name, sum(c) AS t FROM p GROUP BY 1),
c AS (SELECT a.p_name, b.p_name AS other, sum(least(a.c, b.c)) AS common FROM p a JOIN p b USING (pair) GROUP BY ALL)
SELECT a.p_name, b.p_name AS other, round(2.0::DOUBLE * coalesce(common, 0) / (a.t + b.t), 9) AS similarity FROM t a CROSS JOIN t b LEFT JOIN c ON c.p_name = a.p_name AND c.other = b.p_name
"""


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages")
    return h.select("page_id", text.count_object(F.col("html"), "<p>").alias("paragraphs"), text.count_object(F.col("html"), "<!DOCTYPE").alias("at_start"), text.count_object(F.col("html"), "<li>").alias("items"))


_OBJECTS_SQL = "SELECT page_id, ((length(html) - length(replace(html, '<p>', ''))) / 3)::INT AS paragraphs, 0 AS at_start, ((length(html) - length(replace(html, '<li>', ''))) / 4)::INT AS items FROM pages"


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse(wiki_pages(spark, sf_dir)).select("page_id", "title", "ns", "is_redirect", "is_disambig", "is_stub", F.length("text").alias("n_chars"))


_PARSED_SQL = f"WITH {PAGES} SELECT page_id, title, ns, is_redirect, false AS is_disambig, contains(text, 'stub}}}}') OR contains(text, 'Wikipedia:Stub') AS is_stub, length(text)::INT AS n_chars FROM wiki"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each page's links, once each."""
    d = wiki_pages(spark, sf_dir).select("page_id", F.explode(text.link_targets(F.col("text"))).alias("target"))
    return d.select("page_id", text.encode(F.col("target")).alias("target"))


_PAGE_LINKS_SQL = PAGES.join(("WITH ", r", l AS (SELECT DISTINCT page_id, replace(trim(t), ' ', '_') AS target FROM (SELECT page_id, unnest(regexp_extract_all(text, '\[\[([^\[\]|:#]+)(?:#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]', 1)) AS t FROM raw)) SELECT page_id, replace(replace(url_encode(target), '%20', '+'), '%2A', '*') AS target FROM l"))


def first_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.first_paragraph(F.col("text")).alias("words"))


def session_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.log_queries(sessions(spark, sf_dir)).select("session_id", "number", "text", "adult", "navigational", "start_time")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log in XML made of the events of each user: each event is a query, an error has no annotation."""
    e = table(spark, sf_dir, "events")
    q = F.format_string(
        '<query adult="%s" navigational="%s" starttime="%d"><text>%s %d</text>%s</query>',
        F.when(F.col("event_type") == "error", "true").otherwise("false"), F.when(F.col("event_id") % 10 == 0, "true").otherwise("false"), F.col("event_id"), F.col("event_type"), F.col("event_id"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit('<annotation main="true"><target>Kind '), F.col("event_type"), F.lit("</target><span>"), F.col("event_type"), F.lit("</span></annotation><annotation><target>Kind "), F.col("event_type"), F.lit("</target><span>again</span></annotation>"))),
    )
    g = e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("event_id", q.alias("q"))))["q"], "").alias("qs"))
    return querylog.parse_sessions(g.select(F.concat(F.lit('<session id="u'), F.col("user_id").cast("string"), F.lit('">'), F.col("qs"), F.lit("</session>")).alias("value")))


_E = "e AS (SELECT 'u' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS number, event_type || ' ' || event_id AS text, event_type, event_id FROM events)"


def log_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = querylog.query_spans(querylog.log_queries(sessions(spark, sf_dir)))
    return s.select("session_id", "number", "span", "tag", "main", F.col("start").alias("first"), F.col("end").alias("last"), "level")


def log_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.qrels(querylog.query_spans(querylog.log_queries(sessions(spark, sf_dir))))


def log_query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.query_lines(querylog.not_navigational(querylog.log_queries(sessions(spark, sf_dir))))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    head = spark.createDataFrame([("query\tid\tlabel\tlocation",)], "value string")
    lines = labels.select(F.concat_ws("\t", F.concat(F.lit("q"), F.col("doc_id")), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("E"), F.col("doc_id") % 7)), F.when(F.col("quality") == 1, "Excellent").otherwise("Bad"), F.lit("us")).alias("value"))
    j = files.judgments(head.unionByName(lines))
    results = labels.select(F.concat(F.lit("q"), F.col("doc_id")).alias("query"), F.concat(F.lit("E"), F.col("doc_id") % 7).alias("entity"))
    return querylog.with_label(results, j).join(j.select("query", "relevant"), "query", "left")


_JUDGED_SQL = """
WITH j AS (SELECT 'q' || doc_id AS query, 'E' || doc_id % 7 AS entity, CASE WHEN quality = 1 THEN 'Excellent' ELSE 'Bad' END AS label FROM labels WHERE doc_id % 5 <> 0)
SELECT r.query, r.entity, coalesce(j.label, 'NF') AS label, j.label <> 'Bad' AS relevant FROM (SELECT 'q' || doc_id AS query, 'E' || doc_id % 7 AS entity FROM labels) r LEFT JOIN j ON j.query = r.query
"""


def type_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language models of part types from their names, sizes as frequencies."""
    p = table(spark, sf_dir, "part")
    lines = p.groupBy("p_type").agg(F.array_join(F.collect_list(F.format_string("(%d,%s)", F.col("p_size"), F.col("p_name"))), ",").alias("x")).select(F.concat_ws("\t", "p_type", "x").alias("value"))
    lm, totals, background = typelm.language_model(files.type_phrases(lines))
    return lm.join(totals, "type").join(background, "ngram")


_TYPE_MODEL_SQL = """
WITH g AS (SELECT p_type AS type, p_size AS f, unnest([string_split(p_name, ' ')[1], replace(p_name, ' ', '_'), string_split(p_name, ' ')[2]]) AS ngram FROM part),
l AS (SELECT type, ngram, sum(f)::BIGINT AS freq FROM g GROUP BY ALL)
SELECT type, ngram, freq, (sum(freq) OVER (PARTITION BY type))::BIGINT AS type_freq, (sum(freq) OVER (PARTITION BY ngram))::BIGINT AS bg_freq, (sum(freq) OVER ())::BIGINT AS total_freq FROM l
"""


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each part type by their frequency."""
    p = table(spark, sf_dir, "part")
    w = p.select(F.col("p_type").alias("type"), F.explode(F.split("p_name", " ")).alias("word"), "p_size").groupBy("type", "word").agg(F.sum("p_size").alias("freq"))
    return typelm.type_top_words(w, 10)


_TOP_WORDS_SQL = """
WITH w AS (SELECT type, word, sum(p_size)::BIGINT AS freq FROM (SELECT p_type AS type, unnest(string_split(p_name, ' ')) AS word, p_size FROM part) GROUP BY ALL)
SELECT type, rank, word, freq FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY freq DESC, word)::INT AS rank FROM w) WHERE rank <= 10
"""

QUERIES = {
    "normalize": _docs(text.normalize),
    "normalize_with_spans": normalize_with_spans,
    "normalize_regexp": _docs(text.normalize_regexp),
    "normalize_regexp_copy": _docs(text.normalize_regexp_copy),
    "intent_part": intent,
    "fold": _docs(text.fold),
    "normalize_text": _docs(text.normalize_text),
    "url_encode_decode": urls_encoded,
    "capitalize_first": capitalized,
    "html_unescape": unescaped,
    "trigrams": trigram_counts,
    "context_words": context_word_counts,
    "lexical_similarity": lexical,
    "count_object": page_objects,
    "page_parse": parsed_pages,
    "page_links": page_links,
    "first_paragraph": first_paragraphs,
    "query_log": session_queries,
    "query_log_spans": log_spans,
    "qrels": log_qrels,
    "query_log_lines": log_query_lines,
    "judgments": judged,
    "type_lm": type_model,
    "type_top_words": top_words,
}

SQL = {
    "normalize": _sql(f"trim(regexp_replace(lower(text), '{_ALNUM}', ' ', 'g'))"),
    "normalize_with_spans": _SPANS_SQL,
    "normalize_regexp": _sql("trim(lower(" + _STRIP.format(_SPACED.format("text")) + "))"),
    "normalize_regexp_copy": _sql("trim(lower(" + _SPACED.format(_PUNCT.format("text", "")) + "))"),
    "intent_part": _INTENT_SQL,
    "fold": _sql("trim(lower(" + _STRIP.format(_SPACED.format(_PUNCT.format("text", " "))) + "))"),
    "normalize_text": _sql("trim(lower(" + _SPACED.format(_PUNCT.format(_STRIP.format("text"), " ")) + "))"),
    "url_encode_decode": "SELECT page_id, replace(replace(replace(url_encode(url), '%20', '+'), '%2A', '*'), '~', '%7E') AS encoded, url AS decoded FROM pages",
    "capitalize_first": "SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS name FROM part",
    "html_unescape": _UNESCAPED_SQL,
    "trigrams": _TRIGRAM_SQL,
    "context_words": _CONTEXT_SQL,
    "lexical_similarity": _LEXICAL_SQL,
    "count_object": _OBJECTS_SQL,
    "page_parse": _PARSED_SQL,
    "page_links": _PAGE_LINKS_SQL,
    "first_paragraph": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(regexp_extract(regexp_replace(text, '^(?:\s+|\{[^}]*\}|\[[^\]]*\])+', ''), '^([^\n]+)\n', 1)), '[\p{L}\p{Nd}]+'), ' ') AS words FROM documents",
    "query_log": f"WITH {_E} SELECT session_id, number, text, event_type = 'error' AS adult, event_id % 10 = 0 AS navigational, event_id::VARCHAR AS start_time FROM e",
    "query_log_spans": f"WITH {_E} SELECT session_id, number, event_type AS span, 'Kind ' || event_type AS tag, true AS main, 0 AS first, length(event_type)::INT AS last, 1 AS level FROM e WHERE event_type <> 'error'",
    "qrels": f"WITH {_E} SELECT session_id || '-' || number || ' Q0 Kind_' || event_type || ' 1' AS value FROM e WHERE event_type <> 'error'",
    "query_log_lines": f"WITH {_E} SELECT session_id || '-' || number || chr(9) || text AS value FROM e WHERE event_id % 10 <> 0",
    "judgments": _JUDGED_SQL,
    "type_lm": _TYPE_MODEL_SQL,
    "type_top_words": _TOP_WORDS_SQL,
}
