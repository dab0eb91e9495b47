"""Queries of mining and of the aggregation of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import importance
from ..operators import aggregate, mining, store
from ..plans import datapack as plans
from ..sources import files, pages
from .fixtures import CANDIDATES, COUNTS, PAGES, candidates, counts, table, wiki_pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse(wiki_pages(spark, sf_dir))


def docno(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mining.docno_filter(_pages(spark, sf_dir), keep_all=False)
    return mining.repack(p.select("page_id", "title"), mining.docno_assign(p))


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.page_type_counts(_pages(spark, sf_dir))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.redirects(_pages(spark, sf_dir))


def redirect_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.redirect_closure(mining.redirects(_pages(spark, sf_dir)))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.links(_pages(spark, sf_dir))


def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return mining.links_resolved(mining.links(p), p)


def _followed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _pages(spark, sf_dir)
    found = mining.links_resolved(mining.links(p), p)
    return p, found, mining.follow_redirects(found, mining.redirect_closure(mining.redirects(p)))


def anchor_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.anchor_entity_counts(_followed(spark, sf_dir)[2])


def anchor_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of each anchor, printed."""
    m = mining.anchor_map(anchor_entity_counts(spark, sf_dir))
    return m.select("anchor", F.array_join(F.transform(F.map_entries("entities"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("entities"))


def entity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mining.entity_map(anchor_entity_counts(spark, sf_dir))
    return m.select("entity", F.array_join(F.transform(F.map_entries("anchors"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("anchors"))


def alias_corpus_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, found, _ = _followed(spark, sf_dir)
    return mining.alias_corpus_freq(p, found)


def datapack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.mine(_pages(spark, sf_dir))


def datapack_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.datapack_ngrams(counts(spark, sf_dir))


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.entity_ids(counts(spark, sf_dir))


_NUMBERED = ", ids AS (SELECT entity, row_number() OVER (ORDER BY regexp_replace(entity, '[^A-Za-z0-9 ]', '', 'g'), entity) AS entity_id FROM (SELECT DISTINCT entity_id AS entity FROM counts))"
_TARGET = "trim(replace(CASE WHEN regexp_matches({0}, '^[a-z]') THEN upper({0}[1]) || {0}[2:] ELSE {0} END, '&amp;', '&'))"
_REDIRECTS = (
    PAGES
    + r""", r0 AS (SELECT title AS source, trim(regexp_replace(string_split(regexp_extract(text, '\[\[(.*?)\]\]', 1), '|')[1], '#.*$', '')) AS t FROM wiki WHERE is_redirect),
redirects AS (SELECT source, target FROM (SELECT source, """
    + _TARGET.format("t")
    + """ AS target FROM r0) WHERE length(target) > 0 AND source <> target)"""
)
_LINKS = (
    _REDIRECTS
    + r""", l0 AS (SELECT title AS source, unnest(regexp_extract_all(text, '\[\[[^\[\]|:]*(?:\|[^\[\]]*)?\]\]')) AS link FROM wiki),
l1 AS (SELECT source, trim(regexp_replace(regexp_extract(link, '\[\[([^\[\]|:]*)', 1), '#.*$', '')) AS t, CASE WHEN contains(link, '|') AND regexp_extract(link, '\|([^\[\]]*)', 1) <> '' THEN regexp_extract(link, '\|([^\[\]]*)', 1) ELSE regexp_extract(link, '\[\[([^\[\]|:]*)', 1) END AS a FROM l0),
links AS (SELECT * FROM (SELECT source, """
    + _TARGET.format("t")
    + r""" AS target, trim(lower(regexp_replace(strip_accents(regexp_replace(regexp_replace(replace(a, '&amp;', '&'), '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g')), '[\p{Lm}\p{Sk}]+', '', 'g'))) AS anchor FROM l1) WHERE length(anchor) >= 2 AND length(target) > 0),
resolved AS (SELECT source, target, anchor FROM links WHERE target IN (SELECT CASE WHEN regexp_matches(title, '^[a-z]') THEN upper(title[1]) || title[2:] ELSE title END FROM wiki))"""
)
_CLOSED = """, edges AS (SELECT source, min(target) AS target FROM redirects GROUP BY 1), walk AS (
  SELECT source, [source, target] AS trail, false AS done FROM edges
  UNION ALL
  SELECT w.source, CASE WHEN e.target IS NULL THEN w.trail WHEN e.target = w.source THEN [w.source] WHEN list_contains(w.trail, e.target) THEN w.trail ELSE list_append(w.trail, e.target) END, e.target IS NULL OR list_contains(w.trail, e.target)
  FROM walk w LEFT JOIN edges e ON e.source = w.trail[len(w.trail)] WHERE NOT w.done
), closed AS (SELECT source, trail[len(trail)] AS target FROM walk WHERE done)"""
_COUNTED = _LINKS + _CLOSED + ", followed AS (SELECT r.source, coalesce(c.target, r.target) AS target, anchor FROM resolved r LEFT JOIN closed c ON c.source = r.target), aec AS (SELECT anchor, target AS entity, count(*) AS n FROM followed GROUP BY ALL)"
_CORPUS = (
    _COUNTED
    + r""", plain AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[\[[A-Za-z]+:[^\[\]]*\]\]', '', 'g'), '\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]', '\1', 'g'), '''{2,}|<[^>]*>', '', 'g'), '\{\{[^{}]*\}\}', '', 'g') AS t FROM wiki),
folded AS (SELECT string_split(trim(lower(regexp_replace(strip_accents(regexp_replace(regexp_replace(t, '[[:punct:]]+', ' ', 'g'), '[\s\x00-\x1f\x7f]+', ' ', 'g')), '[\p{Lm}\p{Sk}]+', '', 'g'))), ' ') AS w FROM plain),
vocabulary AS (SELECT DISTINCT anchor, len(string_split(anchor, ' ')) AS size FROM resolved),
pl AS (SELECT w, unnest(range(2, len(w))) AS i FROM folded), sized AS (SELECT w, i, unnest(range(1, (SELECT max(size) FROM vocabulary) + 1)) AS size FROM pl),
grams AS (SELECT array_to_string(w[i:i + size - 1], ' ') AS alias FROM sized WHERE i + size - 1 < len(w)),
cf AS (SELECT alias, sum(n)::BIGINT AS cf FROM (SELECT alias, count(*) AS n FROM grams JOIN vocabulary ON alias = anchor GROUP BY 1 UNION ALL SELECT anchor, count(*) FROM resolved GROUP BY 1) GROUP BY 1)"""
)
_PACK = """SELECT anchor AS alias, cf AS phrase_freq, t::BIGINT AS alias_freq, replace(replace(replace(url_encode(replace(entity, ' ', '_')), '%20', '+'), '%2A', '*'), '~', '%7E') AS entity_id, n AS alias_entity_freq
FROM (SELECT *, sum(n) OVER (PARTITION BY anchor) AS t FROM aec) a JOIN cf ON lower(alias) = lower(anchor) WHERE length(trim(anchor)) >= 2 AND NOT (regexp_full_match(anchor, '[-+]?[0-9]*\\.?[0-9]+') AND t < 2)"""


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as tab-separated text, read back and filtered."""
    path = f"{mining.shared_dir(spark)}/tsv-{mining.uuid.uuid4().hex}"
    files.write_tsv(counts(spark, sf_dir), path)
    return aggregate.valid_counts(files.read_tsv(spark, path, files.COUNTS), ("alias", "entity_id"), ("phrase_freq", "alias_freq", "alias_entity_freq"))


def aggregate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate_counts(counts(spark, sf_dir))


def compute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.compute_counts(aggregate.aggregate_counts(counts(spark, sf_dir)))


def _feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.normalized_counts(counts(spark, sf_dir))


def distinct_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feat(spark, sf_dir)


def alias_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.alias_entity_totals(_feat(spark, sf_dir))


def alias_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.alias_totals(alias_entity(spark, sf_dir))


def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.entity_totals(alias_entity(spark, sf_dir))


def phrase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.phrase_totals(_feat(spark, sf_dir))


def phrase_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.phrase_rescaled(aggregate_counts(spark, sf_dir))


def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.grand_totals(compute_counts(spark, sf_dir))


_FEAT = COUNTS + r""", feat AS (SELECT DISTINCT alias AS ori_alias, trim(lower(regexp_replace(regexp_replace(alias, '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g'))) AS alias, phrase_freq, alias_freq, entity_id, alias_entity_freq FROM counts WHERE length(alias) > 0 AND length(entity_id) > 0 AND phrase_freq > 0 AND alias_freq > 0 AND alias_entity_freq > 0),
ae AS (SELECT entity_id, alias, sum(alias_entity_freq)::BIGINT AS alias_entity_freq FROM feat GROUP BY ALL), al AS (SELECT alias, sum(alias_entity_freq)::BIGINT AS alias_freq FROM ae GROUP BY 1), en AS (SELECT entity_id, sum(alias_entity_freq)::BIGINT AS entity_freq FROM ae GROUP BY 1),
ph AS (SELECT alias, sum(phrase_freq)::BIGINT AS phrase_freq FROM (SELECT DISTINCT ori_alias, alias, phrase_freq FROM feat) GROUP BY 1), agg AS (SELECT alias, alias_freq, phrase_freq, entity_id, entity_freq, alias_entity_freq FROM ae JOIN al USING (alias) JOIN ph USING (alias) JOIN en USING (entity_id))"""
_COMPUTED = _FEAT + """, ph2 AS (SELECT alias, ceil(sum(alias_entity_freq)::DOUBLE / max(alias_freq)::DOUBLE * max(phrase_freq)::DOUBLE)::BIGINT AS phrase_freq FROM agg GROUP BY 1), comp AS (SELECT alias, alias_freq, ph2.phrase_freq, entity_id, entity_freq, alias_entity_freq FROM agg JOIN ph2 USING (alias))"""


def joined_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = compute_counts(spark, sf_dir).selectExpr("alias", "alias_freq", "phrase_freq AS alias_total", "entity_id AS entity", "entity_freq", "alias_entity_freq")
    return aggregate.joined_stats(graph, _ids(spark, sf_dir))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ids for each brand, none for Brand#7."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity")).distinct().filter("entity <> 'Brand#7'")
    n = F.substring("entity", 7, 9).cast("int")
    return b.select("entity", F.explode(F.array((n * 10).cast("string"), (n * 10 + 5).cast("string"))).alias("entity_id"))


_STATS = _COMPUTED + """, ids AS (SELECT entity, min(id) AS entity_id FROM (SELECT DISTINCT p_brand AS entity, unnest([(CAST(substr(p_brand, 7) AS INT) * 10)::VARCHAR, (CAST(substr(p_brand, 7) AS INT) * 10 + 5)::VARCHAR]) AS id FROM part WHERE p_brand <> 'Brand#7') GROUP BY 1),
st AS (SELECT alias, c.entity_id AS entity, count(*) OVER (PARTITION BY alias) AS entity_total, 0::BIGINT AS search_alias_entity_freq, 0::BIGINT AS alt_alias_entity_freq, alias_entity_freq AS graph_alias_entity_freq, c.entity_freq AS graph_entity_freq, alias_freq AS graph_alias_freq, phrase_freq AS graph_total FROM comp c)
, stats AS (SELECT alias, st.entity, ids.entity_id, entity_total, 1::SMALLINT AS type_id, 'Entity' AS type, 0::BIGINT AS search_entity_freq, 0::BIGINT AS alt_entity_freq, graph_entity_freq, search_alias_entity_freq, alt_alias_entity_freq, graph_alias_entity_freq, 0::BIGINT AS search_alias_freq, 0::BIGINT AS search_clicks, 0::BIGINT AS search_total, 0::BIGINT AS alt_alias_freq, 0::BIGINT AS alt_total, graph_alias_freq, graph_total FROM st JOIN ids ON ids.entity = st.entity)"""


def link_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregate.with_importance(joined_stats(spark, sf_dir))
    return d.select("alias", "entity", *[F.round(k, 9).alias(k) for k in importance()])


_IMPORTANCE_SQL = f"""WITH {_STATS}, f AS (SELECT alias, entity, 1.0::DOUBLE / (graph_total + 2) AS sp, 0.5::DOUBLE AS sa, 1.0::DOUBLE / entity_total AS se, (graph_alias_freq + 1.0::DOUBLE) / (graph_total + 2) AS ga, (graph_alias_entity_freq + 1.0::DOUBLE) / (graph_alias_freq + entity_total) AS ge, 1.0::DOUBLE / (graph_total + 3) AS w FROM stats)
SELECT alias, entity, round(sp, 9) AS search_prob_phrase, round(sa, 9) AS search_prob_alias, round(se, 9) AS search_prob_entity_alias, round(sa, 9) AS alt_search_prob_alias, round(se, 9) AS alt_search_prob_entity_alias, round(1 - sp, 9) AS graph_prob_phrase, round(ga, 9) AS graph_prob_alias, round(ge, 9) AS graph_prob_entity_alias,
round(w, 9) AS search_weight, round(w, 9) AS alt_search_weight, round(1 - w - w, 9) AS graph_weight, round(sp * sa * se + (1 - sp) * ga * ge, 9) AS link_importance_00, round(sp * ga * se + (1 - sp) * ga * ge, 9) AS link_importance_01, round(w * sa * se + w * sa * se + (1 - w - w) * ga * ge, 9) AS link_importance_02 FROM f"""


def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.feature_lines(candidates(spark, sf_dir))


_LINES_SQL = f"""WITH {CANDIDATES} SELECT concat_ws(chr(1), alias, any_value(qaf), any_value(qac), any_value(qat), 1, 1, any_value(laf), any_value(lat), count(*)) || chr(9) || string_agg(concat_ws(chr(1), entity_id, type, qef, qaef, 1, 1, let, laet), chr(9) ORDER BY ix) AS value FROM cand GROUP BY alias"""


def parse_feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature lines written as text, read back and parsed."""
    path = f"{mining.shared_dir(spark)}/lines-{mining.uuid.uuid4().hex}"
    files.write_lines(feature_lines(spark, sf_dir), path)
    return store.parse_feature_lines(spark.read.text(path))


def feature_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("alias", F.concat_ws(":", "entity_id", "laet").alias("entity"))
    return store.feature_bag(c)


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.nested(candidates(spark, sf_dir)).select("alias", F.size("entities").cast("bigint").alias("n"), "prior_clicks", "prior_links")


def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.global_stats(candidates(spark, sf_dir))


def ngram_query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of part names and of each of their words as aliases of their own."""
    c = candidates(spark, sf_dir).select("alias", "qat")
    return store.ngram_query_counts(c.unionByName(c.select(F.explode(F.split("alias", " ")).alias("alias"), F.lit(1).cast("bigint").alias("qat"))))


def bogus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    zero = c.select((F.concat(F.lit("no "), F.col("entity_id"))).alias("alias"), *[F.lit(0).cast("bigint").alias(k) for k in store.ALIAS_COUNTS])
    return store.bogus_counts(c.select("alias", *store.ALIAS_COUNTS).unionByName(zero))


QUERIES = {
    "docno": docno,
    "page_type_counts": page_types,
    "redirects": redirects,
    "redirect_closure": redirect_closure,
    "links": links,
    "links_resolved": links_resolved,
    "anchor_entity_counts": anchor_entity_counts,
    "anchor_map": anchor_map,
    "entity_map": entity_map,
    "alias_corpus_freq": alias_corpus_freq,
    "datapack": datapack,
    "datapack_ngrams": datapack_ngrams,
    "entity_ids": entity_ids,
    "source_counts": source_counts,
    "distinct_feat": distinct_feat,
    "alias_entity": alias_entity,
    "alias_totals": alias_totals,
    "entity_totals": entity_totals,
    "phrase_totals": phrase_totals,
    "phrase_rescaled": phrase_rescaled,
    "aggregate_counts": aggregate_counts,
    "compute_counts": compute_counts,
    "grand_totals": grand_totals,
    "joined_stats": joined_stats,
    "link_importance": link_importance,
    "feature_lines": feature_lines,
    "parse_feature_lines": parse_feature_lines,
    "feature_bag": feature_bag,
    "prior_totals": nested,
    "global_stats": global_stats,
    "ngram_query_counts": ngram_query_counts,
    "bogus_counts": bogus_counts,
}

_KINDS = "CASE WHEN is_redirect THEN 'REDIRECT' WHEN text = '' THEN 'EMPTY' WHEN ns = 0 THEN 'ARTICLE' ELSE 'NON_ARTICLE' END"

SQL = {
    "docno": f"WITH {PAGES} SELECT page_id, title, row_number() OVER (ORDER BY page_id) AS docno FROM wiki WHERE NOT is_redirect AND ns = 0 AND length(text) > 0 AND length(title) <= 0.3 * length(text)",
    "page_type_counts": f"WITH {PAGES} SELECT type, count(*) AS n FROM (SELECT 'TOTAL' AS type FROM wiki UNION ALL SELECT {_KINDS} FROM wiki UNION ALL SELECT 'STUB' FROM wiki WHERE NOT is_redirect AND ns = 0 AND (contains(text, 'stub}}}}') OR contains(text, 'Wikipedia:Stub'))) GROUP BY 1",
    "redirects": f"WITH {_REDIRECTS} SELECT * FROM redirects",
    "redirect_closure": f"WITH RECURSIVE {_REDIRECTS}{_CLOSED} SELECT * FROM closed",
    "links": f"WITH {_LINKS} SELECT source, target, anchor FROM links",
    "links_resolved": f"WITH {_LINKS} SELECT * FROM resolved",
    "anchor_entity_counts": f"WITH RECURSIVE {_COUNTED} SELECT * FROM aec",
    "anchor_map": f"WITH RECURSIVE {_COUNTED} SELECT anchor, string_agg(entity || '=' || n, ';' ORDER BY entity) AS entities FROM aec GROUP BY 1",
    "entity_map": f"WITH RECURSIVE {_COUNTED} SELECT entity, string_agg(anchor || '=' || n, ';' ORDER BY anchor) AS anchors FROM aec GROUP BY 1",
    "alias_corpus_freq": f"WITH RECURSIVE {_CORPUS} SELECT * FROM cf",
    "datapack": f"WITH RECURSIVE {_CORPUS} {_PACK}",
    "datapack_ngrams": f"WITH {COUNTS}, s AS (SELECT *, string_split(alias, ' ') AS w FROM counts), i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s), j AS (SELECT *, unnest(range(i, len(w) + 1)) AS j FROM i) SELECT array_to_string(w[i:j], ' ') AS alias, phrase_freq, alias_freq, entity_id, alias_entity_freq FROM j",
    "entity_ids": f"WITH {COUNTS}{_NUMBERED} SELECT * FROM ids",
    "source_counts": f"WITH {COUNTS} SELECT * FROM counts WHERE alias_entity_freq > 0",
    "distinct_feat": f"WITH {_FEAT} SELECT * FROM feat",
    "alias_entity": f"WITH {_FEAT} SELECT * FROM ae",
    "alias_totals": f"WITH {_FEAT} SELECT * FROM al",
    "entity_totals": f"WITH {_FEAT} SELECT * FROM en",
    "phrase_totals": f"WITH {_FEAT} SELECT * FROM ph",
    "phrase_rescaled": f"WITH {_COMPUTED} SELECT * FROM ph2",
    "aggregate_counts": f"WITH {_FEAT} SELECT * FROM agg",
    "compute_counts": f"WITH {_COMPUTED} SELECT * FROM comp",
    "grand_totals": f"WITH {_COMPUTED} SELECT (SELECT sum(alias_freq) FROM (SELECT DISTINCT alias, alias_freq, phrase_freq FROM comp))::BIGINT AS alias_total, (SELECT sum(phrase_freq) FROM (SELECT DISTINCT alias, alias_freq, phrase_freq FROM comp))::BIGINT AS phrase_total, (SELECT sum(entity_freq) FROM (SELECT DISTINCT entity_id, entity_freq FROM comp))::BIGINT AS entity_total, (SELECT sum(alias_entity_freq) FROM comp)::BIGINT AS alias_entity_total",
    "joined_stats": f"WITH {_STATS} SELECT * FROM stats",
    "link_importance": _IMPORTANCE_SQL,
    "feature_lines": _LINES_SQL,
    "parse_feature_lines": f"WITH {CANDIDATES} SELECT alias, qaf, qac, qat, laf, lat, ix, entity_id, type, qef, qaef, let, laet FROM cand",
    "feature_bag": f"WITH {CANDIDATES} SELECT alias, string_agg(entity_id || ':' || laet, chr(9) ORDER BY entity_id || ':' || laet) AS entities FROM cand GROUP BY 1",
    "prior_totals": f"WITH {CANDIDATES} SELECT alias, count(*) AS n, sum(qef)::BIGINT AS prior_clicks, sum(let)::BIGINT AS prior_links FROM cand GROUP BY 1",
    "global_stats": f"WITH {CANDIDATES}, a AS (SELECT DISTINCT alias, qaf, qat, qac, laf, lat FROM cand) SELECT (SELECT entities FROM stats)::BIGINT AS entities, (SELECT count(*) FROM a) AS phrases, (SELECT count(*) FROM cand) AS entity_phrase_pairs, (SELECT sum(qaf) FROM a)::BIGINT AS sqaf, (SELECT sum(qat) FROM a)::BIGINT AS sqat, (SELECT sum(qac) FROM a)::BIGINT AS sqac, (SELECT sum(laf) FROM a)::BIGINT AS slaf, (SELECT sum(lat) FROM a)::BIGINT AS slat, (SELECT sqef FROM stats)::BIGINT AS sqef, (SELECT sum(qaef) FROM cand)::BIGINT AS sqaef, 0::BIGINT AS smet, 0::BIGINT AS smaet, (SELECT slet FROM stats)::BIGINT AS slet, (SELECT sum(laet) FROM cand)::BIGINT AS slaet",
    "ngram_query_counts": f"WITH {CANDIDATES}, a AS (SELECT alias, max(qat) AS qat FROM (SELECT alias, qat FROM cand UNION ALL SELECT unnest(string_split(alias, ' ')), 1 FROM cand) GROUP BY 1), g AS (SELECT alias, qat FROM a WHERE NOT contains(alias, ' ') UNION ALL SELECT unnest([alias, string_split(alias, ' ')[1], string_split(alias, ' ')[2]]), qat FROM a WHERE contains(alias, ' ')) SELECT alias, sum(qat)::BIGINT AS qat FROM g GROUP BY 1",
    "bogus_counts": f"WITH {CANDIDATES} SELECT count(DISTINCT entity_id) AS bogus, (count(DISTINCT entity_id) + count(DISTINCT alias)) AS aliases FROM cand",
}
