"""Linking of queries and texts.

What doesn't depend on the query is computed once: the best entity of every alias under a ranker
without context. Linking is then one equi-join of the queries' spans with that table, which the
optimizer broadcasts or shuffles by its size, and a fold over each query's few matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import coherence, context, mining, rank, segment, store

GRID_THRESHOLD = -6.0


def best_entities(candidates: DataFrame, ranker: Column | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(alias, entity_id, type, score): the best entity of each alias."""
    rows = rank.scored(candidates, store.global_stats(candidates) if stats is None else stats, scoring.probability() if ranker is None else ranker)
    return rank.top1(rows, ["alias"], "type")


def written(df: DataFrame) -> DataFrame:
    """df written once, as it is read several times; a stream stays as it is."""
    return df if df.isStreaming else mining.cut(df)


def matches(words: DataFrame, aliases: DataFrame, longest: int | None = None) -> DataFrame:
    """Spans of the queries that are aliases, with all columns of the alias table."""
    return segment.spans(words, segment.longest_alias(aliases) if longest is None else longest).join(aliases, "alias")


def link(queries: DataFrame, best: DataFrame, threshold: float, textbook: bool = False, longest: int | None = None) -> DataFrame:
    """(query_id, rank, alias, start, end, entity_id, score): entities of (query_id, text) whose segment scores above the threshold."""
    return segment.segment_aliases(segment.tokenized(queries), written(best), longest, textbook, True, threshold).select("query_id", "rank", "alias", "start", "end", "entity_id", "score")


def link_max(queries: DataFrame, best: DataFrame, threshold: float) -> DataFrame:
    """link by the greatest segment score, without tokens that only name a site."""
    return segment.segment_max_aliases(segment.tokenized(queries, text.SITE_STOPWORDS), written(best), threshold)


def _top(candidates: DataFrame, k: int, ranker: Column | None) -> DataFrame:
    rows = rank.scored(candidates, store.global_stats(candidates), scoring.probability() if ranker is None else ranker)
    return written(rank.topk(rows, ["alias"], k).select("alias", "entity_id", "type", "ix", "score", "rank"))


def all_candidates(queries: DataFrame, candidates: DataFrame, k: int, ranker: Column | None = None) -> DataFrame:
    """(query_id, start, end, alias, entity_id, ix, score, rank): the best k entities of every span that is an alias. Ranked once an alias, not once a span."""
    return matches(segment.tokenized(queries), _top(candidates, k, ranker))


def link_greedy(queries: DataFrame | segment.Pieces, candidates: DataFrame, k: int, ranker: Column | None = None) -> DataFrame:
    """(query_id, start, end, alias, entity_id, type, ix, score, rank): the first k entities of each query over all its spans."""
    top, words = _top(candidates, k, ranker), queries if isinstance(queries, segment.Pieces) else segment.tokenized(queries)
    found = segment.greedy_aliases(words, top, k)
    return rank.greedy(matches(segment.rows_of(words), top).drop("rank"), k) if found is None else found


def link_contextual(queries: DataFrame, candidates: DataFrame, context, threshold: float, survivors: int = 1000) -> DataFrame:  # noqa: ANN001
    """link with the contextual ranker: candidates of each span, the `survivors` best by prior, scored with the words of the query.

    context(pairs, words) gives (query_id, entity_id, context) of the pairs.
    """
    words = written(segment.tokenized(queries))
    # the prior doesn't depend on the query: candidates are cut before they meet the spans
    kept = _survivors(candidates, survivors)
    met = written(matches(words, kept))
    scores = context(met.select("query_id", "entity_id").distinct(), words)
    met = met.join(scores, ["query_id", "entity_id"])
    met = met.withColumn("score", scoring.contextual(F.col("end") - F.col("start"), F.col("context"), F.col("prior")))
    top = rank.top1(met, ["query_id", "start", "end"], "type")
    return rank.results(segment.segment(words, top), threshold)


def link_centroid(queries: DataFrame, candidates: DataFrame, vectors: DataFrame, entities: DataFrame, threshold: float, survivors: int = 1000) -> DataFrame:
    """link_contextual with the centroid of the query's words. Tables small enough go to the tasks, and what a query meets never leaves its task."""
    words = segment.tokenized(queries)
    kept = _survivors(candidates, survivors)
    found = context.linked_by_centroid(words, kept, vectors, entities, threshold)
    if found is not None:
        return found
    return link_contextual(queries, candidates, lambda pairs, words: context.centroid_score(pairs, context.bag_of_words(words, vectors), entities), threshold, survivors)


def _survivors(candidates: DataFrame, survivors: int) -> DataFrame:
    rows = rank.scored(candidates, store.global_stats(candidates), scoring.contextual_prior()).withColumnRenamed("score", "prior")
    return written(rank.survivors(rows, ["alias"], survivors).select("alias", "entity_id", "type", "ix", "prior"))


def grid(lines: DataFrame, best: DataFrame, names: DataFrame, types: DataFrame, threshold: float = GRID_THRESHOLD, last_column: bool = False) -> DataFrame:
    """(type, query, intent, entity, n): distinct results of linking lines (column value), their first or last tab-separated column; the best entity of each, its type or NF, and what else the query asks.

    names: entity_id, entity (url-encoded); types: entity, type_name.
    """
    parts = F.split("value", "\t")
    q = F.trim(F.replace(text.normalize(F.element_at(parts, -1) if last_column else F.get(parts, F.lit(0))), F.lit("+"), F.lit(" ")))
    # equal queries are linked once
    queries = lines.select(q.alias("text")).filter("text <> ''").distinct().withColumn("query_id", F.col("text"))
    top = link(queries, best, threshold).filter("rank = 1").join(names, "entity_id").join(types, "entity", "left")
    d = top.select(F.coalesce("type_name", F.lit("NF")).alias("type"), F.col("query_id").alias("query"), text.intent_part(F.col("query_id"), F.col("entity")).alias("intent"), "entity")
    return d.distinct().withColumn("n", F.lit(1))


def surface_candidates(mentions: DataFrame, candidates: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """(surface, k, entity_id, entity): the k best entities of each distinct surface that has any, numbered from 0. A written table. mentions: anything with their surfaces; names: see text_candidates."""
    q = mentions.select(F.trim("surface").alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    got = link_greedy(q, candidates, k).join(names, "entity_id").select(F.col("query_id").alias("surface"), "rank", "entity_id", text.decode(F.col("entity")).alias("entity"))
    # an entity without a name leaves no gap
    return mining.cut(got.select("surface", (F.row_number().over(_by("surface", "rank")) - 1).alias("k"), "entity_id", "entity"))


def text_candidates(mentions: DataFrame | coherence.Mentions, candidates: DataFrame, names: DataFrame, k: int = 10, surfaces: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, surface, place, k, entity_id, entity): the k best entities of each mention that has any; place: of the mention among these in its document.

    mentions: doc_id, pos, surface, of several of a place the least; names: entity_id, entity (url-encoded); surfaces: those of the mentions among others, where they can be had without the mentions.
    Mentions are placed before their candidates come in: in the tasks if they come as lines, else by a window.
    """
    c = surface_candidates(coherence.rows_of(mentions) if surfaces is None else surfaces, candidates, names, k)
    if isinstance(mentions, coherence.Mentions):
        return coherence.in_places(mentions, c).join(c, "surface").select("doc_id", "pos", "surface", "place", "k", "entity_id", "entity")
    m = coherence.placed(mentions).join(c.select("surface").distinct(), "surface", "left_semi").withColumn("place", F.dense_rank().over(_by("doc_id", "pos")))
    return m.join(c, "surface").select("doc_id", "pos", "surface", "place", "k", "entity_id", "entity")


def link_texts(mentions: DataFrame | coherence.Mentions, candidates: DataFrame, names: DataFrame, vectors: DataFrame, k: int = 10, direction: str = "forward", surfaces: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, surface, entity_id, entity): one entity for each mention of a document so that neighbours agree; the first candidate where the path leaves a mention out, null where it has none. See text_candidates; direction: as in coherence.choose."""
    return coherence.resolved(mentions, surface_candidates(coherence.rows_of(mentions) if surfaces is None else surfaces, candidates, names, k), vectors, direction).select("doc_id", "pos", "surface", "entity_id", "entity")


def _by(keys, order):  # noqa: ANN001, ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)
