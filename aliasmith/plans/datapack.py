"""From pages to the alias table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import aggregate, mining


def mine(pages: DataFrame) -> DataFrame:
    """Datapack rows of pages: links to existing pages with redirects followed, counted, and joined with corpus frequencies."""
    # parsed once: links, titles, redirects and content are four readings of it
    pages = mining.cut(mining.spread(pages))
    found = mining.cut(mining.links_resolved(mining.links(pages), pages))
    resolved = mining.follow_redirects(found, mining.redirect_closure(mining.redirects(pages)))
    return mining.datapack(mining.anchor_entity_counts(resolved), mining.alias_corpus_freq(pages, found))


def alias_stats(pack: DataFrame) -> DataFrame:
    """Joined statistics of a datapack: aggregated, computed, numbered, joined."""
    pack = mining.cut(pack)
    counts = aggregate.compute_counts(aggregate.aggregate_counts(pack))
    graph = counts.selectExpr("alias", "alias_freq", "phrase_freq AS alias_total", "entity_id AS entity", "entity_freq", "alias_entity_freq")
    return aggregate.joined_stats(graph, mining.entity_ids(pack))


def candidates(pages: DataFrame) -> DataFrame:
    """Candidate rows mined from pages."""
    return aggregate.candidates_of(alias_stats(mine(pages)))
