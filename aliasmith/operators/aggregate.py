"""From mined (alias, entity) counts to the joined statistics of aliases and entities.

counts: alias, phrase_freq, alias_freq, entity_id, alias_entity_freq. Rows with an empty or null
name or a frequency that isn't positive are dropped. Sums are grouped per grain once and joined on
the grouping key, so that an exchange by alias serves the group, the join and the next group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import importance
from .mining import cut


def valid_counts(df: DataFrame, names: tuple[str, ...], freqs: tuple[str, ...]) -> DataFrame:
    """Rows whose names aren't empty and whose frequencies are positive; null fails."""
    keep = F.lit(True)
    for c in names:
        keep &= F.length(c) > 0
    for c in freqs:
        keep &= F.col(c) > 0
    return df.filter(keep)


def normalized_counts(counts: DataFrame, fold_marks: bool = True) -> DataFrame:
    """Valid distinct rows with the alias normalized, the original as ori_alias."""
    d = valid_counts(counts, ("alias", "entity_id"), ("phrase_freq", "alias_freq", "alias_entity_freq"))
    d = d.select(F.col("alias").alias("ori_alias"), text.normalize_text(F.col("alias"), fold_marks).alias("alias"), "phrase_freq", "alias_freq", "entity_id", "alias_entity_freq")
    return d.filter("length(ori_alias) > 0 and length(alias) > 0").distinct()


def alias_entity_totals(feat: DataFrame) -> DataFrame:
    return feat.groupBy("entity_id", "alias").agg(F.sum("alias_entity_freq").alias("alias_entity_freq"))


def alias_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("alias").agg(F.sum("alias_entity_freq").alias("alias_freq"))


def entity_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("entity_id").agg(F.sum("alias_entity_freq").alias("entity_freq"))


def phrase_totals(feat: DataFrame) -> DataFrame:
    """Phrase frequency of an alias: that of its distinct original forms together."""
    return feat.select("ori_alias", "alias", "phrase_freq").distinct().groupBy("alias").agg(F.sum("phrase_freq").alias("phrase_freq"))


def phrase_rescaled(feat: DataFrame) -> DataFrame:
    """Phrase frequency in proportion to the links that are left of the alias."""
    share = F.try_divide(F.sum("alias_entity_freq").cast("double"), F.max("alias_freq").cast("double"))
    return feat.groupBy("alias").agg(F.ceil(share * F.max("phrase_freq").cast("double")).cast("bigint").alias("phrase_freq"))


_COLUMNS = ["alias", "alias_freq", "phrase_freq", "entity_id", "entity_freq", "alias_entity_freq"]


def _totalled(pairs: DataFrame) -> DataFrame:
    """pairs with the totals of their alias and entity, by windows: an exchange each, and no second reading of the pairs."""
    total = lambda k: F.sum("alias_entity_freq").over(Window.partitionBy(k))
    return pairs.withColumn("entity_freq", total("entity_id")).withColumn("alias_freq", total("alias"))


def aggregate_counts(counts: DataFrame, fold_marks: bool = True) -> DataFrame:
    """(alias, alias_freq, phrase_freq, entity_id, entity_freq, alias_entity_freq) of normalized aliases."""
    feat = normalized_counts(counts, fold_marks)
    return _totalled(alias_entity_totals(feat)).join(phrase_totals(feat), "alias").select(*_COLUMNS)


def compute_counts(aggregated: DataFrame) -> DataFrame:
    """The same columns, summed again from aggregated rows, phrase frequencies rescaled. One pass: what phrase_rescaled needs of an alias is carried along its pairs."""
    feat = valid_counts(aggregated, ("alias", "entity_id"), ("alias_freq", "phrase_freq", "entity_freq", "alias_entity_freq")).distinct()
    pairs = feat.groupBy("entity_id", "alias").agg(F.sum("alias_entity_freq").alias("alias_entity_freq"), F.max("alias_freq").alias("_af"), F.max("phrase_freq").alias("_pf"))
    w = Window.partitionBy("alias")
    share = F.try_divide(F.sum("alias_entity_freq").over(w).cast("double"), F.max("_af").over(w).cast("double"))
    return _totalled(pairs).withColumn("phrase_freq", F.ceil(share * F.max("_pf").over(w).cast("double")).cast("bigint")).select(*_COLUMNS)


def grand_totals(joined: DataFrame) -> DataFrame:
    """One row: totals of distinct aliases, phrases, entities and pairs."""
    joined = cut(joined)
    a = joined.select("alias", "alias_freq", "phrase_freq").distinct().agg(F.sum("alias_freq").alias("alias_total"), F.sum("phrase_freq").alias("phrase_total"))
    e = joined.select("entity_id", "entity_freq").distinct().agg(F.sum("entity_freq").alias("entity_total"))
    p = joined.select("alias", "entity_id", "alias_entity_freq").distinct().agg(F.sum("alias_entity_freq").alias("alias_entity_total"))
    return a.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(p))


def with_totals(joined: DataFrame) -> DataFrame:
    """Rows with the grand totals beside them; the totals are one row."""
    return joined.crossJoin(F.broadcast(grand_totals(joined)))


def first_entity_id(ids: DataFrame) -> DataFrame:
    """(entity, entity_id): of several ids of an entity the least, as strings."""
    return valid_counts(ids, ("entity", "entity_id"), ()).groupBy("entity").agg(F.min(F.col("entity_id").cast("string")).alias("entity_id"))


def entity_total(pairs: DataFrame) -> DataFrame:
    """Distinct entities of each alias."""
    return pairs.select("alias", "entity").distinct().groupBy("alias").agg(F.count("*").alias("entity_total"))


def _zero(*names: str) -> list[Column]:
    return [F.lit(0).cast("bigint").alias(n) for n in names]


def joined_stats(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """Statistics of every (alias, entity) with a known id.

    graph: alias, alias_freq, alias_total, entity, entity_freq, alias_entity_freq. Search and alternative search counts have no source
    and are 0; left joins and defaults stay where they'd come in.
    """
    # written once, as entities, aliases and pairs are three readings of it
    g = cut(valid_counts(graph, ("alias", "entity"), ("alias_freq", "alias_total", "entity_freq", "alias_entity_freq")).distinct())
    known = g.select("entity").distinct().join(first_entity_id(ids), "entity", "left").withColumn("entity_id", F.coalesce("entity_id", F.lit("0"))).filter("entity_id <> '0'")
    entities = known.join(g.groupBy("entity").agg(F.max("entity_freq").alias("graph_entity_freq")), "entity", "left").select("entity", "entity_id", F.lit(1).cast("smallint").alias("type_id"), F.lit("Entity").alias("type"), *_zero("search_entity_freq", "alt_entity_freq"), F.coalesce("graph_entity_freq", F.lit(0)).alias("graph_entity_freq"))
    aliases = g.groupBy("alias").agg(F.max("alias_freq").alias("graph_alias_freq"), F.max("alias_total").alias("graph_total")).select("alias", *_zero("search_alias_freq", "search_clicks", "search_total", "alt_alias_freq", "alt_total"), F.coalesce("graph_alias_freq", F.lit(0)).alias("graph_alias_freq"), F.coalesce("graph_total", F.lit(0)).alias("graph_total"))
    pairs = g.groupBy("alias", "entity").agg(F.max("alias_entity_freq").alias("graph_alias_entity_freq"))
    pairs = pairs.join(entity_total(pairs), "alias").select("alias", "entity", "entity_total", *_zero("search_alias_entity_freq", "alt_alias_entity_freq"), "graph_alias_entity_freq")
    return pairs.join(entities, "entity").join(aliases, "alias")


def with_importance(stats: DataFrame) -> DataFrame:
    """Joined statistics with the link-importance features."""
    return stats.select("*", *[c.alias(k) for k, c in importance().items()])


def candidates_of(stats: DataFrame) -> DataFrame:
    """Candidate rows (see operators.store) of joined statistics."""
    return stats.select(
        "alias",
        F.col("search_alias_freq").alias("qaf"),
        F.col("search_clicks").alias("qac"),
        F.col("search_total").alias("qat"),
        F.col("graph_alias_freq").alias("laf"),
        F.col("graph_total").alias("lat"),
        F.col("entity_id").cast("int").alias("entity_id"),
        F.col("type_id").alias("type"),
        F.col("search_entity_freq").alias("qef"),
        F.col("search_alias_entity_freq").alias("qaef"),
        F.col("graph_entity_freq").alias("let"),
        F.col("graph_alias_entity_freq").alias("laet"),
    )
