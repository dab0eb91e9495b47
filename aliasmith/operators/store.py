"""The alias table: candidate rows, feature lines, global statistics.

A candidate row is one entity of one alias: alias, qaf qac qat laf lat (of the alias), entity_id
int, type smallint, qef let (of the entity), qaef laet (of both), all counts bigint, and ix, its
place among the alias's entities, which decides ties. Without ix, the order is that of entity_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEP = "\u0001"
ALIAS_COUNTS = ("qaf", "qac", "qat", "laf", "lat")
ENTITY_COUNTS = ("qef", "qaef", "let", "laet")


def with_index(candidates: DataFrame) -> DataFrame:
    if "ix" in candidates.columns:
        return candidates
    return candidates.withColumn("ix", F.row_number().over(Window.partitionBy("alias").orderBy("entity_id")) - 1)


def parse_feature_lines(lines: DataFrame, compat_zero: bool = True) -> DataFrame:
    """Candidate rows of lines (column value). Lines without entities, and those that can't be read, are skipped.

    Fields: alias qaf qac qat maf mat laf lat ate by U+0001, then by tabs for each entity id type
    qef qaef mef maef let laet. What begins with m, and ate, isn't kept.
    """
    parts = F.split(F.col("value"), r"\t+")
    head = F.split(F.get(parts, F.lit(0)), SEP)
    d = lines.select(head.alias("h"), F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("ix", "e"))
    e = F.split("e", SEP)
    n = lambda a, i, t="bigint": F.get(a, F.lit(i)).try_cast(t)
    out = d.filter(F.length("e") > 0).select(
        F.get("h", F.lit(0)).alias("alias"),
        n(F.col("h"), 1).alias("qaf"),
        n(F.col("h"), 2).alias("qac"),
        n(F.col("h"), 3).alias("qat"),
        n(F.col("h"), 6).alias("laf"),
        n(F.col("h"), 7).alias("lat"),
        "ix",
        n(e, 0, "int").alias("entity_id"),
        n(e, 1, "smallint").alias("type"),
        n(e, 2).alias("qef"),
        n(e, 3).alias("qaef"),
        n(e, 6).alias("let"),
        n(e, 7).alias("laet"),
    )
    return out.filter("entity_id is not null and qaf is not null and lat is not null and laet is not null")


def feature_lines(candidates: DataFrame) -> DataFrame:
    """Column value: a feature line for each alias, entities in order of ix; the counts that aren't kept are 1, as the reader drops them."""
    c = with_index(candidates)
    one = F.lit("1")
    entity = F.concat_ws(SEP, "entity_id", "type", "qef", "qaef", one, one, "let", "laet")
    g = c.groupBy("alias", *ALIAS_COUNTS).agg(F.sort_array(F.collect_list(F.struct("ix", entity.alias("e")))).alias("es"))
    head = F.concat_ws(SEP, "alias", "qaf", "qac", "qat", one, one, "laf", "lat", F.size("es"))
    return g.select(F.concat_ws("\t", head, F.array_join(F.col("es.e"), "\t")).alias("value"))


def feature_bag(lines: DataFrame) -> DataFrame:
    """(alias, entities) of (alias, entity) strings: the distinct entity strings of each alias, sorted and tab-separated."""
    return lines.distinct().groupBy("alias").agg(F.array_join(F.sort_array(F.collect_list("entity")), "\t").alias("entities"))


def nested(candidates: DataFrame) -> DataFrame:
    """One row an alias with its entities as array<struct>, and the totals of their priors."""
    c = with_index(candidates)
    g = c.groupBy("alias", *ALIAS_COUNTS).agg(F.sort_array(F.collect_list(F.struct("ix", "entity_id", "type", *ENTITY_COUNTS))).alias("entities"))
    total = lambda k: F.aggregate("entities", F.lit(0).cast("bigint"), lambda s, e: s + e[k])
    return g.select("*", total("qef").alias("prior_clicks"), total("let").alias("prior_links"))


def global_stats(candidates: DataFrame) -> DataFrame:
    """One row of global totals.

    Entity-wide counts are added once for each alias of the entity; sqef once more for each entity. `entities`
    is the greatest id and one, gaps included.
    """
    pairs = candidates.agg(*[F.sum(k).alias(n) for k, n in (("let", "slet"), ("laet", "slaet"), ("qaef", "sqaef"), ("qef", "q1"))], F.count("*").alias("entity_phrase_pairs"), (F.max("entity_id") + 1).cast("bigint").alias("entities"))
    once = candidates.groupBy("entity_id").agg(F.max("qef").alias("qef")).agg(F.sum("qef").alias("q2"))
    aliases = candidates.groupBy("alias").agg(*[F.max(k).alias(k) for k in ALIAS_COUNTS]).agg(*[F.sum(k).alias("s" + k) for k in ALIAS_COUNTS], F.count("*").alias("phrases"))
    d = pairs.crossJoin(F.broadcast(once)).crossJoin(F.broadcast(aliases))
    return d.select("entities", "phrases", "entity_phrase_pairs", "sqaf", "sqat", "sqac", "slaf", "slat", (F.col("q1") + F.col("q2")).alias("sqef"), "sqaef", F.lit(0).cast("bigint").alias("smet"), F.lit(0).cast("bigint").alias("smaet"), "slet", "slaet")


def ngram_query_counts(candidates: DataFrame) -> DataFrame:
    """(alias, qat): of every alias, the queries of all aliases that contain it as a run of tokens, for each place where they do."""
    a = candidates.groupBy("alias").agg(F.max("qat").alias("qat"))
    w = F.split("alias", r"\s+")
    words = a.select("qat", w.alias("w"), F.explode(F.sequence(F.lit(0), F.size(w) - 1)).alias("i"))
    grams = words.select("qat", F.explode(F.transform(F.sequence(F.col("i"), F.size("w") - 1), lambda j: F.array_join(F.slice("w", F.col("i") + 1, j - F.col("i") + 1), " "))).alias("alias"))
    return grams.join(a.select("alias"), "alias", "left_semi").groupBy("alias").agg(F.sum("qat").alias("qat"))


def with_ngram_counts(candidates: DataFrame) -> DataFrame:
    """Candidates with qat replaced by ngram_query_counts."""
    return candidates.drop("qat").join(ngram_query_counts(candidates), "alias")


def bogus_counts(candidates: DataFrame) -> DataFrame:
    """(bogus, aliases): aliases of which all counts are 0, and all aliases."""
    a = candidates.groupBy("alias").agg(*[F.max(k).alias(k) for k in ALIAS_COUNTS])
    zero = F.lit(True)
    for k in ALIAS_COUNTS:
        zero &= F.col(k) == 0
    return a.agg(F.count_if(zero).alias("bogus"), F.count("*").alias("aliases"))


def pruned(candidates: DataFrame, query_threshold: int = 0, link_threshold: int = 0) -> DataFrame:
    """Candidates with more clicks or links than the thresholds. Linking doesn't prune unless this is called."""
    return candidates.filter((F.col("qaef") > query_threshold) | (F.col("laet") > link_threshold))


def with_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """df with the name of its entity_id; null where it has none. names: entity_id, name."""
    return df.join(names.groupBy("entity_id").agg(F.min("name").alias("entity")), "entity_id", "left")
