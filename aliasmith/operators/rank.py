"""Ranking of candidates: the best of each alias or span, the best k, whole result lists.

NaN and -Infinity never beat another score. Ties go to the lower ix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import NIL_ID
from .store import with_index

LEAST = -1.7976931348623157e308


def scored(candidates: DataFrame, stats: DataFrame, ranker: Column) -> DataFrame:
    """Candidates with ix and score; stats: the one row of store.global_stats."""
    s = stats.select("entities", "sqef", "slet")
    return with_index(candidates).crossJoin(F.broadcast(s)).withColumn("score", ranker).drop("entities", "sqef", "slet")


def top1(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Best row of each group by score: keys, entity_id, score and the columns in `more`. Where no score counts, that of ix 0 with the least double."""
    counts = ~F.isnan("score") & (F.col("score") > LEAST)
    order = F.when(counts, F.struct("score", (-F.col("ix")).alias("ix")))
    fields = F.struct("entity_id", *more)
    g = rows.groupBy(*keys).agg(F.max_by(fields, order).alias("b"), F.min_by(fields, "ix").alias("f"), F.max(F.when(counts, F.col("score"))).alias("score"))
    e = F.coalesce("b", "f")
    return g.select(*keys, *[e[k].alias(k) for k in ("entity_id", *more)], F.coalesce("score", F.lit(LEAST)).alias("score"))


def topk(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each group by falling score, then ix; with their place from 1 as rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "ix")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def results(spans: DataFrame, threshold: float) -> DataFrame:
    """Spans that link to an entity with a score above the threshold, ranked within their query: by falling score, then from right to left."""
    d = spans.filter((F.col("entity_id") != NIL_ID) & (F.col("score") > threshold) & ~F.isnan("score"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("start"))))


def greedy(rows: DataFrame, k: int) -> DataFrame:
    """First k results of each query over all its spans; of those whose score isn't NaN, k of each span at most. Ties: the span further left, then the shorter, then ix."""
    per_span = topk(rows, ["query_id", "start", "end"], k).filter(~F.isnan("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "start", "end", "ix")
    return per_span.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def survivors(rows: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """The `most` candidates of each group with the greatest prior, for a second phase of scoring."""
    w = Window.partitionBy(*keys).orderBy(F.desc("prior"), "ix")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def keep_first(lists: Column) -> Column:
    """First element of an array, null if it is empty."""
    return F.get(lists, F.lit(0))
