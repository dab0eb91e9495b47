"""Words and language models of entity types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def words_for_types(candidates: DataFrame, types: DataFrame, repeat_first: bool = False) -> DataFrame:
    """(type, word, freq, is_bigram): clicks of aliases by the words in them and the types of their entities.

    types: entity_id, type_name. repeat_first counts the first word again in place of each later one.
    """
    w = F.split("alias", r"\s+")
    d = candidates.select("entity_id", "qaef", w.alias("w")).join(types.select("entity_id", F.col("type_name").alias("type")), "entity_id")
    pairs = F.transform(F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat_ws("_", F.get("w", i - 1), F.get("w", i)).alias("word"), F.lit(True).alias("is_bigram")))
    singles = F.transform("w", lambda x: F.struct((F.get("w", F.lit(0)) if repeat_first else x).alias("word"), F.lit(False).alias("is_bigram")))
    d = d.select("type", "qaef", F.explode(F.concat(singles, pairs)).alias("x"))
    return d.groupBy("type", F.col("x.word").alias("word"), F.col("x.is_bigram").alias("is_bigram")).agg(F.sum("qaef").alias("freq"))


def language_model(phrases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lm (type, ngram, freq), totals (type, type_freq), background (ngram, bg_freq, total_freq) of (type, freq, words)."""
    grams = phrases.select("type", F.col("freq").cast("bigint").alias("freq"), F.explode(text.trigrams(text.tokens(F.col("words")))).alias("ngram"))
    lm = grams.groupBy("type", "ngram").agg(F.sum("freq").alias("freq"))
    totals = lm.groupBy("type").agg(F.sum("freq").alias("type_freq"))
    background = lm.groupBy("ngram").agg(F.sum("freq").alias("bg_freq")).crossJoin(F.broadcast(totals.agg(F.sum("type_freq").alias("total_freq"))))
    return lm, totals, background


def type_top_words(words: DataFrame, most: int = 5000) -> DataFrame:
    """(type, rank, word, freq): words of a type by falling frequency, `most` of them; ties in the order they came (ix) or of the words."""
    tie = "ix" if "ix" in words.columns else "word"
    w = Window.partitionBy("type").orderBy(F.desc("freq"), tie)
    return words.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("type", "rank", "word", "freq")
