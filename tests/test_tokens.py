"""Tokens of texts with long runs of separators, and of texts without tokens."""

from pyspark.sql import functions as F

from aliasmith.functions import text


def test_separators_of_any_length(spark):
    gap = F.repeat(F.lit("- ·\U00010330"), 100_000)
    d = spark.range(1).select(F.concat(F.lit("AÉİ"), gap, F.lit("b2"), gap).alias("t"))
    assert d.select(text.tokens(F.col("t"))).first()[0] == ["aéi", "b2"]


def test_texts_without_tokens(spark):
    d = spark.createDataFrame([("",), (" \U00010330!",), (None,), ("x",)], "t string")
    assert [r[0] for r in d.select(text.tokens(F.col("t"))).collect()] == [[], [], None, ["x"]]
