"""Tab-separated and line formats. What can't be read as its type is null, as in the loaders that these stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_number
from ..operators.store import SEP

COUNTS = "alias string, phrase_freq long, alias_freq long, entity_id string, alias_entity_freq long"
AGGREGATED = "alias string, alias_freq long, phrase_freq long, entity_id string, entity_freq long, alias_entity_freq long"
ENTITY_IDS = "entity string, entity_id string"
GRAPH = "alias string, alias_freq long, alias_total long, entity string, entity_freq long, alias_entity_freq long"
TYPES = "type_id short, type_name string"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """Column value, a line each; compression: none, gzip, zstd, ..."""
    df.select("value").write.option("compression", compression).text(path)


def write_table(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """A table for later runs, compressed by pages."""
    df.write.option("compression", compression).parquet(path)


def write_aliases(candidates: DataFrame, path: str, buckets: int | None = None) -> None:
    """Alias table sorted by alias within files, so that lookups skip row groups; one exchange."""
    d = candidates.repartition(buckets, "alias") if buckets else candidates.repartition("alias")
    d.sortWithinPartitions("alias").write.parquet(path)


def write_datapack(pack: DataFrame, path: str, flat_path: str | None = None) -> None:
    """The nested table, a row an alias, and if asked for the flat one as tab-separated lines."""
    pack.groupBy("alias", "phrase_freq", "alias_freq").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "alias_entity_freq"))).alias("entities")).write.parquet(path)
    if flat_path:
        write_tsv(pack, flat_path)


def flatten_bag(c: Column) -> Column:
    """A printed bag {(a),(b)} as a TAB b."""
    return F.regexp_replace(F.regexp_replace(c, r"^\{\(|\)\}$", ""), r"\),\(", "\t")


def _fields(lines: DataFrame, sep: str = "\t") -> DataFrame:
    return lines.select(F.split("value", sep).alias("f"))


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def entity_names(lines: DataFrame) -> DataFrame:
    """(entity_id, name) of lines `name TAB id`; of several names of an id the last in the order of names."""
    d = _fields(lines).select(_at(1).try_cast("int").alias("entity_id"), _at(0).alias("name"))
    return d.filter("entity_id is not null").groupBy("entity_id").agg(F.max("name").alias("name"))


def type_names(lines: DataFrame) -> DataFrame:
    """(type_id, type_name) of lines `id TAB name`."""
    return _fields(lines).select(_at(0).try_cast("smallint").alias("type_id"), _at(1).alias("type_name")).filter("type_id is not null")


def entity_types(lines: DataFrame) -> DataFrame:
    """(entity, type): the third field with spaces as _, and the fourth."""
    return _fields(lines).select(F.replace(_at(2), F.lit(" "), F.lit("_")).alias("entity"), _at(3).alias("type")).filter("entity is not null and type is not null")


def judgments(lines: DataFrame) -> DataFrame:
    """(query, entity, label, location, relevant) of lines with a header; lines whose second field is a number are skipped."""
    d = _fields(lines).filter(~is_number(_at(1))).select(_at(0).alias("query"), _at(1).alias("entity"), _at(2).alias("label"), _at(3).alias("location"))
    return d.filter("query <> 'query'").withColumn("relevant", is_relevant(F.col("label")))


def is_relevant(label: Column) -> Column:
    return ~F.lower(label).isin("bad", "fair")


def vectors(lines: DataFrame, sep: str = r"\t") -> DataFrame:
    """(word, vector) of lines of a word and its numbers; a header of two numbers or fewer isn't a vector."""
    d = lines.select(F.split("value", sep).alias("f")).filter(F.size("f") > 2)
    return d.select(_at(0).alias("word"), F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda x: x.try_cast("float")).alias("vector"))


def vector_lines(quantized: DataFrame) -> DataFrame:
    """Column value: word and whole numbers of (word, vector), tab-separated."""
    return quantized.select(F.concat_ws("\t", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), "\t")).alias("value"))


def word_list(lines: DataFrame, trim: bool = True) -> DataFrame:
    """Column word: lines, trimmed and without empty ones, or as they are."""
    d = lines.select((F.trim("value") if trim else F.col("value")).alias("word"))
    return d.filter("word <> ''") if trim else d


def type_phrases(lines: DataFrame) -> DataFrame:
    """(type, freq, words) of lines `type TAB (freq,words),(freq,words)`; frequencies cut to whole numbers."""
    d = _fields(lines).select(_at(0).alias("type"), F.explode(F.split(F.regexp_replace(_at(1), r"^\(|\)$", ""), r"\),\(")).alias("p"))
    part = F.split("p", ",", 2)
    return d.select("type", F.get(part, F.lit(0)).try_cast("double").cast("bigint").alias("freq"), F.get(part, F.lit(1)).alias("words"))


def type_words(lines: DataFrame) -> DataFrame:
    """(type, word, freq) of lines `type TAB word U+0001 freq ...`."""
    d = lines.select(F.split("value", "\t").alias("f")).select(_at(0).alias("type"), F.posexplode(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0)))).alias("ix", "w"))
    part = F.split("w", SEP)
    return d.select("type", "ix", F.get(part, F.lit(0)).alias("word"), F.get(part, F.lit(1)).try_cast("bigint").alias("freq"))
