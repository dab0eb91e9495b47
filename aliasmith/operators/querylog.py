"""Annotated query logs and relevance judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLAGS = ("adult", "ambiguous", "assessor", "cannot-judge", "navigational", "no-wp", "non-english", "quote-question")
_QUERY = "struct<" + ",".join(f"`_{f}`:string" for f in FLAGS) + ",_starttime:string,text:string,annotation:array<struct<_main:string,target:string,span:string>>>"
SCHEMA = f"_id string, query array<{_QUERY}>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a log in XML."""
    return spark.read.format("xml").option("rowTag", "session").schema(SCHEMA).load(path)


def parse_sessions(lines: DataFrame) -> DataFrame:
    """Sessions of lines (column value) that hold one <session> each."""
    return lines.select(F.from_xml("value", SCHEMA, {"rowTag": "session"}).alias("s")).select("s.*")


def _flag(name: str) -> Column:
    return F.coalesce(F.lower(F.col("q")[f"_{name}"]) == "true", F.lit(False)).alias(name.replace("-", "_"))


def log_queries(sessions: DataFrame) -> DataFrame:
    """(session_id, number, text, flags, start_time, annotations): queries of each session numbered from 1."""
    d = sessions.select(F.col("_id").alias("session_id"), F.posexplode_outer("query").alias("n", "q")).filter("q is not null")
    return d.select("session_id", (F.col("n") + 1).alias("number"), F.trim("q.text").alias("text"), *[_flag(f) for f in FLAGS], F.col("q._starttime").alias("start_time"), F.col("q.annotation").alias("annotations"))


def query_spans(queries: DataFrame) -> DataFrame:
    """(session_id, number, text, span, tag, main, start, end, level): annotations, of each query one a tag, the first; tags `not found` and spans of one character don't count. start is -1 where the query doesn't hold the span."""
    d = queries.select("session_id", "number", "text", F.posexplode("annotations").alias("n", "a"))
    d = d.select("session_id", "number", "text", "n", F.trim("a.span").alias("span"), F.trim("a.target").alias("tag"), F.coalesce(F.lower("a._main") == "true", F.lit(False)).alias("main"))
    d = d.filter((F.length("span") > 1) & (F.lower("tag") != "not found") & (F.length("tag") > 0))
    first = F.row_number().over(Window.partitionBy("session_id", "number", "tag").orderBy("n"))
    d = d.withColumn("_first", first).filter("_first = 1")
    start = (F.instr("text", F.col("span")) - 1).cast("int")
    return d.select("session_id", "number", "text", "span", "tag", "main", start.alias("start"), F.when(start >= 0, start + F.length("span")).otherwise(F.lit(-1)).alias("end"), F.lit(1).alias("level"))


def not_navigational(queries: DataFrame) -> DataFrame:
    return queries.filter(~F.col("navigational"))


def qrels(spans: DataFrame) -> DataFrame:
    """Column value: `session-number Q0 tag 1` of each span."""
    return spans.select(F.concat_ws(" ", F.concat_ws("-", "session_id", "number"), F.lit("Q0"), F.replace("tag", F.lit(" "), F.lit("_")), F.lit("1")).alias("value"))


def query_lines(queries: DataFrame) -> DataFrame:
    """Column value: `session-number TAB text`."""
    return queries.select(F.concat_ws("\t", F.concat_ws("-", "session_id", "number"), "text").alias("value"))


def with_label(results: DataFrame, judged: DataFrame) -> DataFrame:
    """results (query, entity, ...) with the label of the judgment; NF where there is none."""
    j = judged.groupBy("query", "entity").agg(F.min("label").alias("label"))
    return results.join(j, ["query", "entity"], "left").withColumn("label", F.coalesce("label", F.lit("NF")))
