"""Mining of alias statistics from linked pages.

A page: page_id, title, ns, text (wiki markup), and what sources.pages adds (is_redirect,
is_disambig, is_stub, ...). Links stay one flat table (source, target, anchor) from parsing to
counts; the entity's map of anchors and the anchor's map of entities are two groupings of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SKIPPED_TITLES = ("Help:", "Wikipedia:", "User:")
LONGEST_NGRAM = 15
_LINK = r"\[\[([^\[\]|:]*)(?:\|([^\[\]]*))?\]\]"


def docno_filter(pages: DataFrame, keep_all: bool = True, share: float = 0.3) -> DataFrame:
    """Pages that get a number: all but some name spaces, or only articles whose title is short against their text."""
    if keep_all:
        keep = F.lit(True)
        for p in SKIPPED_TITLES:
            keep &= ~F.col("title").startswith(p)
        return pages.filter(keep)
    return pages.filter(~F.col("is_redirect") & ~F.col("is_disambig") & (F.col("ns") == 0) & (F.length("text") > 0) & (F.length("title") <= share * F.length("text")))


def docno_assign(pages: DataFrame, column: str = "page_id") -> DataFrame:
    """(column, docno): dense numbers from 1 in order of the distinct ids.

    The ids are sorted in ranges, each range is counted, and each row adds its place in its range to the
    counts before it: no single task sees all rows. The sorted ids are written once, so that both passes see the same ranges.
    """
    spark = pages.sparkSession
    ids = pages.select(column).filter(F.col(column).isNotNull()).distinct()
    path = f"{shared_dir(spark)}/docno-{uuid.uuid4().hex}"
    ids.repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"), F.min(column).alias("least"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return kept.join(F.broadcast(before), "part").select(column, (F.col("before") + within).alias("docno"))


def shared_dir(spark) -> str:  # noqa: ANN001
    """The folder that all executors share, spark.checkpoint.dir; where a session on one machine has none, one under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores at least, for sources of few large parts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def repack(pages: DataFrame, docnos: DataFrame) -> DataFrame:
    """Pages that have a number, with it."""
    return pages.join(docnos, "page_id")


def page_type_counts(pages: DataFrame) -> DataFrame:
    """(type, n): TOTAL, and of the others the first that a page is; STUB is counted within ARTICLE."""
    kind = F.when(F.col("is_redirect"), "REDIRECT").when(F.col("is_disambig"), "DISAMBIGUATION").when(F.length("text") == 0, "EMPTY").when(F.col("ns") == 0, "ARTICLE").otherwise("NON_ARTICLE")
    stub = F.when((kind == "ARTICLE") & F.col("is_stub"), F.lit("STUB"))
    kinds = F.filter(F.array(F.lit("TOTAL"), kind, stub), lambda x: x.isNotNull())
    return pages.select(F.explode(kinds).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def _clean_target(c: Column) -> Column:
    c = text.capitalize_first(F.trim(F.regexp_replace(F.trim(c), "#.*$", "")))
    return F.trim(text.html_unescape_twice(c))


def redirects(pages: DataFrame) -> DataFrame:
    """(source, target) of redirecting pages; sections cut off, empty targets and those to themselves dropped."""
    pattern = r"(?is)#redirect[:\s]*(?:\[\[(.*?)\]\]|([^\n]*))"
    raw = F.when(F.regexp_extract("text", pattern, 1) != "", F.regexp_extract("text", pattern, 1)).otherwise(F.regexp_extract("text", pattern, 2))
    d = pages.filter(F.col("is_redirect")).select(F.col("title").alias("source"), _clean_target(F.split(raw, r"\|")[0]).alias("target"))
    return d.filter((F.length("target") > 0) & (F.col("source") != F.col("target")))


def links(pages: DataFrame) -> DataFrame:
    """(source, target, anchor) of every link [[target|anchor]]; without an anchor the target is one. Anchors are folded, those of fewer than 2 characters dropped; targets with a colon aren't links."""
    d = pages.select(F.col("title").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"\[\[[^\[\]|:]*(?:\|[^\[\]]*)?\]\]"), F.lit(0))).alias("link"))
    target = F.trim(F.regexp_replace(F.regexp_extract("link", _LINK, 1), "#.*$", ""))
    anchor = F.regexp_extract("link", _LINK, 2)
    d = d.select("source", target.alias("t"), F.when(anchor == "", F.regexp_extract("link", _LINK, 1)).otherwise(anchor).alias("a"))
    d = d.select("source", F.trim(text.capitalize_first(text.html_unescape_twice(F.col("t")))).alias("target"), text.fold(text.html_unescape_twice(F.col("a"))).alias("anchor"))
    return d.filter((F.length("anchor") >= 2) & (F.length("target") > 0))


def links_resolved(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to pages that exist, redirects among them."""
    titles = pages.select(text.capitalize_first(F.col("title")).alias("target")).distinct()
    return found.join(titles, "target", "left_semi").select("source", "target", "anchor")


def _ends(edges: DataFrame) -> DataFrame:
    """(source, target) of edges with one target a source, followed to their ends by doubling: after k rounds 2^k steps, so that their number is the logarithm of the longest chain. Chains that end in a circle stop at some page of it."""
    walk, steps, many = edges, 1, edges.count()
    while steps <= many:
        next_ = walk.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        further = cut(walk.join(next_, "target", "left").select("source", F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("_open")))
        if further.filter("_open").isEmpty():
            break
        walk, steps = further.select("source", "target"), 2 * steps
    return walk


def redirect_closure(found: DataFrame) -> DataFrame:
    """(source, target) with redirects followed to their end, however long the chain.

    A chain that comes back to itself ends where the next step would meet a page already seen: from a page
    of the cycle at the page itself, from outside it at the page before the one where it enters twice.
    Of several targets of a source the least counts.
    """
    edges = cut(found.groupBy("source").agg(F.min("target").alias("target")).filter("source <> target"))
    walk = _ends(edges)
    sources = edges.select(F.col("source").alias("target"))
    circle = cut(walk.join(sources, "target", "left_semi").select("target").distinct())
    if circle.isEmpty():
        return walk
    on = circle.select(F.col("target").alias("source"))
    ended = walk.join(sources, "target", "left_anti").select("source", "target")
    # chains into a circle end where they enter it, and that has one page before it on the circle
    enter = _ends(edges.join(on, "source", "left_anti")).join(circle, "target", "left_semi")
    before = edges.join(on, "source", "left_semi").select("target", F.col("source").alias("_before"))
    outside = enter.join(before, "target").select("source", F.col("_before").alias("target"))
    return ended.unionByName(outside).unionByName(on.select("source", F.col("source").alias("target")))


def follow_redirects(found: DataFrame, closed: DataFrame) -> DataFrame:
    """Links with targets replaced by the ends of their redirects."""
    ends = closed.select(F.col("source").alias("target"), F.col("target").alias("_end"))
    return found.join(ends, "target", "left").select("source", F.coalesce("_end", "target").alias("target"), "anchor")


def anchor_entity_counts(found: DataFrame) -> DataFrame:
    """(anchor, entity, n)."""
    return found.groupBy("anchor", F.col("target").alias("entity")).agg(F.count("*").alias("n"))


def entity_map(counts: DataFrame) -> DataFrame:
    """(entity, anchors): map of anchor to count."""
    return counts.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("anchor", "n")))).alias("anchors"))


def anchor_map(counts: DataFrame) -> DataFrame:
    """(anchor, entities): map of entity to count."""
    return counts.groupBy("anchor").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", "n")))).alias("entities"))


def content_ngrams(pages: DataFrame, longest: int = LONGEST_NGRAM) -> DataFrame:
    """Column alias: runs of up to `longest` tokens of the folded content; the first and the last token take no part, as a run lies between two spaces."""
    w = F.split(text.fold(text.plain_text(F.col("text"))), " ")
    inner = pages.select(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))).alias("w")).filter(F.size("w") > 0)
    if longest == 1:
        return inner.select(F.explode("w").alias("alias"))
    # runs of one length at a time, inside the array: no row carries the words of its page along
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(longest))), of_length)
    return inner.select(F.explode(F.flatten(runs)).alias("alias"))


def alias_corpus_freq(pages: DataFrame, found: DataFrame, longest: int | None = None) -> DataFrame:
    """(alias, cf): links with this anchor, and its occurrences in the content of all pages. Runs longer than the longest anchor aren't made."""
    vocabulary = found.select(F.col("anchor").alias("alias")).distinct()
    if longest is None:
        longest = min(LONGEST_NGRAM, vocabulary.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1)
    # runs that are no anchor go before anything is counted; the vocabulary is broadcast while its size allows it
    grams = content_ngrams(pages, longest).join(vocabulary, "alias", "left_semi").groupBy("alias").agg(F.count("*").alias("n"))
    anchors = found.groupBy(F.col("anchor").alias("alias")).agg(F.count("*").alias("n"))
    return grams.unionByName(anchors).groupBy("alias").agg(F.sum("n").alias("cf"))


def datapack(counts: DataFrame, freqs: DataFrame) -> DataFrame:
    """(alias, phrase_freq, alias_freq, entity_id, alias_entity_freq) of anchors that have a corpus frequency, their case aside; short ones, and numbers seen once, are dropped. Entities are url-encoded."""
    total = F.sum("n").over(Window.partitionBy("anchor"))
    d = counts.withColumn("alias_freq", total).join(freqs.select(F.lower("alias").alias("_key"), F.col("cf").alias("phrase_freq")), F.lower("anchor") == F.col("_key"))
    d = d.filter((F.length(F.trim("anchor")) >= 2) & ~(text.is_number(F.col("anchor")) & (F.col("alias_freq") < 2)))
    return d.select(F.col("anchor").alias("alias"), "phrase_freq", "alias_freq", text.encode(F.replace("entity", F.lit(" "), F.lit("_"))).alias("entity_id"), F.col("n").alias("alias_entity_freq"))


def datapack_ngrams(pack: DataFrame) -> DataFrame:
    """Every run of tokens of every alias with the counts of the whole."""
    w = F.split("alias", " ")
    d = pack.select("*", w.alias("w"), F.explode(F.sequence(F.lit(0), F.size(w) - 1)).alias("i"))
    gram = F.explode(F.transform(F.sequence(F.col("i"), F.size("w") - 1), lambda j: F.array_join(F.slice("w", F.col("i") + 1, j - F.col("i") + 1), " ")))
    return d.select(gram.alias("ngram"), "phrase_freq", "alias_freq", "entity_id", "alias_entity_freq").withColumnRenamed("ngram", "alias")


def entity_ids(pack: DataFrame) -> DataFrame:
    """(entity, entity_id): distinct entities numbered from 1 in dictionary order, which looks at letters, digits and blanks only, then at the whole."""
    d = pack.select(F.col("entity_id").alias("entity")).distinct().withColumn("k", F.struct(F.regexp_replace("entity", "[^A-Za-z0-9 \t]", "").alias("a"), F.col("entity").alias("b")))
    return docno_assign(d, "k").select(F.col("k.b").alias("entity"), F.col("docno").alias("entity_id"))
