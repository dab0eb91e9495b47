"""Queries of the vector operators, over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as fn
from ..operators import embedding as op
from ..sources import files
from .fixtures import ENTITY_VECTORS, WORD_VECTORS, entity_vectors, table, word_vectors

Q = 40


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), "label", F.col("embedding").alias("vector"))


def inner_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one of its number."""
    v = _table(spark, sf_dir)
    d = v.join(v.select((F.col("word") - 1).alias("word"), F.col("vector").alias("other")), "word")
    return d.select("word", F.round(fn.inner(F.col("vector"), F.col("other")), 6).alias("inner_product"), F.round(fn.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"))


def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op.mean_vector(_table(spark, sf_dir), "label").select("label", F.posexplode("vector").alias("k", "x"))
    return d.select("label", "k", F.round("x", 6).alias("x"))


def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quantize_table(_table(spark, sf_dir), Q).select("word", F.posexplode("vector").alias("k", "x"))


def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op.dequantize_table(op.quantize_table(_table(spark, sf_dir), Q), Q).select("word", F.posexplode("vector").alias("k", "x"))
    return d.select("word", "k", F.round("x", 6).alias("x"))


def quant_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quantization_errors(_table(spark, sf_dir), [10, 20, 40, 80]).select("q", F.round("error", 6).alias("error"))


def quant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(op.quantizer_search(_table(spark, sf_dir), 0.1),)], "q int")


def golomb_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = op.quantize_table(_table(spark, sf_dir), Q)
    return v.select("word", F.round(fn.golomb_bits(F.col("vector")), 4).alias("bits"))


def golomb_moduli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.golomb_moduli(op.quantize_table(_table(spark, sf_dir), Q))


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as lines and parsed again."""
    d = files.vectors(files.vector_lines(op.quantize_table(_table(spark, sf_dir), Q)))
    return d.select(F.col("word").cast("bigint").alias("word"), F.posexplode("vector").alias("k", "x")).select("word", "k", F.col("x").cast("int").alias("x"))


def _all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_vectors(spark, sf_dir).unionByName(entity_vectors(spark, sf_dir).select(F.concat(F.lit("_wiki_"), "entity_id").alias("word"), "vector"))


def entity_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.concat(F.lit("_wiki_"), F.substring("p_brand", 7, 9)).alias("a")).distinct()
    pairs = e.crossJoin(e.select(F.col("a").alias("b")).union(spark.createDataFrame([("nobody",)], "b string")))
    return op.entity_similarity(pairs, _all_words(spark, sf_dir)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("_wiki_"), F.substring("p_brand", 7, 9)).alias("entity"), F.col("p_name").alias("phrase")).distinct()


def _phrase_query(scorer):  # noqa: ANN001, ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scorer(_phrases(spark, sf_dir), _all_words(spark, sf_dir)).select("entity", "phrase", F.round("similarity", 6).alias("similarity"))

    return query


def assign_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector to the nearest of the mean vectors of the labels."""
    v = _table(spark, sf_dir)
    centres = op.mean_vector(v, "label").select(F.col("label").alias("cluster"), "vector")
    return op.assign_closest(v.select("word", "vector"), centres).select("word", "cluster", F.round("closeness", 6).alias("closeness"))


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings, starting from their labels."""
    v = _table(spark, sf_dir)
    d = op.kmeans_cosine(v.select("word", "vector"), 10, start=v.select("word", F.col("label").alias("cluster")))
    return d.select("word", "cluster")


def train_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of brands from the words of the names of their parts."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.array_join(F.sort_array(F.collect_list("p_name")), " ").alias("words"))
    return op.train_entities(p, word_vectors(spark, sf_dir), rho=32)


def first_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op.first_vectors(_table(spark, sf_dir).withColumnRenamed("word", "ix"), "label").select("label", F.posexplode("vector").alias("k", "x"))
    return d.select("label", "k", F.round(F.col("x").cast("double"), 6).alias("x"))


def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of the embeddings by their label, in long form."""
    d = op.cluster_centroids(_table(spark, sf_dir).select(F.col("label").alias("cluster"), "vector"))
    return d.select("cluster", F.posexplode("vector").alias("k", "x")).select("cluster", "k", F.round("x", 6).alias("x"))


QUERIES = {
    "inner_cosine": inner_cosine,
    "centroid": centroid,
    "quantize": quantize,
    "dequantize": dequantize,
    "quant_error": quant_error,
    "quant_search": quant_search,
    "golomb_bits": golomb_bits,
    "golomb_moduli": golomb_moduli,
    "vector_lines": vector_lines,
    "entity2entity": entity_similarity,
    "entity2word": _phrase_query(op.entity_word_mean),
    "entity2word_logistic": _phrase_query(op.entity_word_logistic),
    "entity2word_centroid": _phrase_query(op.entity_word_centroid),
    "assign_closest": assign_closest,
    "kmeans_cosine": kmeans,
    "train_lr": train_entities,
    "first_vector": first_vectors,
    "calculate_centroids": cluster_centroids,
}

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = f"{_DOT} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}))"
_FLAT = "flat AS (SELECT vec_id AS word, label, unnest(range(64))::INT AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_QUANT = _FLAT + f", q AS (SELECT word, k, x, trunc(x * {Q})::INT AS n FROM flat)"
_VECTORS = f"{WORD_VECTORS}, {ENTITY_VECTORS}, av AS (SELECT word, vector FROM wv UNION ALL SELECT '_wiki_' || entity_id, vector FROM ev)"
_PHRASES = "ph AS (SELECT DISTINCT '_wiki_' || substr(p_brand, 7) AS entity, p_name AS phrase FROM part)"
_HIT = f"g AS (SELECT entity, phrase, unnest(string_split(phrase, ' ')) AS word, unnest([1, 2]) AS i FROM ph), hit AS (SELECT entity, phrase, i, {_COS.format('e.vector', 'w.vector')} AS c, w.vector AS wvec, e.vector AS evec FROM g JOIN av w ON w.word = g.word JOIN av e ON e.word = g.entity)"


def _errors(qs: str) -> str:
    return f"d AS (SELECT word, qq, sqrt(sum((x - (trunc(x * qq) + 0.5 * sign(trunc(x * qq))) / qq) ** 2)) / sqrt(sum(x * x)) AS e FROM flat CROSS JOIN (SELECT unnest({qs})::INT AS qq) GROUP BY ALL), er AS (SELECT qq AS q, avg(e) AS error FROM d GROUP BY 1)"


SQL = {
    "calculate_centroids": f"WITH {_FLAT} SELECT label AS cluster, k, round(avg(x), 6) AS x FROM flat GROUP BY ALL",
    "inner_cosine": f"SELECT a.vec_id AS word, round({_DOT.format('a.embedding', 'b.embedding')}, 6) AS inner_product, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "centroid": f"WITH {_FLAT} SELECT label, k, round(avg(x), 6) AS x FROM flat GROUP BY ALL",
    "quantize": f"WITH {_QUANT} SELECT word, k, n AS x FROM q",
    "dequantize": f"WITH {_QUANT} SELECT word, k, round((n + 0.5::DOUBLE * sign(n)) / {Q}, 6) AS x FROM q",
    "quant_error": f"WITH {_FLAT}, {_errors('[10, 20, 40, 80]')} SELECT q, round(error, 6) AS error FROM er",
    "quant_search": f"WITH RECURSIVE {_FLAT}, {_errors('range(2, 128)')}, s AS (SELECT 1 AS low, 128 AS high, 0 AS q UNION ALL SELECT CASE WHEN error > 0.1 THEN er.q ELSE low END, CASE WHEN error > 0.1 THEN high ELSE er.q END, er.q FROM s JOIN er ON er.q = (low + high) // 2 WHERE high - low > 1) SELECT q::INT AS q FROM s WHERE high - low <= 1",
    "golomb_bits": f"WITH {_QUANT}, nat AS (SELECT word, CASE WHEN n >= 0 THEN 2 * n ELSE -(2 * n + 1) END::DOUBLE AS x FROM q), t AS (SELECT word, sum(x) AS s, count(*)::DOUBLE / sum(x) AS f FROM nat GROUP BY 1), m AS (SELECT word, ceil(ln(2 - f) / -ln(1 - f)) AS m FROM t), b AS (SELECT word, m, ceil(ln(m)) AS b FROM m) SELECT word, round(sum(x / m + 1 + CASE WHEN x < 2 ** b - m THEN b - 1 ELSE b END), 4) AS bits FROM nat JOIN b USING (word) GROUP BY 1",
    "golomb_moduli": f"WITH {_QUANT}, t AS (SELECT k AS dim, count(*)::DOUBLE / sum(CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END + 1) AS f FROM q GROUP BY 1) SELECT dim, CASE WHEN f < 1 THEN ceil(ln(2 - f) / -ln(1 - f)) ELSE 0 END::INT AS modulus FROM t",
    "vector_lines": f"WITH {_QUANT} SELECT word, k, n AS x FROM q",
    "entity2entity": f"WITH {_VECTORS}, a AS (SELECT DISTINCT '_wiki_' || substr(p_brand, 7) AS a FROM part), p AS (SELECT a.a, b.b FROM a CROSS JOIN (SELECT a AS b FROM a UNION ALL SELECT 'nobody') b) SELECT p.a, p.b, round(coalesce({_COS.format('x.vector', 'y.vector')}, 0), 6) AS similarity FROM p LEFT JOIN av x ON x.word = p.a LEFT JOIN av y ON y.word = p.b",
    "entity2word": f"WITH {_VECTORS}, {_PHRASES}, {_HIT}, s AS (SELECT entity, phrase, avg(c) AS s FROM hit GROUP BY ALL) SELECT entity, phrase, round(coalesce(s, 0), 6) AS similarity FROM ph LEFT JOIN s USING (entity, phrase)",
    "entity2word_logistic": f"WITH {_VECTORS}, {_PHRASES}, {_HIT}, s AS (SELECT entity, phrase, -sum(ln(1 + exp(c))) AS s FROM hit WHERE i > 1 GROUP BY ALL) SELECT entity, phrase, round(coalesce(s, 0), 6) AS similarity FROM ph LEFT JOIN s USING (entity, phrase)",
    "entity2word_centroid": f"WITH {_VECTORS}, {_PHRASES}, {_HIT}, s AS (SELECT entity, phrase, c AS s FROM hit WHERE i > 1) SELECT entity, phrase, round(coalesce(s, 0), 6) AS similarity FROM ph LEFT JOIN s USING (entity, phrase)",
    "assign_closest": f"WITH {_FLAT}, m AS (SELECT label AS cluster, list(x ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS x FROM flat GROUP BY ALL) GROUP BY 1), s AS (SELECT vec_id AS word, cluster, {_COS.format('embedding', 'c')} AS s FROM embeddings CROSS JOIN m) SELECT word, cluster, round(s, 6) AS closeness FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, cluster) AS k FROM s) WHERE k = 1",
    "first_vector": f"WITH {_FLAT} SELECT label, k, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY label, k ORDER BY word) AS r FROM flat) WHERE r = 1",
}
