"""Quantization, similarity, clustering and training of vectors.

A table of vectors has a key (word, entity_id, ...) and `vector`, an array of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dequantize, golomb_modulus, natural, norm, quantize
from .mining import cut, docno_assign


def mean_vector(vectors: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """(keys, vector): mean of each group's vectors. One row a vector is summed, and one a group goes to the exchange from each task; size: of the longest vector, else it is looked up."""
    size = vectors.agg(F.max(F.size("vector"))).first()[0] if size is None else size
    means = [F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(max(size or 0, 0))]
    g = vectors.groupBy(*keys).agg(F.lit(0).alias("_0"), *[m.alias(f"_m{i}") for i, m in enumerate(means)])
    return g.select(*keys, F.filter(F.array(*[F.col(f"_m{i}") for i in range(len(means))]) if means else F.array().cast("array<double>"), lambda x: x.isNotNull()).alias("vector")).filter(F.size("vector") > 0)


def query_centroids(words: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(query_id, vector): mean of the vectors of the words of (query_id, words); zeros if none has one."""
    w = words.select("query_id", F.explode("words").alias("word")).join(vectors.select("word", "vector"), "word")
    zeros = F.array_repeat(F.lit(0.0), size)
    return words.select("query_id").join(mean_vector(w, "query_id"), "query_id", "left").select("query_id", F.coalesce("vector", zeros).alias("vector"))


def quantize_table(vectors: DataFrame, q: int) -> DataFrame:
    return vectors.withColumn("vector", quantize(F.col("vector"), q))


def dequantize_table(vectors: DataFrame, q: int) -> DataFrame:
    return vectors.withColumn("vector", dequantize(F.col("vector"), q))


def quantization_error(vectors: DataFrame, q: int | Column) -> DataFrame:
    """One row (error): mean over vectors of the distance to the decoded vector over the norm; zero vectors don't count."""
    v = F.col("vector")
    gone = F.zip_with(v, dequantize(quantize(v, q), q), lambda x, y: x.cast("double") - y)
    return vectors.agg(F.avg(F.when(norm(v) > 0, F.try_divide(norm(gone), norm(v)))).alias("error"))


def quantization_errors(vectors: DataFrame, qs: list[int]) -> DataFrame:
    """(q, error) of several quantizers in one pass."""
    d = vectors.select("vector", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"))
    v = F.col("vector")
    gone = F.zip_with(v, dequantize(quantize(v, F.col("q")), F.col("q")), lambda x, y: x.cast("double") - y)
    return d.groupBy("q").agg(F.avg(F.when(norm(v) > 0, F.try_divide(norm(gone), norm(v)))).alias("error"))


def quantizer_search(vectors: DataFrame, target: float = 0.35, low: int = 1, high: int = 128) -> int:
    """Quantizer found by binary search between low and high; that tried last."""
    q = 0
    # all that the search can ask for, in one pass
    errors = {r.q: r.error for r in quantization_errors(vectors, list(range(low + 1, high))).collect()}
    while high - low > 1:
        q = (low + high) // 2
        if (errors.get(q) or 0.0) > target:
            low = q
        else:
            high = q
    return q


def golomb_moduli(quantized: DataFrame) -> DataFrame:
    """(dim, modulus): Golomb modulus of each dimension of quantized vectors."""
    d = quantized.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.count("*").alias("n"), F.sum((natural(F.col("x")) + 1).cast("bigint")).alias("total"))
    return d.select("dim", golomb_modulus(F.col("n"), F.col("total")).alias("modulus"))


def entity_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b): cosine; 0 where a vector is missing. vectors: word, vector."""
    d = pairs.join(vectors.select(F.col("word").alias("a"), F.col("vector").alias("_va")), "a", "left").join(vectors.select(F.col("word").alias("b"), F.col("vector").alias("_vb")), "b", "left")
    return d.select("a", "b", F.coalesce(cosine(F.col("_va"), F.col("_vb")), F.lit(0.0)).alias("similarity"))


def _phrase_grams(pairs: DataFrame) -> DataFrame:
    w = F.split("phrase", r"\s+")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(i.alias("i"), F.get(w, i).alias("word"), F.lit(False).alias("pair")))
    more = F.transform(F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.concat_ws("_", F.get(w, i - 1), F.get(w, i)).alias("word"), F.lit(True).alias("pair")))
    return pairs.select("entity", "phrase", F.explode(F.concat(grams, more)).alias("g")).select("entity", "phrase", "g.*")


def _met(pairs: DataFrame, vectors: DataFrame, first: bool = True) -> DataFrame:
    g = _phrase_grams(pairs.select("entity", "phrase").distinct())
    g = g if first else g.filter("pair or i > 0")
    words = vectors.select("word", F.col("vector").alias("_w"))
    return g.join(words, "word").join(vectors.select(F.col("word").alias("entity"), F.col("vector").alias("_e")), "entity")


def _all_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    return pairs.select("entity", "phrase").distinct().join(found, ["entity", "phrase"], "left").select("entity", "phrase", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def entity_word_mean(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(entity, phrase, similarity): mean cosine of the entity with the words and word pairs found; 0 for none."""
    return _all_pairs(pairs, _met(pairs, vectors).groupBy("entity", "phrase").agg(F.avg(cosine(F.col("_e"), F.col("_w"))).alias("similarity")))


def entity_word_logistic(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(entity, phrase, similarity): - sum of ln(1 + exp(cosine)) over words from the second on and word pairs; 0 for none."""
    return _all_pairs(pairs, _met(pairs, vectors, False).groupBy("entity", "phrase").agg((-F.sum(F.log1p(F.exp(cosine(F.col("_e"), F.col("_w")))))).alias("similarity")))


def entity_word_centroid(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(entity, phrase, similarity): cosine of the entity with the mean of words from the second on and word pairs; 0 for none."""
    c = mean_vector(_met(pairs, vectors, False).select("entity", "phrase", F.col("_w").alias("vector")), "entity", "phrase")
    d = c.join(vectors.select(F.col("word").alias("entity"), F.col("vector").alias("_e")), "entity")
    return _all_pairs(pairs, d.select("entity", "phrase", cosine(F.col("_e"), F.col("vector")).alias("similarity")))


#: Bytes of centres that are sent to every task at once.
CENTRE_BYTES = 32 << 20
#: Centres that are fetched in one job; more come a part at a time.
_FEW_CENTRES = 1000


def _blocks(centres: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Clusters in order and their unit vectors, in blocks of CENTRE_BYTES; a centre of norm 0 is zeros, one that isn't finite is left out."""
    c = centres.select("cluster", "vector")
    few = c.limit(_FEW_CENTRES + 1).collect()
    rows = iter(sorted(few, key=lambda r: r.cluster)) if len(few) <= _FEW_CENTRES else c.orderBy("cluster").toLocalIterator()
    ids, unit, held = [], [], 0
    for r in rows:
        v = np.array(r.vector, np.float64)
        if np.isfinite(v).all():
            ids.append(r.cluster)
            unit.append(v / (np.linalg.norm(v) or 1.0))
            held += v.nbytes
        if held >= CENTRE_BYTES:
            yield np.array(ids, np.int32), np.stack(unit)
            ids, unit, held = [], [], 0
    if ids:
        yield np.array(ids, np.int32), np.stack(unit)


def _closest(d: DataFrame, ids: np.ndarray, unit: np.ndarray) -> DataFrame:
    """d with the better of its own cluster and closeness and the best of a block of centres."""
    shared = d.sparkSession.sparkContext.broadcast((ids, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        for b in batches:
            v, own = b.column("vector"), pc.fill_null(pc.list_value_length(b.column("vector")), -1).to_numpy(zero_copy_only=False)
            cluster, best = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "closeness"))
            rows = np.flatnonzero(own == unit.shape[1])
            for i in range(0, len(rows), 4096):
                at = rows[i : i + 4096]
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                n = np.linalg.norm(x, axis=1)
                with np.errstate(invalid="ignore"):
                    cos = (x / np.where(n == 0, 1, n)[:, None]) @ unit.T
                cos[np.isnan(cos)] = -np.inf
                k = cos.argmax(1)
                top = cos[np.arange(len(at)), k]
                more = top > best[at]
                cluster[at[more]], best[at[more]] = ids[k[more]], top[more]
            yield pa.RecordBatch.from_arrays([pa.array(cluster) if c == "cluster" else pa.array(best) if c == "closeness" else b.column(c) for c in b.schema.names], b.schema.names)

    return d.mapInArrow(run, d.schema)


def assign_closest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """vectors with the `cluster` whose centre has the greatest cosine, and that as `closeness`; ties to the least cluster; -1 for vectors without a number or of another length. centres: cluster, vector.

    Centres go to the tasks in blocks of CENTRE_BYTES, a pass over the vectors each, so that any number of them will do; no exchange.
    """
    d = vectors.withColumns({"cluster": F.lit(-1), "closeness": F.lit(-1.0)})
    for i, (ids, unit) in enumerate(_blocks(centres)):
        d = _closest(cut(d) if i else d, ids, unit)
    return d


def kmeans_cosine(vectors: DataFrame, k: int, key: str = "word", iterations: int = 100, start: DataFrame | None = None) -> DataFrame:
    """vectors with their cluster, by k-means with cosine; until nothing changes or so many rounds are over.

    start: (key, cluster), else the first k vectors by key are one each and the rest is spread by hash of the key.
    An empty cluster has no centre any more and stays empty.
    """
    if start is None:
        first = docno_assign(vectors.select(key).orderBy(key).limit(k), key).select(key, (F.col("docno") - 1).cast("int").alias("_first"))
        now = vectors.join(first, key, "left").withColumn("cluster", F.coalesce("_first", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))).drop("_first")
    else:
        now = vectors.join(start.select(key, F.col("cluster").cast("int").alias("cluster")), key)
    now = cut(now)
    size = now.agg(F.max(F.size("vector"))).first()[0]
    for _ in range(iterations):
        new = cut(assign_closest(now.withColumnRenamed("cluster", "_old"), mean_vector(now, "cluster", size=size)).drop("closeness"))
        changed = not new.filter("_old <> cluster").isEmpty()
        now = new.drop("_old")
        if not changed:
            break
    return now


def cluster_centroids(clustered: DataFrame) -> DataFrame:
    """(cluster, vector)."""
    return mean_vector(clustered, "cluster")


def cluster_seeded(vectors: DataFrame, words: list[str], iterations: int = 100) -> DataFrame:
    """k-means that starts from the words given: each vector begins with the closest of them."""
    seeds = vectors.filter(F.col("word").isin(*words)).select(F.array_position(F.array(*[F.lit(w) for w in words]), F.col("word")).cast("int").alias("cluster"), "vector").withColumn("cluster", F.col("cluster") - 1)
    start = assign_closest(vectors, seeds).select("word", "cluster")
    return kmeans_cosine(vectors, len(words), iterations=iterations, start=start)


def ordered_clusters(clustered: DataFrame) -> DataFrame:
    return clustered.orderBy("cluster", "word")


def first_vectors(vectors: DataFrame, key: str = "entity", order: str = "ix") -> DataFrame:
    """One vector of each key, the first by `order`."""
    return vectors.groupBy(key).agg(F.min_by("vector", order).alias("vector"))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 10.0, norm_only: bool = False, seed: int = 1234, most: int = 50_000, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of a regularized logistic regression by gradient descent; component 0 isn't regularized. norm_only: the objective that decides on steps leaves out the likelihood. times: how often each row counts, else once."""
    times = np.ones(len(y)) if times is None else times
    c, n = c / 2, float(times.sum())
    w = np.random.default_rng(seed).random(x.shape[1]).astype(np.float32)
    x = x.astype(np.float32)
    alpha, before = 1.0, 100.0
    for _ in range(most):
        g = x.T @ (times * (1 / (1 + np.exp(-np.clip(x @ w, -80, 80))) - y))
        g[1:] += c * w[1:]
        w = (w - alpha * g / n).astype(np.float32)
        now = c / n * float(w @ w)
        if not norm_only:
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -80, 80))), 1e-30, 1 - 1e-7)
            now -= float((times * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum()) / n
        if abs(now - before) < 1e-5:
            break
        if now > before:
            alpha /= 2
        before = now
    return w


def train_entities(descriptions: DataFrame, vectors: DataFrame, rho: int = -1, most_words: int | None = None, c: float = 10.0, norm_only: bool = False, most: int = 50_000) -> DataFrame:
    """(entity, vector): for each entity a regression that tells the vectors of its words from those of others.

    descriptions: entity, words (text). Positives are all of the entity's words with a vector, or the first most_words + 1 of them, each as often as it occurs; negatives, rho or as many as
    positives, are drawn from all other words of the vocabulary alike by a generator of the entity's own; an entity that has every word has none.
    The vocabulary is numbered, a draw is a number, and one join brings the vectors of both.
    """
    numbers = docno_assign(vectors.select("word"), "word")
    known = cut(vectors.select("word", "vector").dropDuplicates(["word"]).join(numbers, "word"))
    size = known.count()
    w = descriptions.select("entity", F.posexplode(F.split("words", r"\s+")).alias("ix", "word")).join(numbers, "word")
    if most_words is not None:
        w = w.withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy("ix"))).filter(F.col("_k") <= most_words + 1)
    # a word that occurs often is one weighted row
    n = w.groupBy("entity", "docno").agg(F.count("*").alias("n"))
    own = n.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("docno", "n"))).alias("p"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for entity, p in zip(b["entity"], b["p"]):
                ids, often = np.array([x["docno"] for x in p], np.int64), np.array([x["n"] for x in p], np.int64)
                free = size - len(ids)
                # of the numbers that are left the u-th: as many higher as the entity has words below
                u = np.random.default_rng(abs(hash_of(entity))).integers(0, free, int(often.sum()) if rho < 0 else rho) if free else np.zeros(0, np.int64)
                drawn, less = np.unique(u + 1 + np.searchsorted(ids - 1 - np.arange(len(ids)), u, "right"), return_counts=True)
                out.append(pd.DataFrame({"entity": entity, "docno": np.r_[ids, drawn], "n": np.r_[often, less].astype(np.int64), "y": np.r_[np.ones(len(ids), np.int32), np.zeros(len(drawn), np.int32)]}))
            if out:
                yield pd.concat(out)

    rows = own.mapInPandas(draw, "entity string, docno long, n long, y int").join(known, "docno").select("entity", "docno", "n", "y", "vector")

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "docno"], ascending=[False, True])
        v = fit_logistic(np.stack([np.asarray(x, np.float32) for x in t["vector"]]), t["y"].to_numpy(float), c, norm_only, most=most, times=t["n"].to_numpy(float))
        return pd.DataFrame({"entity": [t["entity"].iloc[0]], "vector": [v.tolist()]})

    return rows.groupBy("entity").applyInPandas(fit, "entity string, vector array<float>")


def hash_of(s: str) -> int:
    """A number that is the same in every process."""
    out = 1469598103934665603
    for c in s.encode():
        out = ((out ^ c) * 1099511628211) & (2**63 - 1)
    return out
