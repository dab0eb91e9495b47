"""Scores of entities against the words of a query.

words: (query_id, word, n), the bag of words of each query that have a vector. Vectors: (word,
vector) and (entity_id, vector). The result of a scorer is (query_id, entity_id, context) for the
pairs asked for; an entity without a vector, or a query without words, has the least context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import ln
from ..functions.scoring import LEAST_CONTEXT
from ..functions.vectors import cosine, inner, norm
from . import batch, rank, segment

#: The least single-precision number.
NO_CONTEXT = -3.4028234663852886e38
TYPE_DEFAULT = -50.0
MU_TYPE = 1000.0


def empty() -> Column:
    return F.lit(0.0)


def bag_of_words(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, word, n, vector) of the context words of (query_id, words) that have a vector."""
    w = words.select("query_id", F.explode(text.context_words(F.col("words"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("n"))
    return w.join(vectors.select("word", "vector"), "word")


def centroids(bag: DataFrame, size: int | None = None) -> DataFrame:
    """(query_id, centroid): the sum of the words' vectors by their counts, as one array. A query is one row from each task; size: of the longest vector, else it is looked up."""
    size = bag.agg(F.max(F.size("vector"))).first()[0] if size is None else size
    sums = [F.sum(F.col("n") * F.get("vector", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(max(size or 0, 0))]
    g = bag.groupBy("query_id").agg(F.lit(0).alias("_0"), *sums)
    whole = F.filter(F.array(*[F.col(f"_s{i}") for i in range(len(sums))]) if sums else F.array().cast("array<double>"), lambda x: x.isNotNull())
    return g.select("query_id", whole.alias("centroid")).filter(F.size("centroid") > 0)


def _size(vectors: DataFrame) -> int | None:
    return vectors.agg(F.max(F.size("vector"))).first()[0]


def _with_entities(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    return pairs.select("query_id", "entity_id").distinct().join(entities.select("entity_id", F.col("vector").alias("entity_vector")), "entity_id", "left")


def centroid_score(pairs: DataFrame, bag: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity vector times the centroid, over the centroid's norm; NaN if that is 0."""
    d = _with_entities(pairs, entities).join(centroids(bag, _size(entities)), "query_id", "left")
    n = norm(F.col("centroid"))
    score = F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(inner(F.col("entity_vector"), F.col("centroid")), n))
    return d.select("query_id", "entity_id", F.coalesce(score, F.lit(NO_CONTEXT)).alias("context"))


def _summed(pairs: DataFrame, bag: DataFrame, entities: DataFrame, term: Column) -> DataFrame:
    d = _with_entities(pairs, entities).join(bag, "query_id", "left")
    return d.groupBy("query_id", "entity_id").agg(F.sum(F.col("n") * term).alias("context")).select("query_id", "entity_id", F.coalesce(-F.col("context"), F.lit(NO_CONTEXT)).alias("context"))


def logistic_score(pairs: DataFrame, bag: DataFrame, entities: DataFrame) -> DataFrame:
    """- sum of n ln(1 + exp(-w e))."""
    return _summed(pairs, bag, entities, F.log1p(F.exp(-inner(F.col("vector"), F.col("entity_vector")))))


def biased_logistic_score(pairs: DataFrame, bag: DataFrame, entities: DataFrame) -> DataFrame:
    """- sum of n ln(1 + exp(w e + bias)); the last component of the entity's vector is the bias."""
    e, size = F.col("entity_vector"), F.size("vector")
    return _summed(pairs, bag, entities, F.log1p(F.exp(inner(F.col("vector"), F.slice(e, F.lit(1), size)) + F.element_at(e, -1).cast("double"))))


def query_normalizer(bag: DataFrame) -> DataFrame:
    """(query_id, normalizer): - sum of n ln(1 + exp(w w)); 1 where that is 0."""
    d = bag.groupBy("query_id").agg((-F.sum(F.col("n") * F.log1p(F.exp(inner(F.col("vector"), F.col("vector")))))).alias("x"))
    return d.select("query_id", F.when(F.col("x") == 0, F.lit(1.0)).otherwise(F.col("x")).alias("normalizer"))


def cosine_score(pairs: DataFrame, words: DataFrame, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """Cosine of the entity's vector and the mean of the words' vectors, stop words left out; 0 where either is missing."""
    w = words.select("query_id", F.explode("words").alias("word")).filter(~F.col("word").isin(*text.CENTROID_STOPWORDS)).groupBy("query_id", "word").agg(F.count("*").alias("n"))
    d = _with_entities(pairs, entities).join(centroids(w.join(vectors.select("word", "vector"), "word"), _size(vectors)), "query_id", "left")
    return d.select("query_id", "entity_id", F.coalesce(cosine(F.col("entity_vector"), F.col("centroid")), F.lit(0.0)).alias("context"))


def type_score(pairs: DataFrame, words: DataFrame, lm: DataFrame, totals: DataFrame, background: DataFrame) -> DataFrame:
    """(query_id, type, context) of (query_id, type): sum over the query's n-grams that the type's language model knows of the smoothed log-probability; -50 for none.

    lm: type, ngram, freq; totals: type, type_freq; background: ngram, bg_freq, total_freq.
    """
    grams = words.select("query_id", F.explode(text.trigrams(F.col("words"))).alias("ngram"))
    hit = pairs.select("query_id", "type").distinct().join(grams, "query_id").join(lm, ["type", "ngram"]).join(totals, "type").join(background, "ngram")
    p = ln(F.try_divide(F.col("freq") + F.lit(MU_TYPE) * F.try_divide(F.col("bg_freq").cast("double"), F.col("total_freq").cast("double")), F.col("type_freq") + F.lit(MU_TYPE)))
    s = hit.groupBy("query_id", "type").agg(F.sum(p).alias("s"))
    d = pairs.select("query_id", "type").distinct().join(s, ["query_id", "type"], "left")
    return d.select("query_id", "type", F.when(F.coalesce("s", F.lit(0.0)) == 0, F.lit(TYPE_DEFAULT)).otherwise(F.col("s")).alias("context"))


# The same of (query_id, words): where the tables are small, a query is one row of its words and what is asked for, from which its scores come in one step.
# pairs: None for what the Pieces given as words ask.


class _Bag:
    """Words of the rows of a batch that have a number: row, number."""

    def __init__(self, words: pa.Array, names: pa.Array, sizes: list[int], stop: pa.Array | None = None) -> None:
        lens = batch.lengths(words)
        flat, (row, place) = words.flatten(), batch.within(lens)
        rows, ids = [], []
        for n in sizes:
            at = np.flatnonzero(lens[row] - place >= n)
            found = np.array(batch.looked_up(batch.joined(flat, at, n, "_"), names))
            if stop is not None:
                found[batch.looked_up(flat, stop) >= 0] = -1
            rows.append(row[at][found >= 0])
            ids.append(found[found >= 0])
        row, number = (np.concatenate(x) for x in (rows, ids))
        order = np.argsort(row, kind="stable")
        self.row, self.number, self.rows = row[order], number[order], len(lens)
        self.count = np.bincount(row, minlength=self.rows).astype(np.int64)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of the rows of table of the words of each row."""
        out = np.zeros((self.rows, table.shape[1]))
        has = np.flatnonzero(self.count)
        if len(has):
            out[has] = np.add.reduceat(table[self.number], batch.starts(self.count)[has], axis=0)
        return out

    def pair_sums(self, row: np.ndarray, what: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Sum of table[word, what] over the words of row."""
        pair, at = batch.expanded(batch.starts(self.count)[row], self.count[row])
        return np.bincount(pair, table[self.number[at], what[pair]], minlength=len(row))


def _asked(pairs: DataFrame, words: DataFrame, column: str) -> DataFrame:
    """(query_id, words, asked): one row a query that something is asked of, asked: structs of the distinct values."""
    asked = pairs.groupBy("query_id").agg(F.collect_set(F.struct(column)).alias("asked"))
    return asked.join(words.select("query_id", "words"), "query_id", "left").select("query_id", "words", "asked")


def _scored_in_rows(pairs: DataFrame | None, words: DataFrame | segment.Pieces, column: str, score: Callable[[pa.Array, np.ndarray, pa.Array], np.ndarray]) -> DataFrame:
    """(query_id, column, context): score gives the context of the values asked of rows, from words, rows and values."""
    whole = isinstance(words, segment.Pieces) and pairs is None
    kind = lambda c: (words.rows if whole else pairs).schema[c].dataType.simpleString()
    kinds = f"query_id {kind('query_id')}, {column} {kind(column)}, context double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = batch.within(batch.lengths(b.column("asked")))[0]
            value = pc.struct_field(b.column("asked").flatten(), column)
            with np.errstate(all="ignore"):
                context = score(b.column("words"), row, value)
            yield pa.RecordBatch.from_pydict({"query_id": b.column("query_id").take(pa.array(row)), column: value, "context": pa.array(context, pa.float64())})

    if whole:
        between = words.between
        return words.rows.mapInArrow(lambda batches: run(segment.put_together(batches, between, column)), kinds)
    return _asked(pairs, segment.rows_of(words), column).mapInArrow(run, kinds)


def _joinable(pairs: DataFrame | None, words: DataFrame | segment.Pieces) -> tuple[DataFrame, DataFrame]:
    return words.pairs() if pairs is None else pairs, segment.rows_of(words)


def _tables(vectors: DataFrame, entities: DataFrame, more: int = 0) -> tuple | None:
    """Words, their vectors, entities and theirs, all small and of one length, entities `more` longer."""
    w, e = batch.small_vectors(vectors, "word"), batch.small_vectors(entities, "entity_id")
    return None if w is None or e is None or w[1].shape[1] + more != e[1].shape[1] else (*w, *e)


#: Words of a context word: itself, or with the one before.
_CONTEXT_SIZES = [1, 2]


def _centroid(bag: _Bag, vectors: np.ndarray, row: np.ndarray, entity: np.ndarray, entities: np.ndarray) -> np.ndarray:
    """centroid_score of entities (-1: without a vector) of rows."""
    c = bag.sums(vectors)
    n = np.sqrt((c * c).sum(1))[row]
    out = np.einsum("ij,ij->i", c[row], entities[entity]) / np.where(n == 0, np.nan, n)
    out[(n == 0)] = np.nan
    out[((entity < 0) & (n != 0)) | (bag.count[row] == 0)] = NO_CONTEXT
    return out


def _contexts(bag: _Bag, vectors: np.ndarray, row: np.ndarray, what: np.ndarray, vector: np.ndarray, entities: np.ndarray) -> np.ndarray:
    """_centroid of many entities of rows; vector: place of the vector of each. Few entities are compared once with every row, else those that a row asks for."""
    if bag.rows * len(vector) <= batch.CELLS:
        c = bag.sums(vectors)
        n = np.sqrt((c * c).sum(1))[:, None]
        every = np.stack([np.einsum("ij,j->i", c, entities[i]) for i in vector], 1) / np.where(n == 0, np.nan, n)
        every[((vector < 0)[None, :] & (n != 0)) | (bag.count == 0)[:, None]] = NO_CONTEXT
        return every[row, what]
    asked, back = np.unique(row * len(vector) + what, return_inverse=True)
    return _centroid(bag, vectors, asked // len(vector), vector[asked % len(vector)], entities)[back]


def _first_greatest(of: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of the first greatest value of each group; a group's values lie together."""
    if not len(of):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    top = np.repeat(np.maximum.reduceat(value, first), np.diff(np.r_[first, len(of)]))
    hit = np.flatnonzero(value == top)
    return hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]


def centroid_of_words(pairs: DataFrame | None, words: DataFrame | segment.Pieces, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """centroid_score."""
    t = _tables(vectors, entities)
    if t is None:
        pairs, words = _joinable(pairs, words)
        return centroid_score(pairs, bag_of_words(words, vectors), entities)
    shared = words.sparkSession.sparkContext.broadcast(t)

    def score(words: pa.Array, row: np.ndarray, value: pa.Array) -> np.ndarray:
        names, v, ids, e = shared.value
        return _centroid(_Bag(words, names, _CONTEXT_SIZES), v, row, batch.looked_up(value, ids), e)

    return _scored_in_rows(pairs, words, "entity_id", score)


def cosine_of_words(pairs: DataFrame | None, words: DataFrame | segment.Pieces, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """cosine_score."""
    t = _tables(vectors, entities)
    if t is None:
        return cosine_score(*_joinable(pairs, words), vectors, entities)
    shared = words.sparkSession.sparkContext.broadcast((*t, pa.array(text.CENTROID_STOPWORDS, pa.string())))

    def score(words: pa.Array, row: np.ndarray, value: pa.Array) -> np.ndarray:
        names, v, ids, e, stop = shared.value
        bag, entity = _Bag(words, names, [1], stop), batch.looked_up(value, ids)
        c = bag.sums(v)
        d = np.sqrt((e * e).sum(1))[entity] * np.sqrt((c * c).sum(1))[row]
        out = np.einsum("ij,ij->i", c[row], e[entity]) / np.where(d == 0, 1.0, d)
        out[(entity < 0) | (bag.count[row] == 0) | (d == 0)] = 0.0
        return out

    return _scored_in_rows(pairs, words, "entity_id", score)


def _logistic_in_rows(pairs: DataFrame | None, words: DataFrame | segment.Pieces, t: tuple, terms: np.ndarray) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast((t[0], t[2], terms))

    def score(words: pa.Array, row: np.ndarray, value: pa.Array) -> np.ndarray:
        names, ids, terms = shared.value
        bag, entity = _Bag(words, names, _CONTEXT_SIZES), batch.looked_up(value, ids)
        out = -bag.pair_sums(row, entity, terms)
        out[(entity < 0) | (bag.count[row] == 0)] = NO_CONTEXT
        return out

    return _scored_in_rows(pairs, words, "entity_id", score)


def _fits(rows: int, columns: int) -> bool:
    return 8 * rows * columns <= batch.LOCAL_BYTES


def logistic_of_words(pairs: DataFrame | None, words: DataFrame | segment.Pieces, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """logistic_score."""
    t = _tables(vectors, entities)
    if t is None or not _fits(len(t[0]), len(t[2])):
        pairs, words = _joinable(pairs, words)
        return logistic_score(pairs, bag_of_words(words, vectors), entities)
    with np.errstate(over="ignore"):
        return _logistic_in_rows(pairs, words, t, np.log1p(np.exp(-(t[1] @ t[3].T))))


def biased_of_words(pairs: DataFrame | None, words: DataFrame | segment.Pieces, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """biased_logistic_score."""
    t = _tables(vectors, entities, 1)
    if t is None or not _fits(len(t[0]), len(t[2])):
        pairs, words = _joinable(pairs, words)
        return biased_logistic_score(pairs, bag_of_words(words, vectors), entities)
    with np.errstate(over="ignore"):
        return _logistic_in_rows(pairs, words, t, np.log1p(np.exp(t[1] @ t[3][:, :-1].T + t[3][:, -1])))


def normalizer_of_words(words: DataFrame | segment.Pieces, vectors: DataFrame) -> DataFrame:
    """query_normalizer."""
    t = batch.small_vectors(vectors, "word")
    if t is None:
        return query_normalizer(bag_of_words(segment.rows_of(words), vectors))
    with np.errstate(over="ignore"):
        shared = words.sparkSession.sparkContext.broadcast((t[0], np.log1p(np.exp((t[1] * t[1]).sum(1)))[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms = shared.value
        for b in batches:
            bag = _Bag(b.column("words"), names, _CONTEXT_SIZES)
            x = -bag.sums(terms)[:, 0]
            has = np.flatnonzero(bag.count)
            yield pa.RecordBatch.from_pydict({"query_id": b.column("query_id").take(pa.array(has)), "normalizer": pa.array(np.where(x == 0, 1.0, x)[has], pa.float64())})

    return segment.mapped(words, run, f"query_id {segment.key_of(words)}, normalizer double")


def types_of_words(pairs: DataFrame | None, words: DataFrame | segment.Pieces, lm: DataFrame, totals: DataFrame, background: DataFrame) -> DataFrame:
    """type_score."""
    p = ln(F.try_divide(F.col("freq") + F.lit(MU_TYPE) * F.try_divide(F.col("bg_freq").cast("double"), F.col("total_freq").cast("double")), F.col("type_freq") + F.lit(MU_TYPE)))
    t = batch.small(lm.join(totals, "type").join(background, "ngram").select("type", "ngram", p.alias("p")))
    ids, names = (pc.unique(t.column(c)) for c in ("type", "ngram")) if t is not None else (None, None)
    if t is None or not _fits(len(ids), len(names)):
        return type_score(*_joinable(pairs, words), lm, totals, background)
    # sums, as an n-gram that a model has twice counts twice
    terms = np.zeros((len(names), len(ids)))
    np.add.at(terms, (batch.looked_up(batch.column(t, "ngram"), names), batch.looked_up(batch.column(t, "type"), ids)), batch.numbers(batch.column(t, "p"), 0.0))
    shared = words.sparkSession.sparkContext.broadcast((ids, names, terms))

    def score(words: pa.Array, row: np.ndarray, value: pa.Array) -> np.ndarray:
        ids, names, terms = shared.value
        bag, kind = _Bag(words, names, [1, 2, 3]), batch.looked_up(value, ids)
        out = bag.pair_sums(row, kind, terms) if len(names) else np.zeros(len(row))
        out[(kind < 0) | (out == 0)] = TYPE_DEFAULT
        return out

    return _scored_in_rows(pairs, words, "type", score)


def linked_by_centroid(words: DataFrame, kept: DataFrame, vectors: DataFrame, entities: DataFrame, threshold: float) -> DataFrame | None:
    """(query_id, rank, start, end, entity_id, score): plans.link_contextual with centroid_score, where the tables are small; else None. kept: alias, entity_id, type, ix, prior, an alias's entities once."""
    t = _tables(vectors, entities)
    k = batch.small(kept.filter("alias is not null").select("alias", "entity_id", "ix", F.col("prior").cast("double").alias("prior"))) if t is not None else None
    if k is None:
        return None
    names = pc.unique(k.column("alias"))
    of, ix = batch.looked_up(batch.column(k, "alias"), names), batch.numbers(batch.column(k, "ix"), 0)
    order = np.lexsort((ix, of))
    count = np.bincount(of, minlength=len(names)).astype(np.int64)
    number = batch.numbers(batch.column(k, "entity_id"), -1).astype(np.int64)[order]
    prior = batch.numbers(batch.column(k, "prior"), np.nan)[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        # each entity once, and its vector by number
        ids, one = np.unique(number, return_inverse=True)
        shared = words.sparkSession.sparkContext.broadcast((*t, names, batch.gram_sizes(names), batch.starts(count)[:-1], count, ids, one, np.log(prior)))
    key = words.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v, vector_of, e, names, sizes, first, count, ids, one, log_prior = shared.value
        vector = batch.looked_up(pa.array(ids, vector_of.type), vector_of)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                words = part.column("words")
                with np.errstate(all="ignore"):
                    row, start, end, at = batch.grams(words, names, sizes, " ")
                    of, at = batch.expanded(first[at], count[at])
                    context = _contexts(_Bag(words, known, _CONTEXT_SIZES), v, row[of], one[at], vector, e)
                    f32 = np.maximum(context.astype(np.float32), np.float32(LEAST_CONTEXT)).astype(np.float64)
                    f32[np.isnan(context)] = np.nan
                    bonus = (1.0 / (1.0 + np.exp(-((end - start).astype(np.float64) - 1)))).astype(np.float32).astype(np.float64)
                    score = f32 + log_prior[at] + bonus[of]
                # the best of each span, the first of equals; where none counts, the first with the least double
                counts = ~np.isnan(score) & (score > rank.LEAST)
                order = _first_greatest(of, np.where(counts, score, -np.inf))
                best = (row[of[order]], start[of[order]], end[of[order]], ids[one[at[order]]], np.where(counts[order], score[order], rank.LEAST))
                found = batch.fold(batch.lengths(words), *best)
                found, more = segment.ranked_results(found, {}, threshold)
                yield segment.out(part, *found, **more)

    return words.filter(F.size("words") > 0).select("query_id", "words").mapInArrow(run, f"query_id {key}, start int, end int, entity_id int, score double, rank int")
