"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the relative frequencies of its hashed byte n-grams (lower-cased
UTF-8), each scaled by the log ratio of its share in toxic and in clean training texts; a
logistic regression over them is trained on labelled documents. It is fitted on at most
TRAIN_ROWS labelled documents, those of the least hash of doc_id, and applied to every document.

Null and empty texts and texts shorter than the least n-gram have no n-grams: their score is
that of the intercept alone, and they are never rejected. Labels that are null, or whose doc_id
has no document, are not used; of several labels of a document the greatest counts, of several texts of a doc_id the
least is learned from. With no
labels of either class every score is 0 and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import cut, slices

ORDERS = (3, 4, 5)
BITS = 18
#: Bound of the labelled sample that the classifier is fitted on.
TRAIN_ROWS = 2500
SMOOTH = 1.0
L2 = 1e-6
STEPS = 120
#: N-grams in fewer training texts, or whose log-count ratio is nearer 0, keep the weight 0.
LEAST_TEXTS, LEAST_RATIO = 3, 0.7

_M = np.uint32(2654435761)


def grams(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed n-grams of the buffer, and whether each lies within one row."""
    n = len(buf)
    inside = np.ones(n + 1, bool)
    inside[offs[1:-1]] = False
    h = buf.astype(np.uint32)
    ok = np.ones(n, bool)
    for k in range(1, max(ORDERS)):
        if n <= k:
            return
        h = h[: n - k] * np.uint32(0x01000193) + buf[k:]
        ok = ok[: n - k] & inside[k:n]
        if k + 1 in ORDERS:
            yield ((h ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * _M) >> np.uint32(32 - BITS), ok


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    trained: bool

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of toxicity of each row."""
        rows = len(offs) - 1
        total, count = np.zeros(rows), np.zeros(rows)
        for h, ok in grams(buf, offs):
            w = np.where(ok, self.weights[h], np.float32(0))
            for out, x in ((total, w), (count, ok)):
                c = np.zeros(len(x) + 1)
                np.cumsum(x, out=c[1:])
                end = np.minimum(offs, len(x))
                out += c[end[1:]] - c[end[:-1]]
        z = self.intercept + np.divide(total, count, out=np.zeros(rows), where=count > 0)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p if self.trained else np.zeros(rows)

    def empty(self, offs: np.ndarray) -> np.ndarray:
        return np.diff(offs) < min(ORDERS)


def _of_rows(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashed n-grams of each row and their counts."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(offs) - 1)]
    for h, ok in grams(buf, offs):
        for i, p in enumerate(parts):
            a, b = offs[i], min(offs[i + 1], len(h))
            if b > a:
                p.append(h[a:b][ok[a:b]])
    for p in parts:
        yield np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic texts of the task each n-gram is; of n-gram -1, how many texts have any."""
    n, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for rows, buf, offs in slices(batches):
        for toxic, (ids, _) in zip(rows.column("toxic").to_pylist(), _of_rows(buf, offs)):
            n[toxic][ids] += 1
            texts[toxic] += len(ids) > 0
    some = np.flatnonzero(n.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[texts[0], n[0][some]]), pa.array(np.r_[texts[1], n[1][some]])], ["gram", "clean", "toxic"])


def ratios(gram: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-count ratio of every n-gram; 0 where it has no say. The first is -1, for all texts."""
    out = np.zeros(1 << BITS)
    r = np.log((SMOOTH + toxic[1:]) / (2 * SMOOTH + toxic[0])) - np.log((SMOOTH + clean[1:]) / (2 * SMOOTH + clean[0]))
    r[(clean[1:] + toxic[1:] < LEAST_TEXTS) | (np.abs(r) < LEAST_RATIO)] = 0
    out[gram[1:]] = r
    return out


def fit(x: list[tuple[np.ndarray, np.ndarray]], r: np.ndarray, toxic: np.ndarray) -> Model:
    """x: of each text the n-grams that have a ratio, and their share in the text; toxic: 0 or 1 each."""
    y = toxic.astype(np.float64)
    row = np.repeat(np.arange(len(x), dtype=np.int32), [len(c) for c, _ in x])
    if not len(row):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, False)
    cols, vals = np.concatenate([c for c, _ in x]), np.concatenate([v for _, v in x]).astype(np.float64)
    names, cols = np.unique(cols, return_inverse=True)
    r, size = r[names], len(names)
    # frequencies are small: one unit for all brings the features near 1
    unit = 1 / (np.sqrt(np.bincount(row, (vals * r[cols]) ** 2, len(x)).mean()) + 1e-12)
    f = vals * r[cols] * unit
    w, b = np.zeros(size), 0.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    m = v = np.zeros(size)
    mb = vb = 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(row, f * w[cols], len(x)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(cols, f * g[row], size) + L2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.3 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w = w - step * m / (np.sqrt(v) + 1e-9)
        b = b - step * mb / (np.sqrt(vb) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w * r * unit
    return Model(weights, float(b), True)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic): at most `rows` labelled documents, those of the least hash of doc_id; of several texts of a doc_id the least."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.greatest(F.lit(0), F.least(F.lit(1), F.max("toxic"))).alias("toxic"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    some = known.join(d.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers: bounded whatever the size of the tables
    return d.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model fitted on at most `rows` labelled documents. The driver gets the counts of the hashed n-grams, and of each text those n-grams only that have a ratio."""
    texts = cut(sample(docs, labels, rows))
    seen = texts.mapInArrow(_present, "gram int, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow().sort_by("gram")
    gram, clean, toxic = (seen.column(c).to_numpy() for c in ("gram", "clean", "toxic"))
    if not len(gram) or not clean[0] or not toxic[0]:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, False)
    r = ratios(gram, clean, toxic)
    live = texts.sparkSession.sparkContext.broadcast(r != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in slices(batches):
            found = [(ids[ok := live.value[ids]].astype(np.int32).tobytes(), (n[ok] / n.sum()).astype(np.float32).tobytes()) if len(ids) else None for ids, n in _of_rows(buf, offs)]
            keep = np.array([f is not None for f in found])
            yield pa.RecordBatch.from_arrays([pa.array([f and f[0] for f in found], pa.binary()), pa.array([f and f[1] for f in found], pa.binary()), part.column("doc_id"), part.column("toxic")], ["ids", "shares", "doc_id", "toxic"]).filter(pa.array(keep))

    got = texts.mapInArrow(run, "ids binary, shares binary, doc_id long, toxic int").toArrow().sort_by("doc_id")
    x = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.float32)) for a, b in zip(got.column("ids"), got.column("shares"))]
    return fit(x, r, got.column("toxic").to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, toxicity, toxic) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, buf, offs in slices(batches):
            p = m.scores(buf, offs)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p), pa.array((p >= threshold) & ~m.empty(offs) & m.trained)], ["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs that the classifier, trained on them and labels, doesn't reject; all columns, null doc_ids too."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, buf, offs in slices(batches):
            gone = (m.scores(buf, offs) >= threshold) & ~m.empty(offs) & m.trained
            yield rows.filter(pa.array(~gone))

    return docs.mapInArrow(run, docs.schema)
