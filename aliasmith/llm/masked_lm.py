"""Masked pseudo-likelihood of documents under a bidirectional window network with a hierarchical softmax.

Every word of the corpus is predicted from the SIDE tokens on either side of it; the word itself is never
its own input. The probability of a word has up to three factors: that of its class of CLASSES, that of its
slot of SLOTS in the class, and, for words beyond the HEAD most frequent ones, which share TAILS slots by
their last bytes, its share in what the corpus has in that slot. The network embeds the tokens around,
joins the embeddings, passes them through a tanh layer and gives the first two factors by a softmax each,
the second with weights of the class's own. The third comes from the counts of all words over all
documents, a table that grows with the corpus and is joined, never sent to a task whole. So all words have probabilities of
their own that add up to 1; a word that was never counted shares one count more in its slot. A document's score is the
sum over its positions of the log-probability of each word given both sides, and that per token.

Training runs over every window of every document. Documents are spread by hash over shards of about
SHARD_TOKENS, so many as the corpus needs, and over ROUNDS rounds. In a round each shard trains a copy of the network by
adaptive gradient steps in numpy on its documents of the round, in order of their hash, and the copies are averaged by the
tokens that they saw, an aggregation in Spark. The result depends on the documents, not on their partitions.

Null and empty texts have no tokens: n_tokens and log_likelihood are 0, per_token is null. Every
row is scored for itself, also those of a null or repeated doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import cut, mix, row_bounds, slices, span_hash, words

CLASSES, SLOTS, TAILS = 64, 64, 256
HEAD = CLASSES * SLOTS - TAILS
SIDE, DIM, HIDDEN = 2, 16, 32
BATCH, RATE = 8192, 0.1
#: Scores of outcomes are held within, so that no exponential overflows.
_BOUND = 60
SHARD_TOKENS, ROUNDS = 8_000_000, 3
_TAIL_BYTES = 3
_COUNTS = 1 << 20
_SHIFTS = [k for k in range(-SIDE, SIDE + 1) if k]


def tails(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which of the TAILS slots a word's last bytes point to."""
    key = np.zeros(len(s), np.uint64)
    for k in range(1, _TAIL_BYTES + 1):
        at = e - k
        key = key << np.uint64(8) | np.where(at >= s, buf[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(key) % np.uint64(TAILS)).astype(np.int64)


def _counts_batch(key: np.ndarray, n: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(tail.astype(np.int32))], ["word", "n", "tail"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word fingerprints; sent on whenever so many distinct ones are held."""
    key, n, tail = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, buf, offs in slices(batches):
        s, e, _ = words(buf, offs)
        u, first, c = np.unique(span_hash(buf, s, e), return_index=True, return_counts=True)
        t = tails(buf, s[first], e[first])
        key, first, inverse = np.unique(np.r_[key, u], return_index=True, return_inverse=True)
        n, tail = np.bincount(inverse, np.r_[n, c], len(key)).astype(np.int64), np.r_[tail, t][first]
        if len(key) > _COUNTS:
            yield _counts_batch(key, n, tail)
            key, n, tail = key[:0], n[:0], tail[:0]
    yield _counts_batch(key, n, tail)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, tail) of every word of the corpus by its fingerprint; a written table."""
    return cut(docs.select("text").mapInArrow(_count, "word long, n long, tail int").groupBy("word").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")))


@dataclass
class Network:
    words: np.ndarray  # fingerprints of the head in rising order
    ids: np.ndarray  # their outcomes, class * SLOTS + slot
    total: np.ndarray  # of each tail slot, the words counted in it and one more
    emb: np.ndarray  # by outcome + 1; 0 stands beyond the ends of a document
    w: np.ndarray
    b: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    PARTS = ("emb", "w", "b", "w1", "b1", "w2", "b2")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.PARTS])

    def with_flat(self, x: np.ndarray) -> Network:
        parts, at = [], 0
        for k in self.PARTS:
            p = getattr(self, k)
            parts.append(x[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(self.words, self.ids, self.total, *parts)

    def tokens(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Outcome of every word, its row, its fingerprint, and its tail slot or -1 for a word of the head."""
        s, e, row = words(buf, offs)
        h = span_hash(buf, s, e)
        tail = tails(buf, s, e)
        out = tail_outcome(tail)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out[hit], tail[hit] = self.ids[at[hit]], -1
        return out, row, h, tail

    def windows(self, token: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Inputs on both sides of each position; 0 beyond the row."""
        n = len(token)
        out = np.zeros((n, len(_SHIFTS)), np.int64)
        for j, k in enumerate(_SHIFTS):
            if abs(k) >= n:
                continue
            here, there = (slice(0, n - k), slice(k, n)) if k > 0 else (slice(-k, n), slice(0, n + k))
            out[here, j] = np.where(row[here] == row[there], token[there] + 1, 0)
        return out

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.emb.take(context, axis=0).reshape(len(context), -1)
        return x, np.tanh(x @ self.w + self.b)

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of class and slot of each token."""
        out = np.empty(len(token), np.float32)
        for i in range(0, len(token), BATCH):
            part = token[i : i + BATCH]
            order = np.argsort(part.astype(np.int16), kind="stable")
            part = part[order]
            _, h = self.hidden(context[i : i + BATCH][order])
            got = _own(h @ self.w1 + self.b1, part // SLOTS)
            for c, a, z in _groups(part // SLOTS):
                got[a:z] += _own(h[a:z] @ self.w2[c] + self.b2[c], part[a:z] % SLOTS)
            out[i + order] = got
        return out

    def gradient(self, context: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in order of PARTS."""
        order = np.argsort(token.astype(np.int16), kind="stable")
        context, token = context[order], token[order]
        n = len(token)
        x, h = self.hidden(context)
        z = _error(h @ self.w1 + self.b1, token // SLOTS, n)
        g1, gb1, gh = h.T @ z, z.sum(0), z @ self.w1.T
        g2, gb2 = np.zeros_like(self.w2), np.zeros_like(self.b2)
        slot = token % SLOTS
        for c, a, e in _groups(token // SLOTS):
            own = h[a:e]
            z = _error(own @ self.w2[c] + self.b2[c], slot[a:e], n)
            np.matmul(own.T, z, out=g2[c])
            np.add.reduce(z, 0, out=gb2[c])
            gh[a:e] += z @ self.w2[c].T
        gh *= 1 - h * h
        gx = gh @ self.w.T
        # an embedding's gradient is the sum over its places
        place = (context.reshape(-1, 1) * DIM + np.arange(DIM)).ravel()
        ge = np.bincount(place, gx.ravel(), self.emb.size).astype(np.float32).reshape(self.emb.shape)
        return [ge, x.T @ gh, gh.sum(0), g1, gb1, g2, gb2]


def tail_outcome(tail: np.ndarray) -> np.ndarray:
    return tail % CLASSES * SLOTS + SLOTS - TAILS // CLASSES + tail // CLASSES


def _groups(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal numbers."""
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]).tolist()
    yield from zip(sorted_[first].tolist(), first, [*first[1:], len(sorted_)])


def _sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], np.float32)


def _error(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Probabilities less 1 at the place that came true, of each row of scores, over n."""
    np.clip(z, -_BOUND, _BOUND, out=z)
    np.exp(z, out=z)
    z *= (np.float32(1 / n) / _sums(z))[:, None]
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + at] -= np.float32(1 / n)
    return z


def _own(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one place in each row of scores."""
    np.clip(z, -_BOUND, _BOUND, out=z)
    own = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + at]
    np.exp(z, out=z)
    return own - np.log(_sums(z))


def start(counts: DataFrame, seed: int = 1) -> Network:
    """A network that knows the frequencies of its outcomes only. At most HEAD + TAILS rows reach the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n", "tail").collect()
    key = np.array([r.word for r in top], np.int64).view(np.uint64)
    rank = np.arange(len(key))
    ids, n = rank % CLASSES * SLOTS + rank // CLASSES, np.array([r.n for r in top], np.float64)
    total = np.ones(TAILS)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        total[r.tail] += r.n
    np.add.at(total, np.array([r.tail for r in top], np.int64), -n)
    seen = np.full(CLASSES * SLOTS, 0.01)
    seen[ids] += n
    seen[tail_outcome(np.arange(TAILS))] += total
    seen = seen.reshape(CLASSES, SLOTS)
    r = np.random.default_rng(seed)
    wide = len(_SHIFTS) * DIM
    normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    order = np.argsort(key)
    logs = lambda x: np.log(x / x.sum(-1, keepdims=True)).astype(np.float32)
    return Network(key[order], ids[order], total, normal(1 + CLASSES * SLOTS, DIM, scale=0.3), normal(wide, HIDDEN, scale=wide**-0.5), np.zeros(HIDDEN, np.float32), normal(HIDDEN, CLASSES, scale=0.1), logs(seen.sum(1)), normal(CLASSES, HIDDEN, SLOTS, scale=0.1), logs(seen))


def train_on(net: Network, chunks: Iterator[tuple[np.ndarray, np.ndarray]], seed: int = 1) -> tuple[Network, int]:
    """net after one pass over (bytes, offsets), and the tokens seen; net itself stays."""
    net = net.with_flat(net.flat())
    parts = [getattr(net, k) for k in net.PARTS]
    power = [np.full(p.shape, 1e-6, np.float32) for p in parts]
    seen = 0
    r = np.random.default_rng(seed)
    for buf, offs in chunks:
        token, row, _, _ = net.tokens(buf, offs)
        context = net.windows(token, row)
        order = r.permutation(len(token))
        context, token = context[order], token[order]
        for i in range(0, len(token), BATCH):
            for p, q, g in zip(parts, power, net.gradient(context[i : i + BATCH], token[i : i + BATCH])):
                q += g * g
                g /= np.sqrt(q)
                g *= np.float32(RATE)
                p -= g
        seen += len(token)
    return net, seen


def _averaged(docs: DataFrame, net: Network, shards: int) -> Network:
    """The mean of copies of net that are trained each on the documents of one shard, in order of their hash. docs: text, hash."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, seen = train_on(shared.value, ((b, o) for _, b, o in slices(batches)))
        if seen:
            x = got.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * seen), pa.array(np.full(len(x), seen, np.int64))], ["at", "weighted", "seen"])

    spread = docs.repartitionById(shards, F.pmod("hash", F.lit(shards)).cast("int")).sortWithinPartitions("hash", "text").select("text")
    rows = spread.mapInArrow(run, "at int, weighted double, seen long").groupBy("at").agg((F.sum("weighted") / F.sum("seen")).alias("value")).toArrow()
    if not rows.num_rows:
        return net
    x = np.zeros(rows.num_rows)
    x[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return net.with_flat(x)


def train(docs: DataFrame, counts: DataFrame, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> Network:
    """The network trained on all documents. counts: of their words."""
    net = start(counts)
    shards = -(-(counts.agg(F.sum("n")).first()[0] or 1) // shard_tokens)
    d = docs.filter("text <> ''").select("text", F.xxhash64("doc_id", "text").alias("hash"))
    for k in range(rounds):
        # the round by other bits than the shard
        net = _averaged(d.filter(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == k), net, shards)
    return net


def score(docs: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of every row.

    A row's number is its place in the scan, which a task that is run again gives anew alike. What a row's tail words add is
    joined by word and summed by row; words of the head, the frequent ones, take no part in the join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        for rows, buf, offs in slices(batches):
            token, row, h, tail = n.tokens(buf, offs)
            p = n.log_probability(n.windows(token, row), token).astype(np.float64)
            rare = tail >= 0
            p[rare] -= np.log(n.total[tail[rare]])
            total = np.bincount(row, p, rows.num_rows) if len(row) else np.zeros(rows.num_rows)
            count = np.diff(row_bounds(row, rows.num_rows))
            # one row a document, and one for each of its tail words, which seldom occur twice in it
            at = rows.column("row").to_numpy()
            k, m = rows.num_rows, int(rare.sum())
            word = np.r_[mix(at.view(np.uint64)), h[rare]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[at, at[row[rare]]]), pa.array(word), pa.concat_arrays([rows.column("doc_id"), pa.nulls(m, pa.int64())]), pa.array(np.r_[count, np.ones(m, np.int64)]), pa.array(np.r_[total, np.zeros(m)]), pa.array(np.r_[np.ones(k, bool), np.zeros(m, bool)])],
                ["row", "word", "doc_id", "n", "part", "document"],
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    parts = d.mapInArrow(run, "row long, word long, doc_id long, n long, part double, document boolean")
    known = counts.select("word", F.ln("n").alias("log_n"))
    met = parts.join(known, "word", "left")
    value = F.when(F.col("document"), F.col("part")).otherwise(F.col("n") * F.coalesce("log_n", F.lit(0.0)))
    own = lambda c: F.max(F.when(F.col("document"), F.col(c)))
    done = met.groupBy("row").agg(own("doc_id").alias("doc_id"), own("n").alias("n_tokens"), F.sum(value).alias("log_likelihood"))
    return done.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))


def scored(docs: DataFrame) -> DataFrame:
    """score of docs under a network trained on them."""
    counts = count_words(docs)
    return score(docs, train(docs, counts), counts)
