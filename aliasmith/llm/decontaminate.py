"""Benchmark decontamination by shared shingles over windows as long as the items.

A window of a document has as many words as a benchmark item; a document with fewer words is its own one window. What
counts is the weighted Jaccard similarity of their multisets of shingles of SHINGLE words, a shingle weighing as much as its
words have bytes. Windows that share no shingle with an item have similarity 0 to it, so windows are made around shared
shingles only, and only where these weigh enough for the similarity asked for: a bound that loses nothing. The best window
of each document and item is the result.

At a similarity as low as SIMILARITY, fingerprints of an edited copy (weighted SimHash, 64 bits) lie nearly as far apart as
those of unlike texts, so the search doesn't go by them. Their multi-index finds items within RADIUS bits (Items.near):
64 bits are BLOCKS blocks; fingerprints within RADIUS bits agree in some block up to RADIUS // BLOCKS bits.

The items go to every task in groups of GROUP_BYTES, one pass over the documents a group, so that
what a task holds has a bound however long the benchmark is; a text that repeats itself costs no more than its length. Items of fewer than SHINGLE words
are one shingle. Null or wordless items and texts match nothing; null doc_ids take no part in the
report, and their rows are judged like others when documents are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import row_bounds, slices, span_hash, words, _GRAM, flat, mix
import pyarrow.compute as pc

SHINGLE = 3
BLOCKS, RADIUS = 4, 19
#: What copies with several words replaced still reach; each breaks SHINGLE shingles on both sides. Clean pairs of the tables reach about 0.2.
SIMILARITY = 0.25
#: Bound of what is sent to every task at once: bytes of items, beside the one that passes it.
GROUP_BYTES = 4 << 20
#: Pairs of a shingle's place and an item that has it, held at once.
MOST_HITS = 2_000_000

_BITS = np.arange(64, dtype=np.uint64)


def weighted_shingles(h: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and weights of the runs of n words that begin at each word but the last n - 1; h, size: of consecutive words."""
    m = len(h) - n + 1
    s, w = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    for k in range(n):
        s += h[k : k + m] * _GRAM[k]
        w += size[k : k + m]
    return mix(s), w


def votes(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each shingle, its weight with a sign for each of 64 bits."""
    bit = (mix(s)[:, None] >> _BITS[None, :]) & np.uint64(1)
    return np.where(bit.astype(bool), w[:, None], -w[:, None])


def pack(total: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of summed votes."""
    return ((total > 0).astype(np.uint64) << _BITS[None, :]).sum(1, dtype=np.uint64)


def similarity(s1: np.ndarray, w1: np.ndarray, s2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets: a shingle weighs alike in both, so counts decide."""
    a, x, n = np.unique(s1, return_index=True, return_counts=True)
    b, y, m = np.unique(s2, return_index=True, return_counts=True)
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int((np.minimum(n[i], m[j]) * w1[x[i]]).sum())
    union = int(w1.sum() + w2.sum()) - common
    return common / union if union else 0.0


class Items:
    """Benchmark items with their fingerprints, the multi-index, and the shingles they have."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = RADIUS):
        buf, offs = flat(pc.utf8_lower(pa.array(texts, pa.string())))
        st, en, row = words(buf, offs)
        h = span_hash(buf, st, en)
        b = row_bounds(row, len(texts))
        self.radius = radius
        self.ids, self.length, self.shingle, self.weight, prints = [], [], [], [], []
        for i, item in enumerate(ids):
            x, n = h[b[i] : b[i + 1]], b[i + 1] - b[i]
            if not n:
                continue
            s, w = weighted_shingles(x, (en - st)[b[i] : b[i + 1]], min(n, SHINGLE))
            self.ids.append(item)
            self.length.append(n)
            self.shingle.append(s)
            self.weight.append(w)
            prints.append(pack(votes(s, w).sum(0)[None, :])[0])
        self.prints = np.array(prints, np.uint64)
        # which items own a shingle, by the words of their shingles
        own = {(int(x), i) for i, ss in enumerate(self.shingle) for x in ss}
        by = {k: sorted((x, i) for x, i in own if min(self.length[i], SHINGLE) == k) for k in range(1, SHINGLE + 1)}
        self.owned = {k: (np.array([x for x, _ in v], np.uint64), np.array([i for _, i in v], np.int64)) for k, v in by.items() if v}
        self.total = np.array([w.sum() for w in self.weight], np.int64)
        self._index = None

    @property
    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if self._index is None:
            self._index = self._blocks(self.radius)
        return self._index

    def _blocks(self, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block a list of items for each value."""
        width = 64 // BLOCKS
        masks = [sum(1 << x for x in c) for d in range(radius // BLOCKS + 1) for c in combinations(range(width), d)]
        out = []
        for k in range(BLOCKS):
            part = (self.prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
            value = (part[:, None] ^ np.array(masks, np.uint64)[None, :]).ravel()
            who = np.repeat(np.arange(len(self.prints), dtype=np.int32), len(masks))
            order = np.argsort(value, kind="stable")
            out.append((np.searchsorted(value[order], np.arange((1 << width) + 1, dtype=np.uint64)), who[order]))
        return out

    def near(self, prints: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) with fingerprints within the radius and as many words."""
        out = []
        width = 64 // BLOCKS
        lens = np.array(self.length)
        for lo in range(0, len(prints), 50_000):
            p, n = prints[lo : lo + 50_000], length[lo : lo + 50_000]
            keys = []
            for k, (bounds, who) in enumerate(self.index):
                v = ((p >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                count = bounds[v + 1] - bounds[v]
                w = np.repeat(np.arange(len(p)), count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[v], count)
                it = who[at]
                ok = (lens[it] == n[w]) & (np.bitwise_count(p[w] ^ self.prints[it]) <= self.radius)
                keys.append(w[ok].astype(np.int64) * len(lens) + it[ok])
            key = np.unique(np.concatenate(keys))
            out.append((key // len(lens) + lo, key % len(lens)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def search(self, buf: np.ndarray, offs: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        """(row, item, first word, similarity) of the best window of each row and item, of those of at least that similarity."""
        st, en, row = words(buf, offs)
        if not len(st) or not self.ids:
            return []
        h, size = span_hash(buf, st, en), en - st
        bounds = row_bounds(row, len(offs) - 1)
        found = []
        for k, (own, who) in self.owned.items():
            if len(h) < k:
                continue
            s, w = weighted_shingles(h, size, k)
            inside = row[: len(s)] == row[k - 1 :]
            lo, hi = np.searchsorted(own, s, "left"), np.searchsorted(own, s, "right")
            hit = np.flatnonzero((hi > lo) & inside)
            if not len(hit):
                continue
            # items a few at a time, so that what is held is bounded however many share a shingle
            times = np.cumsum(np.bincount(lo[hit], minlength=len(own) + 1) - np.bincount(hi[hit], minlength=len(own) + 1))[:-1]
            group = np.cumsum(np.bincount(who, times, len(self.ids))) // MOST_HITS
            for g in np.unique(group[who[times > 0]]):
                of = group[who] == g
                found += self._matched(s, w, hit, own[of], who[of], row, bounds, k, least)
        return sorted(found)

    def _matched(self, s: np.ndarray, w: np.ndarray, hit: np.ndarray, own: np.ndarray, who: np.ndarray, row: np.ndarray, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int, int, float]]:
        lo, hi = np.searchsorted(own, s[hit], "left"), np.searchsorted(own, s[hit], "right")
        count = hi - lo
        at = np.repeat(hit, count)
        item = who[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        # the union weighs no less than the item, so what is common weighs `least` of the item at least
        key, inverse = np.unique(row[at].astype(np.int64) * len(self.ids) + item, return_inverse=True)
        need = least * self.total[key % len(self.ids)] * (1 - 1e-9)
        heavy = np.bincount(inverse, w[at]) >= need
        order = np.argsort(inverse, kind="stable")
        cuts = np.searchsorted(inverse[order], np.arange(len(key) + 1))
        sums = np.r_[0, np.cumsum(w)]
        found = []
        for g in np.flatnonzero(heavy).tolist():
            r, i = divmod(int(key[g]), len(self.ids))
            p = at[order[cuts[g] : cuts[g + 1]]]
            begin, m = self._windows(p, w[p], int(bounds[r]), int(bounds[r + 1]), int(self.length[i]), k, need[g])
            if not len(begin):
                continue
            common = self._common(p, s[p], w[p], begin, m, i)
            like = common / (sums[begin + m] - sums[begin] + self.total[i] - common)
            best = int(like.argmax())
            if like[best] >= least:
                found.append((r, i, int(begin[best] - bounds[r]), float(like[best])))
        return found

    def _common(self, p: np.ndarray, s: np.ndarray, w: np.ndarray, begin: np.ndarray, m: int, item: int) -> np.ndarray:
        """Weight of what windows of m shingles from each begin share with an item, as multisets; p, s, w: places, fingerprints and weights of the shingles that it has.

        A place counts for the windows that hold it but not as many places of the same shingle before it as the item has of it.
        """
        names, n = np.unique(self.shingle[item], return_counts=True)
        which = np.searchsorted(names, s)
        order = np.argsort(which, kind="stable")
        q, kind = p[order], which[order]
        earlier = np.arange(len(q)) - n[kind]
        same = (earlier >= 0) & (kind[np.maximum(earlier, 0)] == kind)
        first = np.maximum(q - m + 1, np.where(same, q[np.maximum(earlier, 0)] + 1, -1))
        w = w[order]
        i, j = np.argsort(first, kind="stable"), np.argsort(q, kind="stable")
        up, down = np.r_[0, np.cumsum(w[i])], np.r_[0, np.cumsum(w[j])]
        return up[np.searchsorted(first[i], begin, "right")] - down[np.searchsorted(q[j], begin, "left")]

    @staticmethod
    def _windows(p: np.ndarray, w: np.ndarray, lo: int, hi: int, n: int, k: int, need: float) -> tuple[np.ndarray, int]:
        """Begins of the windows of n words between words lo and hi whose shared shingles, of k words at p, weigh enough, and their number of shingles."""
        if hi - lo < n:
            return np.array([lo]), hi - lo - k + 1
        m = n - k + 1
        first, last = np.maximum(p - m + 1, lo), np.minimum(p, hi - n)
        # each shared shingle brings the begins that the one before it didn't
        first = np.maximum(first, np.r_[lo, last[:-1] + 1])
        reach = np.maximum(last - first + 1, 0)
        begin = np.repeat(first, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        sums = np.r_[0, np.cumsum(w)]
        return begin[sums[np.searchsorted(p, begin + m)] - sums[np.searchsorted(p, begin)] >= need], m


def item_groups(benchmark: DataFrame, size: int = GROUP_BYTES) -> list[list[tuple[int, str]]]:
    """The items, in groups of about `size` bytes; null ids and texts left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    groups: list[list[tuple[int, str]]] = []
    held = size
    for r in rows:
        if held >= size:
            groups.append([])
            held = 0
        groups[-1].append((r.item_id, r.text))
        held += len(r.text.encode())
    return groups


def _scan(docs: DataFrame, group: list[tuple[int, str]], least: float) -> DataFrame:
    items = docs.sparkSession.sparkContext.broadcast(Items([a for a, _ in group], [b for _, b in group]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        for rows, buf, offs in slices(batches):
            found = it.search(buf, offs, least)
            ids = rows.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r, _, _, _ in found], pa.int64()), pa.array([it.ids[i] for _, i, _, _ in found], pa.int64()), pa.array([f for _, _, f, _ in found], pa.int64()), pa.array([x for _, _, _, x in found], pa.float64())],
                ["doc_id", "item_id", "start_word", "similarity"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, start_word long, similarity double")


_SCHEMA = "doc_id long, item_id long, start_word long, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): the window of each document that is most like each item, where it is at least so like it; the earlier of equals. Rows that share a doc_id, or items an item_id, each report."""
    d = docs.filter("doc_id is not null")
    parts = [_scan(d, g, least) for g in item_groups(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs without those that hold an item; all columns, null doc_ids too."""
    for group in item_groups(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(Items([a for a, _ in group], [b for _, b in group]))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for rows, buf, offs in slices(batches):
                keep = np.ones(rows.num_rows, bool)
                for r, _, _, _ in items.value.search(buf, offs, least):
                    keep[r] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
