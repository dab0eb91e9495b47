"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer.

Texts are split by the tokenizer's pattern (letters, digits and other characters in runs, a
space before each, contractions, white space), the pieces of a slice are told apart by 64-bit
fingerprints, and each distinct piece is encoded once. Over the ranks of its adjacent pairs lies
a segment tree: the root yields the leftmost pair of the lowest rank; the merge changes at most
three leaves, each updated in logarithmic time, until the root has no pair that merges. Pieces of
like length are worked on side by side, one numpy step for all their trees. A piece that is a
token itself is that token.

Null texts give null results, empty ones an empty list. Strings of special tokens in a text are
ordinary text. Decoding concatenates the bytes of the tokens; bytes that aren't UTF-8, which no
encoded text yields, become U+FFFD; unknown ids fail.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import row_bounds, slices, span_hash

#: Path of the vocabulary, lines of a token in base64 and its rank; it must exist on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_INF = np.int64(1 << 62)
_LONG = 256
_CACHE = 1_000_000

_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, DIGIT, SPACE, OTHER = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    kind = {"L": LETTER, "N": DIGIT}
    t = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    t[_SPACES] = SPACE
    return t


def pieces(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First byte of every piece; none crosses a row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    lead = (buf & 0xC0) != 0x80
    cs = np.flatnonzero(lead)
    b0 = buf[cs].astype(np.int64)
    cp = b0.copy()
    pad = np.r_[buf, np.zeros(3, np.uint8)]
    for low, high, bytes_, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        at = np.flatnonzero((b0 >= low) & (b0 < high))
        if len(at):
            v = b0[at] & mask
            for k in range(1, bytes_):
                v = (v << 6) | (pad[cs[at] + k] & 0x3F)
            cp[at] = v
    cl = _classes()[np.minimum(cp, 0x10FFFF)]
    m = len(cs)
    begin = np.zeros(m + 1, bool)
    begin[np.searchsorted(cs, offs)] = True
    begin[0] = True
    space = cl == SPACE
    before = np.r_[np.uint8(OTHER), cl[:-1]]
    after_blank = np.r_[False, cp[:-1] == 32] & ~begin[:m]
    # a run of one class begins, unless a blank before it belongs to it
    start = ((cl != before) | begin[:m]) & ~(after_blank & ~space)
    # the last white space before other characters stands apart from the rest of its run
    last = space & np.r_[~space[1:], False] & ~begin[1:]
    start |= last
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        c = np.r_[cp, 0, 0, 0]
        edge = np.r_[begin[:m], True, True, True]
        one, two = c[quote + 1], c[quote + 2]
        ok1, ok2 = ~edge[quote + 1], ~edge[quote + 1] & ~edge[quote + 2]
        single = ok1 & np.isin(one, [ord(x) for x in "stmd"])
        double = ok2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        s = np.r_[start, False, False, False]
        s[quote[single | double] + 1] = False
        s[quote[single] + 2] = True
        s[quote[double] + 3] = True
        start = s[:m] | begin[:m]
    return cs[start]


class Vocabulary:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        tokens = sorted(self.ranks, key=self.ranks.get)
        ids = np.array([self.ranks[t] for t in tokens], np.int64)
        self.size = int(ids.max()) + 1
        lens = np.zeros(self.size, np.int64)
        lens[ids] = [len(t) for t in tokens]
        self.known = lens > 0
        self.offs = np.r_[0, np.cumsum(lens)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # open-addressed table: pair of ids -> id of the merged token, which is its rank too
        pairs = {}
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _INF, np.int64)
        left, value = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = left[free]
            won = self.keys[slot] == left
            self.values[slot[won]] = value[won]
            left, value, slot = left[~won], value[~won], (slot[~won] + 1) & (len(self.keys) - 1)
        h = span_hash(self.data, self.offs[:-1][self.known], self.offs[1:][self.known])
        order = np.argsort(h)
        self.whole, self.whole_id = h[order], np.flatnonzero(self.known)[order]
        self.cache_key, self.cache_at, self.cache_len, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _INF where it doesn't merge, or an id is negative."""
        key = (a << 32) | b
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], _INF)
        more = np.flatnonzero((got != key) & (got != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[more]]
            hit = got == key[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (got != -1)]
        out[(a < 0) | (b < 0)] = _INF
        return out

    def merge(self, mat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in the rows of mat one after another, and how many each has. mat: bytes, as wide as the longest piece."""
        rows, n = mat.shape
        col = np.arange(n)
        live = col[None, :] < lens[:, None]
        sym = np.where(live, self.byte[mat], -1)
        if n > 1:
            leaves = 1 << max(0, (n - 2).bit_length()) if n > 2 else 1
            tree = np.full((rows, 2 * leaves), _INF, np.int64)
            r = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, n - 1)
            tree[:, leaves : leaves + n - 1] = np.where(r < _INF, r * leaves + col[None, : n - 1], _INF)
            width = leaves
            while width > 1:
                np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2], out=tree[:, width // 2 : width])
                width //= 2
            nxt = np.tile(np.arange(1, n + 1), (rows, 1))
            prv = np.tile(np.arange(-1, n), (rows, 1))
            sym = np.c_[sym, np.full(rows, -1)]
            act = np.flatnonzero(tree[:, 1] < _INF)
            while len(act):
                key = tree[act, 1]
                pos, new = key & (leaves - 1), key >> (leaves.bit_length() - 1)
                q = nxt[act, pos]
                after, before = nxt[act, q], prv[act, pos]
                sym[act, pos] = new
                live[act, q] = False
                nxt[act, pos] = after
                prv[act, after] = pos
                b = np.maximum(before, 0)
                left = np.where(before >= 0, sym[act, b], -1)
                both = self.rank(np.r_[new, left], np.r_[sym[act, after], new])
                k = len(act)
                # three leaves change: the merged pair's, its right one's, its left neighbour's
                qi = np.minimum(q, leaves - 1)
                drop = q < leaves
                tree[act[drop], leaves + qi[drop]] = _INF
                tree[act, leaves + pos] = np.where(both[:k] < _INF, both[:k] * leaves + pos, _INF)
                has = before >= 0
                tree[act[has], leaves + b[has]] = np.where(both[k:] < _INF, both[k:] * leaves + b, _INF)[has]
                for leaf in (qi, pos, b):
                    at = (leaf + leaves) >> 1
                    for _ in range(leaves.bit_length() - 1):
                        tree[act, at] = np.minimum(tree[act, 2 * at], tree[act, 2 * at + 1])
                        at = at >> 1
                act = act[tree[act, 1] < _INF]
            sym = sym[:, :n]
        return sym[live], live.sum(1)

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, on plain lists."""
        n, pairs = len(piece), self.pairs
        sym = [int(self.byte[x]) for x in piece]
        leaves = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = pairs.get(sym[i] << 32 | sym[i + 1])
            if r is not None:
                tree[leaves + i] = (r, i)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def put(i: int, v: tuple[int, int]) -> None:
            i += leaves
            tree[i] = v
            i >>= 1
            while i:
                v = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == v:
                    break
                tree[i] = v
                i >>= 1

        while tree[1] != none:
            new, pos = tree[1]
            q = nxt[pos]
            sym[pos], live[q] = new, False
            nxt[pos] = after = nxt[q]
            put(q, none)
            r = None
            if after < n:
                prv[after] = pos
                r = pairs.get(new << 32 | sym[after])
            put(pos, none if r is None else (r, pos))
            before = prv[pos]
            if before >= 0:
                r = pairs.get(sym[before] << 32 | new)
                put(before, none if r is None else (r, before))
        return [s for s, x in zip(sym, live) if x]

    def _encode_new(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and concatenated ids of distinct pieces."""
        size = end - start
        counts = np.ones(len(h), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (pieces, ids)
        at = np.minimum(np.searchsorted(self.whole, h), len(self.whole) - 1)
        whole = self.whole[at] == h
        single = np.zeros(len(h), np.int64)
        single[whole] = self.whole_id[at[whole]]
        rest = np.flatnonzero(~whole)
        rest = rest[np.argsort(size[rest], kind="stable")]
        lens = size[rest]
        i = 0
        while i < len(rest):
            n = int(lens[i])
            if n > _LONG:
                ids = np.array(self.merge_long(buf[start[rest[i]] : end[rest[i]]].tobytes()), np.int64)
                counts[rest[i]] = len(ids)
                parts.append((rest[i : i + 1], ids))
                i += 1
                continue
            # widths up to 8, 16, 32, ... together; at most 16 MB of tree each time
            width = min(_LONG, max(8, 1 << (n - 1).bit_length()))
            j = min(int(np.searchsorted(lens, width, "right")), i + max(64, (1 << 20) // width))
            who = rest[i:j]
            width = int(lens[j - 1])
            mat = buf[np.minimum(start[who][:, None] + np.arange(width)[None, :], len(buf) - 1)]
            ids, c = self.merge(mat, lens[i:j])
            counts[who] = c
            parts.append((who, ids))
            i = j
        first = np.r_[0, np.cumsum(counts)]
        out = np.empty(first[-1], np.int32)
        out[first[:-1][whole]] = single[whole]
        for who, ids in parts:
            c = counts[who]
            out[np.repeat(first[who], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)] = ids
        return counts, out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and where each row's begin, with the end."""
        start = pieces(buf, offs)
        end = np.r_[start[1:], len(buf)]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        h = span_hash(buf, start, end)
        name, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.cache_key, name), max(0, len(self.cache_key) - 1))
        new = self.cache_key[at] != name if len(self.cache_key) else np.ones(len(name), bool)
        if new.any():
            if len(self.cache_key) > _CACHE:
                self.cache_key, self.cache_at, self.cache_len, self.store = self.cache_key[:0], self.cache_at[:0], self.cache_len[:0], self.store[:0]
                new[:] = True
            f = first[new]
            counts, ids = self._encode_new(buf, start[f], end[f], name[new])
            key = np.concatenate([self.cache_key, name[new]])
            where = np.concatenate([self.cache_at, len(self.store) + np.cumsum(counts) - counts])
            size = np.concatenate([self.cache_len, counts])
            self.store = np.concatenate([self.store, ids])
            order = np.argsort(key, kind="stable")
            self.cache_key, self.cache_at, self.cache_len = key[order], where[order], size[order]
            at = np.searchsorted(self.cache_key, name)
        at = at[inverse]
        c = self.cache_len[at]
        ends = np.cumsum(c)
        out = self.store[np.repeat(self.cache_at[at] - (ends - c), c) + np.arange(ends[-1])]
        return out, np.r_[0, ends][row_bounds(np.searchsorted(offs, start, "right") - 1, len(offs) - 1)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each row's begin, with the end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        a = self.offs[ids]
        c = self.offs[ids + 1] - a
        ends = np.cumsum(c)
        total = int(ends[-1]) if len(ends) else 0
        step = np.ones(total, np.int64)
        if total:
            step[0] = a[0]
            step[ends[:-1]] = a[1:] - (a[:-1] + c[:-1]) + 1
        return self.data[np.cumsum(step)], np.r_[0, ends][bounds]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str = VOCABULARY, check: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for every document; round_trip, with check: the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for rows, buf, offs in slices(batches, lower=False):
            ids, bounds = v.encode(buf, offs)
            null = np.asarray(rows.column("text").is_null())
            same = np.ones(rows.num_rows, bool)
            if check:
                back, ends = v.decode(ids, bounds)
                if len(back) != len(buf) or not (back == buf).all() or (ends != offs).any():
                    same = np.array([back[ends[i] : ends[i + 1]].tobytes() == buf[offs[i] : offs[i + 1]].tobytes() for i in range(rows.num_rows)], bool)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32(), mask=np.r_[null, False]) if null.any() else pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(np.diff(bounds), pa.int64(), mask=null), pa.array(same, mask=null)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("ids")
            null = np.asarray(lists.is_null())
            lens = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            back, ends = v.decode(lists.flatten().to_numpy().astype(np.int64), np.r_[0, np.cumsum(lens)])
            texts = [None if null[i] else back[ends[i] : ends[i + 1]].tobytes().decode("utf-8", "replace") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
