"""Batches of rows against tables small enough to go to every task: lookups, and recurrences over many rows at once in numpy.

A table of more than LOCAL_ROWS rows or LOCAL_BYTES doesn't go to the tasks; its users join instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import NIL_SCORE

LOCAL_ROWS, LOCAL_BYTES = 200_000, 64 << 20
#: Cells of one dense array.
CELLS = 2_000_000


def small(df: DataFrame, rows: int | None = None) -> pa.Table | None:
    """The whole table, or None if it has more than `rows` rows, LOCAL_ROWS at most."""
    most = LOCAL_ROWS if rows is None else min(rows, LOCAL_ROWS)
    t = df.limit(most + 1).toArrow()
    return t.combine_chunks() if t.num_rows <= most else None


def column(t: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = t.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c if not isinstance(c, pa.ChunkedArray) else pa.concat_arrays(c.chunks)


def numbers(a: pa.Array, null: float | int) -> np.ndarray:
    return pc.fill_null(a, pa.scalar(null, a.type)).to_numpy(zero_copy_only=False)


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(lens: np.ndarray) -> np.ndarray:
    """Place of the first element of each row in the flat array, and the end."""
    return np.r_[0, np.cumsum(lens)].astype(np.int64)


def within(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each element of the flat array, and its place in the row."""
    row = np.repeat(np.arange(len(lens)), lens)
    return row, np.arange(len(row)) - starts(lens)[row]


def expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of `count` numbers from `first` on: the run of each number, and the numbers."""
    run, place = within(count)
    return run, first[run] + place


def joined(flat: pa.Array, at: np.ndarray, n: int, sep: str) -> pa.Array:
    """The n words from each place on, joined."""
    return flat.take(pa.array(at)) if n == 1 else pc.binary_join_element_wise(*[flat.take(pa.array(at + i)) for i in range(n)], sep)


def begins(a: pa.Array) -> np.ndarray:
    """Whether each element differs from the one before it; nulls are alike."""
    null = a.is_null().to_numpy(zero_copy_only=False)
    same = numbers(pc.equal(a.slice(1), a.slice(0, max(len(a) - 1, 0))), False) | (null[1:] & null[:-1])
    return np.r_[True, ~same][: len(a)]


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows cut anew so that those of one key, which lie together, come in one batch."""
    kept: list[pa.RecordBatch] = []

    def together(*more: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches([*kept, *more]).combine_chunks().to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        # kept holds one key
        new = begins(pa.concat_arrays([kept[-1].column(key).slice(0, 1), k]))[1:] if kept else begins(k)
        at = np.flatnonzero(new)
        if not len(at):
            kept.append(b)
            continue
        if kept or at[-1]:
            yield from together(b.slice(0, at[-1]))
        kept = [b.slice(at[-1])]
    if kept:
        yield from together()


def looked_up(keys: pa.Array, names: pa.Array) -> np.ndarray:
    """Place of each key in names, -1 for none."""
    return numbers(pc.index_in(keys, value_set=names, skip_nulls=True), -1)


def grams(words: pa.Array, names: pa.Array, sizes: list[int], sep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, place in names) of every run of so many words that is a name; equal names must occur once."""
    lens = lengths(words)
    flat, (row, place) = words.flatten(), within(lens)
    left = lens[row] - place
    found = []
    for n in sizes:
        at = np.flatnonzero(left >= n)
        ids = looked_up(joined(flat, at, n, sep), names)
        hit = ids >= 0
        at = at[hit]
        found.append((row[at], place[at], place[at] + n - 1, ids[hit].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def gram_sizes(names: pa.Array, sep: str = " ") -> list[int]:
    """Numbers of words that names have."""
    return sorted({n for n in pc.unique(pc.add(pc.count_substring(names, sep), 1)).to_pylist() if n})


def _back(prev: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of the segments and their rows: from the last token back."""
    rows, at, out = np.arange(len(off) - 1), np.diff(off) - 1, []
    while True:
        go = at >= 0
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        end = off[rows] + at
        out.append((end, rows))
        at = prev[end] - 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, rows = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(end)
    return end[order], rows[order]


def fold(lens: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, entity: np.ndarray, score: np.ndarray, textbook: bool = False) -> tuple[np.ndarray, ...]:
    """(row, start, end, entity, score) of the segments of segment.segment in order; matches of each row, of one place once."""
    off = starts(lens)
    cur, ids, prev = np.full(off[-1], NIL_SCORE), np.full(off[-1], -1, np.int64), within(lens)[1]
    (_textbook if textbook else _reference)(lens, off, row, start, end, entity, score, cur, ids, prev)
    at, rows = _back(prev, off)
    return rows, prev[at], at - off[rows], ids[at], cur[at]


def _reference(lens, off, row, start, end, entity, score, cur, ids, prev) -> None:  # noqa: ANN001
    acc = np.zeros(off[-1])
    above = np.zeros(len(lens), bool)
    above[row[score > 0]] = True
    order = np.lexsort((start, end, row))
    row, start, end, entity, score = (x[order] for x in (row, start, end, entity, score))
    # a span without a link is taken only after a total above 0, which needs a score above 0: else the matches alone will do, the k-th of all rows at once
    plain = ~above[row]
    r, s, e, i, v = (x[plain] for x in (row, start, end, entity, score))
    _, place = within(np.bincount(r, minlength=len(lens)))
    by = np.argsort(place, kind="stable")
    cuts = np.cumsum(np.bincount(place)) if len(place) else []
    for k in np.split(by, cuts[:-1]) if len(place) else []:
        at, total = off[r[k]] + e[k], v[k] + acc[off[r[k]] + s[k]]
        won = total > cur[at]
        at, k = at[won], k[won]
        acc[at], cur[at], ids[at], prev[at] = total[won], v[k], i[k], s[k]
    for q in np.flatnonzero(above):
        a, b = np.searchsorted(row, [q, q + 1])
        met = {(int(y), int(x)): (float(z), int(w)) for x, y, w, z in zip(start[a:b], end[a:b], entity[a:b], score[a:b])}
        total = [0.0] * int(lens[q])
        for y in range(len(total)):
            best, of = NIL_SCORE, (-1, y)
            for x in range(y + 1):
                z, w = met.get((y, x), (NIL_SCORE, -1))
                if z + total[x] > best:
                    total[y], best, of = z + total[x], z, (w, x)
            cur[off[q] + y], ids[off[q] + y], prev[off[q] + y] = best, *of


def _textbook(lens, off, row, start, end, entity, score, cur, ids, prev) -> None:  # noqa: ANN001
    order = np.lexsort((start, row, end))
    for rows in alike(lens, 1):
        n = int(lens[rows[-1]])
        at_row = np.full(len(lens), -1)
        at_row[rows] = np.arange(len(rows))
        mine = order[at_row[row[order]] >= 0]
        cuts = np.searchsorted(end[mine], np.arange(n + 1))
        # the total before each begin
        before = np.zeros((len(rows), n + 1))
        for y in range(n):
            # rows come by length: those that end before y are behind
            done = int(np.searchsorted(lens[rows], y, "right"))
            m, going = mine[cuts[y] : cuts[y + 1]], rows[done:]
            r, x, past = at_row[row[m]] - done, start[m], before[done:]
            total = past[:, : y + 1] + NIL_SCORE
            total[r, x] = np.where(np.isnan(score[m]), -np.inf, score[m] + past[r, x])
            total[np.isnan(total)] = -np.inf
            top = total.argmax(1)
            value = total[np.arange(len(going)), top]
            live = value > -1e300
            past[:, y + 1] = np.where(live, value, -1e300)
            at = off[going[live]] + y
            prev[at] = top[live]
            won = (top[r] == x) & live[r]
            at = off[row[m[won]]] + y
            cur[at], ids[at] = score[m[won]], entity[m[won]]


def alike(lens: np.ndarray, power: int, equal: bool = False, width: int = 1):  # noqa: ANN202
    """Rows by length, in parts of some CELLS of width * length ** power each, of one length if equal."""
    order = np.argsort(lens, kind="stable")
    order = order[lens[order] > 0]
    first = 0
    while first < len(order):
        n, last = lens[order[first]], first + 1
        if equal:
            last = min(int(np.searchsorted(lens[order], n, "right")), first + max(1, int(CELLS // (width * n**power))))
        else:
            # the longest row of a part gives its width
            most = lens[order[first:]]
            last = first + max(1, int(((np.arange(len(most)) + 1) * width * most**power <= CELLS).sum()))
        yield order[first:last]
        first = last


def by_maximum(lens: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, entity: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, entity, score) of the segments of segment.segment_max."""
    out = []
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(len(lens) + 1))
    for rows in alike(lens, 2, equal=True):
        n, q = int(lens[rows[0]]), len(rows)
        r, m = expanded(ends[rows], ends[rows + 1] - ends[rows])
        m = order[m]
        # by length less 1, row, begin
        own, who = np.full((n, q, n), NIL_SCORE), np.full((n, q, n), -1, np.int64)
        own[end[m] - start[m], r, start[m]], who[end[m] - start[m], r, start[m]] = score[m], entity[m]
        best, cut = np.zeros((n, q, n)), np.ones((n, q, n), np.int32)
        for length in range(n):
            w = n - length
            top, at = own[length, :, :w].copy(), np.full((q, w), length + 1, np.int32)
            for k in range(length):
                x, y = own[k, :, :w], best[length - k - 1, :, k + 1 : k + 1 + w]
                x = np.where(x > y, x, y)
                more = x > top
                top[more], at[more] = x[more], k + 1
            best[length, :, :w], cut[length, :, :w] = top, at
        live, j = np.arange(q), np.zeros(q, np.int64)
        while len(live):
            jump = cut[n - 1 - j, live, j].astype(np.int64)
            out.append((rows[live], j, j + jump - 1, who[jump - 1, live, j], own[jump - 1, live, j]))
            go = j + jump < n
            live, j = live[go], (j + jump)[go]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)


def ranked(row: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of elements by row, then the keys, and the place of each in its row from 1 on."""
    order = np.lexsort((*keys[::-1], row))
    r = row[order]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return order, np.arange(len(r)) - np.repeat(at, np.diff(np.r_[at, len(r)])) + 1


def matrix(vectors: pa.Array) -> np.ndarray | None:
    """Vectors as rows, None if their lengths differ or one is null."""
    if vectors.null_count or len(set(pc.unique(pc.list_value_length(vectors)).to_pylist())) > 1 or not len(vectors):
        return None
    flat = vectors.flatten()
    return None if flat.null_count else flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def small_vectors(df: DataFrame, key: str) -> tuple[pa.Array, np.ndarray] | None:
    """Keys and matrix of (key, vector) if it is small and keys occur once."""
    size = df.agg(F.max(F.size("vector"))).first()[0]
    t = small(df.select(key, "vector"), LOCAL_BYTES // (8 * max(size or 1, 1)))
    if t is None:
        return None
    keys, m = column(t, key), matrix(column(t, "vector"))
    return None if m is None or keys.null_count or len(pc.unique(keys)) < len(keys) else (keys, m)
