"""Quality rules on repetition inside a document, from its suffix array.

The suffixes of a document's words are sorted by prefix doubling, all documents of a slice at
once; only suffixes that still tie are sorted again, so a text without repeats takes a few
rounds. The classes of each round give the longest common prefixes of neighbours in the suffix
array. A suffix's longest repeated prefix is the greater of its two; those of MIN_WORDS words or
more which no repeat one word to the left contains are the maximal repeated substrings. Their
spans are united, overlapping occurrences too. A document is kept if they cover at most
MAX_COVERED of its words and none is longer than MAX_REPEAT words.

Null, empty and short texts have no repeats: covered_fraction and longest_repeat are 0, and they
are kept. Every row is judged for itself, also those of a null or repeated doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import row_bounds, slices, word_hashes

MIN_WORDS = 5
MAX_COVERED = 0.3
MAX_REPEAT = 50


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys; for each place in it, where its group of equals begins and how large it is."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    return order, np.repeat(first, size), np.repeat(size, size)


def suffix_array(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix array of the words in h by rows, and the longest common prefix of each place with the one before it (0 at the first of a row). The number of rounds."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    _, word = np.unique(h, return_inverse=True)
    order, first, size = _dense(row * (int(word.max()) + 1) + word)
    rank = np.empty(n, np.int64)
    rank[order] = first
    classes = [rank.copy()]
    sa = order.copy()
    end = np.searchsorted(row, row, "right")
    places = np.flatnonzero(size > 1)
    k = 1
    while len(places):
        at = sa[places]
        ahead = at + k
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1)
        key = rank[at] * (n + 1) + second + 1
        o, f, s = _dense(key)
        # groups keep their places, so the sorted ones go back in order
        at = at[o]
        sa[places] = at
        rank[at] = places[f]
        classes.append(rank.copy())
        places = places[s > 1]
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1], sa[1:]
    live = np.flatnonzero(classes[0][a] == classes[0][b])
    a, b, got = a[live], b[live], np.zeros(len(live), np.int64)
    for level in range(len(classes) - 1, -1, -1):
        c = classes[level]
        x, y = a + got, b + got
        ok = (x < end[a]) & (y < end[b])
        same = np.zeros(len(a), bool)
        same[ok] = c[x[ok]] == c[y[ok]]
        got[same] += 1 << level
    lcp[live + 1] = got
    return sa, lcp, len(classes)


def repetition(h: np.ndarray, row: np.ndarray, rows: int, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words covered by repeats of `least` words or more, and the longest repeat, of each row."""
    n = len(h)
    bounds = row_bounds(row, rows)
    total = np.diff(bounds)
    covered, longest = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if n:
        sa, lcp, _ = suffix_array(h, row)
        best = np.zeros(n, np.int64)
        best[sa] = np.maximum(lcp, np.r_[lcp[1:], 0])
        best[best < least] = 0
        inner = np.zeros(n, bool)
        inner[1:] = (best[1:] + 1 == best[:-1]) & (row[1:] == row[:-1])
        at = np.flatnonzero((best > 0) & ~inner)
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + best[at], -1)
        covered += np.bincount(row[np.cumsum(mark[:n]) > 0], minlength=rows)
        np.maximum.at(longest, row[at], best[at])
    return total, covered, longest


def repetition_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc_id, n_words, covered_words, covered_fraction, longest_repeat, keep) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches):
            h, row = word_hashes(buf, offs)
            total, covered, longest = repetition(h, row, rows.num_rows)
            part = np.divide(covered, total, out=np.zeros(len(total)), where=total > 0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(total), pa.array(covered), pa.array(part), pa.array(longest), pa.array((part <= max_covered) & (longest <= max_repeat))], ["doc_id", "n_words", "covered_words", "covered_fraction", "longest_repeat", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, covered_words long, covered_fraction double, longest_repeat long, keep boolean")

