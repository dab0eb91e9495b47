"""Removal of long passages that documents share, by recompression.

Every document is a string of word fingerprints. A level of recompression first replaces each
maximal run of one symbol by one symbol, then merges pairs: a hash bit of its name puts each
symbol in a left or a right class, and every left symbol that a right one follows merges with
it. Symbols of FREEZE words or more merge no further. A name is a hash of what the symbol stands
for, so all executors name a run or a pair alike in every round, without asking each other.

With each symbol goes its context: the words on which it depends that it came about as it did.
Wherever these words stand, the same symbol stands at the same place among them. So a window of
LENGTH words that holds the whole context of a symbol of one place occurs nowhere else, and this is
the only reason for which a window is passed over: no repeat is missed.

Rounds in Spark:
1. all documents are recompressed and the names of their symbols grouped: which occur at more than
   one place;
2. every window that holds no context of a symbol of one place is named by two fingerprints of its words;
3. windows are grouped by name. Those at two or more places verify the repeat, word for word;
   the first place by (doc_id, position) is the one that stays.

A name or window that occurs often goes to the exchange at most twice, or once, from each _HELD rows
of a task; what else the task knows of it goes along under keys of its own, so that no passage, however
often it is repeated, makes a large group.

Results: a passage is a maximal span of words covered by windows that occur elsewhere, in another
document or the same one. Null doc_ids take no part and their rows stay as they are; null, empty
and short texts have no passages. Rows of one doc_id with different texts are documents of their own, in
order of a fingerprint of the text; rows that are equal in doc_id and text are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import SLICE_BYTES, cut, free_name, mix, numbered, own_numbers, row_bounds, slices, span_hash, words

LENGTH = 50
LEVELS = 8
FREEZE = 8
#: Symbols of fewer words are hardly ever at one place only, and are not counted.
LEAST = 4
_LONG_RUN = 16
_FAR = 1 << 40
#: Names or windows that a task holds to tell which it has met.
_HELD = 1 << 20
#: Beside a position, of less than 2**30 words: that all is known of the row; that its window occurs again.
_KNOWN, _AGAIN = 1 << 31, 1 << 30
_POSITION = _AGAIN - 1

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def recompress(h: np.ndarray, row: np.ndarray, levels: int = LEVELS, freeze: int = FREEZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words, begin and end of the context) of the top symbols of the word strings in h; symbols never cross rows, and one that depends on the end of a row has a context without end."""
    name, start = h.copy(), np.arange(len(h))
    size = np.ones(len(h), np.int64)
    lo, hi = start.copy(), start + 1
    for level in range(levels):
        if len(name) < 2:
            break
        # runs
        at = row[start]
        head = np.r_[True, (name[1:] != name[:-1]) | (at[1:] != at[:-1])]
        if not head.all():
            first = np.flatnonzero(head)
            total = np.add.reduceat(size, first)
            times = np.diff(np.r_[first, len(name)])
            lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
            name, start, size = name[first], start[first], total
            run = times > 1
            # very long runs are named alike, as windows inside them are equal
            k = np.where(total >= _LONG_RUN, 0, times)[run].astype(np.uint64)
            name[run] = mix(name[run] * _A + mix(k + np.uint64(0x52)))
            at = row[start]
        # a run ends at a neighbour of another name: its word next to the run shows that, else all that it depends on does
        end, inner = start + size, at[1:] == at[:-1]
        before, after = np.full(len(name), -_FAR), np.full(len(name), _FAR)
        before[1:] = np.where(inner, np.where(h[end[:-1] - 1] != h[end[1:] - 1], start[1:] - 1, lo[:-1]), -_FAR)
        after[:-1] = np.where(inner, np.where(h[start[1:]] != h[start[:-1]], end[:-1] + 1, hi[1:]), _FAR)
        lo, hi = np.minimum(lo, before), np.maximum(hi, after)
        # pairs
        right = (mix(name + np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        small = size < freeze
        merge = (~right[:-1]) & right[1:] & small[:-1] & small[1:] & inner
        # what merges depends on both, what doesn't on the neighbour that it might have merged with
        single = small.copy()
        single[:-1] &= ~merge
        single[1:] &= ~merge
        a, b = single & right, single & ~right
        before, after = np.r_[-_FAR, np.where(inner, lo[:-1], -_FAR)], np.r_[np.where(inner, hi[1:], _FAR), _FAR]
        lo, hi = np.where(a, np.minimum(lo, before), lo), np.where(b, np.maximum(hi, after), hi)
        left = np.flatnonzero(merge)
        if not len(left):
            continue
        name[left] = mix(name[left] * _A + name[left + 1] * _B + np.uint64(0x50))
        size[left] += size[left + 1]
        lo[left], hi[left] = np.minimum(lo[left], lo[left + 1]), np.maximum(hi[left], hi[left + 1])
        keep = np.ones(len(name), bool)
        keep[left + 1] = False
        name, start, size, lo, hi = name[keep], start[keep], size[keep], lo[keep], hi[keep]
    return name, start, size, lo, hi


def telling(h: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, begin and end of the context) of the symbols whose context fits in a window."""
    name, start, size, lo, hi = recompress(h, row)
    ok = (size >= LEAST) & (hi - lo <= length)
    return name[ok], start[ok], lo[ok], hi[ok]


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each of x is in `of`, which is sorted."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def _symbols(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """name, doc_id, at. The first two places of a name that a task meets are grouped by it; any further is known to be one of many."""
        once = twice = np.zeros(0, np.uint64)
        for rows, buf, offs in slices(batches):
            s, e, row = words(buf, offs)
            name, start, _, _ = telling(span_hash(buf, s, e), row, length)
            order = np.argsort(name, kind="stable")
            name, start = name[order], start[order]
            head = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
            nth = np.arange(len(name)) - np.repeat(head, np.diff(np.r_[head, len(name)]))
            nth += _member(name, once).astype(np.int64) + _member(name, twice)
            once, twice = np.union1d(once, name[nth == 0]), np.union1d(twice, name[nth == 1])
            if len(once) > _HELD:
                once = twice = once[:0]
            at = row[start]
            local = start - row_bounds(row, rows.num_rows)[at]
            known = nth > 1
            key = np.where(known, mix(name + np.arange(len(name), dtype=np.uint64)), name)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rows.column("doc_id").to_numpy()[at]), pa.array((local | known * _KNOWN).astype(np.uint32).view(np.int32))], ["name", "doc_id", "at"])

    return run


def _packed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of at least so many bytes, compressed."""
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            long = [i for i, x in enumerate(b.column("text")) if len(x.as_buffer()) >= least]
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(long, pa.int64())), pa.array([z.compress(texts[i].as_buffer()) for i in long], pa.binary())], ["doc_id", "packed"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size in bytes, however far the texts unpack."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        texts, lo, held = [], 0, 0
        for i, x in enumerate(b.column("packed").to_pylist()):
            texts.append(z.decompress(x))
            held += len(texts[-1])
            if held > 8 * SLICE_BYTES or i + 1 == b.num_rows:
                part = b.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), part.column("spots")], ["doc_id", "text", "spots"])
                texts, lo, held = [], i + 1, 0


def window_places(h: np.ndarray, row: np.ndarray, bounds: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """First words of the windows that may occur again. shared: first words of the symbols that do."""
    n = len(h)
    _, start, lo, hi = telling(h, row, length)
    many = np.zeros(n, bool)
    many[shared] = True
    alone = ~many[start]
    # windows that hold the context of a symbol of one place, as differences over first words
    a, b = np.maximum(hi[alone] - length, bounds[row[start[alone]]]), lo[alone] + 1
    gone = np.cumsum(np.bincount(a, minlength=n + 1)[:n] - np.bincount(b, minlength=n + 1)[:n]) > 0
    return np.flatnonzero((row == np.r_[row[length - 1 :], np.full(length - 1, -1)]) & ~gone)


def _spread(w1: np.ndarray, w2: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Of each window the first place stands for all that are held; the others, which come later, go under keys of their own."""
    order = np.lexsort((pos, ids, w2, w1))
    w1, w2, ids, pos = w1[order], w2[order], ids[order], pos[order]
    same = np.r_[False, (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])]
    # equal rows are one document
    twin = np.r_[False, same[1:] & (ids[1:] == ids[:-1]) & (pos[1:] == pos[:-1])]
    w1, w2, ids, pos, same = w1[~twin], w2[~twin], ids[~twin], pos[~twin], same[~twin]
    again = np.r_[same[1:], False] | same
    key = np.where(same, mix(ids.view(np.uint64) * _A + pos.astype(np.uint64)).view(np.int64), w1)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(w2 << 32 | pos | same * _KNOWN | again * _AGAIN), pa.array(ids)], ["w1", "w2", "doc_id"])


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for rows, buf, offs in slices(_unpacked(batches)):
            s, e, row = words(buf, offs)
            n = len(s)
            if n < length:
                continue
            bounds = row_bounds(row, rows.num_rows)
            h = span_hash(buf, s, e)
            spots = rows.column("spots")
            pos = spots.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & _POSITION
            count = np.diff(np.asarray(spots.offsets))[np.asarray(spots.is_valid())]
            at = window_places(h, row, bounds, np.repeat(bounds[:-1][np.asarray(spots.is_valid())], count) + pos, length)
            if not len(at):
                continue
            names = []
            for odd in (_A, _B):
                p = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, odd, np.uint64)])
                inv = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(int(odd), -1, 1 << 64), np.uint64)])
                pre = np.r_[np.uint64(0), np.cumsum(h * p[:n])]
                names.append(mix((pre[at + length] - pre[at]) * inv[at]).view(np.int64))
            # 96 bits of name, and the place, in two numbers
            held.append((names[0], names[1] & 0xFFFFFFFF, rows.column("doc_id").to_numpy()[row[at]], at - bounds[row[at]]))
            if sum(len(x[0]) for x in held) > _HELD:
                yield _spread(*(np.concatenate(x) for x in zip(*held)))
                held = []
        if held:
            yield _spread(*(np.concatenate(x) for x in zip(*held)))

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, pos, first): windows of `length` words that occur at two or more places; first: no earlier place has it. docs: of one text to a doc_id."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    symbols = d.mapInArrow(_symbols(length), "name long, doc_id long, at int")
    # neighbours in the order of places tell whether a name is at two places, without holding a group
    w = Window.partitionBy("name").orderBy("doc_id", "at")
    here = F.struct("doc_id", "at")
    differs = lambda x: F.coalesce(x != here, F.lit(False))
    shared = symbols.withColumn("shared", (F.col("at") < 0) | differs(F.lag(here).over(w)) | differs(F.lead(here).over(w))).filter("shared")
    spots = shared.groupBy("doc_id").agg(F.collect_list("at").alias("spots"))
    # texts travel compressed
    packed = d.mapInArrow(_packed(2 * length - 1), "doc_id long, packed binary")
    windows = packed.join(spots.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_windows(length), "w1 long, w2 long, doc_id long")
    low = lambda bits: F.col("w2").bitwiseAND(bits)
    placed = windows.repartition("w1").select("w1", F.shiftright("w2", 32).cast("int").alias("w2"), "doc_id", low(_POSITION).cast("int").alias("pos"), (low(_KNOWN) != 0).alias("known"), (low(_AGAIN) != 0).alias("again"))
    v = Window.partitionBy("w1", "w2").orderBy("doc_id", "pos")
    here = F.struct("doc_id", "pos")
    marked = placed.select("doc_id", "pos", "again", (F.col("known") | (F.first(here).over(v) != here)).alias("before"), differs(F.lead(here).over(v)).alias("after"))
    return marked.filter("again or before or after").select("doc_id", "pos", (~F.col("before")).alias("first"))


def _by_document(windows: DataFrame) -> DataFrame:
    """windows in order of doc_id and pos; what travels is two numbers a window."""
    w = windows.select("doc_id", (F.col("pos").cast("long") * 2 + F.col("first").cast("long")).alias("at")).repartition("doc_id").sortWithinPartitions("doc_id", "at")
    return w.select("doc_id", F.shiftright("at", 1).cast("int").alias("pos"), (F.col("at") % 2 == 1).alias("first"))


def _spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by doc_id and pos; a document may go on in the next batch."""
        doc = start = end = None
        for b in batches:
            ids, pos = b.column("doc_id").to_numpy(), b.column("pos").to_numpy().astype(np.int64)
            if not len(ids):
                continue
            new = np.r_[True, (ids[1:] != ids[:-1]) | (pos[1:] > pos[:-1] + length)]
            first = np.flatnonzero(new)
            d, s, e = ids[first], pos[first], pos[np.r_[first[1:], len(ids)] - 1] + length
            if doc is not None:
                if doc == d[0] and s[0] <= end:
                    s[0] = start
                else:
                    d, s, e = np.r_[doc, d], np.r_[start, s], np.r_[end, e]
            doc, start, end = d[-1], s[-1], e[-1]
            yield pa.RecordBatch.from_arrays([pa.array(d[:-1]), pa.array(s[:-1]), pa.array(e[:-1])], ["doc_id", "start_word", "end_word"])
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([start], pa.int64()), pa.array([end], pa.int64())], ["doc_id", "start_word", "end_word"])

    return run


def spans(windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word): the windows of each document united."""
    return _by_document(windows).mapInArrow(_spans(length), "doc_id long, start_word long, end_word long")


def shared_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word, later_words): every maximal span of words that occurs elsewhere; later_words counts those in windows that occur at an earlier place too, which removal takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            t = b.to_pandas()
            if carry is not None:
                t = pd.concat([carry, t], ignore_index=True)
            if not len(t):
                continue
            whole = t[t.doc_id != t.doc_id.iloc[-1]]
            carry = t[t.doc_id == t.doc_id.iloc[-1]]
            if len(whole):
                yield _measure(whole, length)
        if carry is not None and len(carry):
            yield _measure(carry, length)

    own, _ = own_numbers(docs)
    w = _by_document(repeated_windows(numbered(docs, own), length))
    found = w.mapInArrow(run, "doc_id long, start_word long, end_word long, later_words long")
    if own is None:
        return found
    back = own.select("own", F.col("doc_id").alias("_id"))
    return found.join(back, found["doc_id"] == back["own"]).select(F.col("_id").alias("doc_id"), "start_word", "end_word", "later_words")


def _measure(t: pd.DataFrame, length: int) -> pa.RecordBatch:
    ids, pos, later = t.doc_id.to_numpy(), t.pos.to_numpy().astype(np.int64), ~t["first"].to_numpy(bool)
    new = np.r_[True, (ids[1:] != ids[:-1]) | (pos[1:] > pos[:-1] + length)]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    # words that the later windows cover: each adds what reaches past the later window before it
    g, p = group[later], pos[later]
    add = np.full(len(p), length, np.int64)
    if len(p) > 1:
        same = g[1:] == g[:-1]
        add[1:] = np.where(same, np.minimum(length, p[1:] - p[:-1]), length)
    covered = np.bincount(g, add, len(first)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(pos[first]), pa.array(pos[np.r_[first[1:], len(ids)] - 1] + length), pa.array(covered)], ["doc_id", "start_word", "end_word", "later_words"])


def _remove(rows: pa.RecordBatch, text: str, cuts: str) -> list[str | None]:
    """Texts without the words of the cuts. Lower-casing keeps words and their order, so the words are counted in the texts as they are."""
    out = []
    at = 0
    spans_ = rows.column(cuts)
    for part, buf, offs in slices(iter([rows]), text, lower=False):
        s, e, row = words(buf, offs)
        bounds = row_bounds(row, part.num_rows)
        for i in range(part.num_rows):
            raw, last, keep = buf[offs[i] : offs[i + 1]].tobytes(), 0, []
            for c in sorted(spans_[at + i].as_py(), key=lambda x: x["start_word"]):
                keep.append(raw[last : s[bounds[i] + c["start_word"]] - offs[i]])
                last = e[bounds[i] + c["end_word"] - 1] - offs[i]
            keep.append(raw[last:])
            out.append(b"".join(keep).decode())
        at += part.num_rows
    return out


def drop_shared_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs without the passages that occur at an earlier place; documents of which no word is left are dropped. n_chars, where there is one, is set anew."""
    cut_id, cuts_name, print_ = free_name(docs, "cut_id"), free_name(docs, "cuts"), free_name(docs, "print_of")
    cols = docs.columns
    own, _ = own_numbers(docs)
    found = cut(spans(repeated_windows(numbered(docs, own), length).filter("not first"), length))
    cuts = found.groupBy(F.col("doc_id").alias(cut_id)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(cuts_name))
    if own is None:
        joined = docs.join(cuts.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col(cut_id), "left")
    else:
        cuts = cuts.join(own.select("doc_id", F.col("print").alias(print_), F.col("own").alias("_own")), F.col(cut_id) == F.col("_own")).select(F.col("doc_id").alias(cut_id), print_, cuts_name)
        joined = docs.join(cuts, (docs["doc_id"].cast("long") == cuts[cut_id]) & (F.xxhash64(docs["text"]) == cuts[print_]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column("text").to_pylist(), b.column(cuts_name)
            hit = np.flatnonzero(np.asarray(at.is_valid()))
            gone = np.zeros(b.num_rows, bool)
            if len(hit):
                for i, x in zip(hit, _remove(b.take(pa.array(hit)), "text", cuts_name)):
                    texts[i] = x
                    gone[i] = not any(c.isalnum() or ord(c) >= 128 for c in x)
            columns = [pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in cols]
            yield pa.RecordBatch.from_arrays(columns, cols).filter(pa.array(~gone))

    out = joined.select(*[docs[c] for c in cols], cuts_name).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out
