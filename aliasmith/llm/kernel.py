"""Vectorised text kernels over Arrow string batches, shared by the operators of this subpackage.

A batch of documents is handled as one flat byte buffer with offsets, in slices of a few
megabytes, so that work is numpy passes over bytes and memory stays bounded whatever the
batch holds. A document is never split or shortened: one that is longer than a slice is a
slice of its own.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased
text. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

WORD = np.zeros(256, bool)
WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD[_c] = True
#: The same words as a DuckDB or Java regular expression, on lower-cased text.
WORD_REGEX = "[0-9a-z\\x{80}-\\x{10ffff}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; where a session on one machine has none, one under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_numbers(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, name): the distinct keys numbered from 0 in their order. Ranges are sorted and counted each for itself, and the counts before a range added up; no task sees all keys."""
    spread = df.select(key.alias("key")).distinct().repartitionByRange("key").sortWithinPartitions("key")
    kept = cut(spread.withColumn("part", F.spark_partition_id()))
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return kept.join(F.broadcast(before), "part").select("key", (F.col("before") + within).alias(name))


def own_numbers(docs: DataFrame) -> tuple[DataFrame | None, bool]:
    """(doc_id, print, own): documents numbered in order of doc_id and a fingerprint of the text, if a doc_id has several texts, else nothing; and whether a doc_id occurs in several rows. Rows of null doc_id or text don't count."""
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print")).filter("doc_id is not null and text is not null")
    found = cut(prints.groupBy("doc_id").agg((F.min("print") != F.max("print")).alias("many"), (F.count("*") > 1).alias("twice")).filter("many or twice"))
    if found.filter("many").isEmpty():
        return None, not found.isEmpty()
    return cut(dense_numbers(prints, F.struct("doc_id", "print"), "own").select("key.doc_id", "key.print", "own")), True


def numbered(docs: DataFrame, own: DataFrame | None) -> DataFrame:
    """(doc_id, text) with the documents' own numbers for their doc_ids, where there are such."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if own is None:
        return d
    return d.withColumn("print", F.xxhash64("text")).join(own, ["doc_id", "print"]).select(F.col("own").alias("doc_id"), "text")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as set it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        out = []
        for base in (_P, inv):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > SLICE_BYTES + 1:
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", lower: bool = True, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in slices of about `size` bytes of whole documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        lens = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        ends = np.cumsum(lens)
        i = 0
        while i < len(lens):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + size, "right")))
            rows = batch.slice(i, j - i)
            part = rows.column(text)
            buf, offs = flat(pc.utf8_lower(part) if lower else part)
            yield rows, buf, offs
            i = j
    _release()


def _release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and others run beside them."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it belongs to."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = WORD[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    prev = np.empty(n, bool)
    prev[0] = False
    np.copyto(prev[1:], w[:-1])
    prev &= ~edge[:n]
    starts = np.flatnonzero(w & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    np.copyto(nxt[:-1], w[1:])
    nxt &= ~edge[1:]
    ends = np.flatnonzero(w & ~nxt) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of the bytes of each span, the same wherever the bytes lie."""
    p, inv = _powers_to(len(buf) + 1)
    pre = np.empty(len(buf) + 1, np.uint64)
    pre[0] = 0
    np.multiply(buf.astype(np.uint64) + np.uint64(1), p[: len(buf)], out=pre[1:])
    np.cumsum(pre[1:], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of every word."""
    starts, ends, row = words(buf, offs)
    return span_hash(buf, starts, ends), row


_GRAM = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of each run of n words; a row of fewer words has one run, all of them."""
    if not len(h):
        return h, row
    if len(h) >= n:
        s = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            s += h[k : k + len(s)] * _GRAM[k]
        ok = row[: len(s)] == row[n - 1 :]
        full, at = mix(s[ok]), row[: len(s)][ok]
    else:
        full, at = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    short = count < n
    if short.any():
        extra = []
        for f, c in zip(first[short], count[short]):
            extra.append(np.add.reduce(h[f : f + c] * _GRAM[:c]))
        full = np.r_[full, mix(np.array(extra, np.uint64) + np.uint64(n))]
        at = np.r_[at, row[first[short]]]
        order = np.argsort(at, kind="stable")
        full, at = full[order], at[order]
    return full, at


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """For row numbers in rising order: where each of `rows` rows begins, and the end."""
    return np.searchsorted(row, np.arange(rows + 1))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
