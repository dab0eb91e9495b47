"""MinHash near-duplicate detection.

One-permutation hashing: each word shingle falls in one of BINS bins and a bin keeps its least
value. Empty bins are filled by optimal densification: bin i tries the bins of a fixed random
sequence of its own until one is filled, so that fills of different bins are independent. Bands
of ROWS bins make bucket keys. In a bucket every document is joined to one other only, a
star: in what a task holds at a time to the least doc_id, and these to the least of all, so a bucket of n
documents gives n - 1 candidate edges, not n squared, and no more than one row from each task's hold is grouped by the bucket.
Documents with the same signature are joined to the least of them before banding.

Candidate edges are verified by the SKETCH least shingles of both documents: the share of those of the union that both
have. That is the Jaccard similarity itself where a document has no more shingles, and an estimate with a standard error of
0.03 beyond; the measure is one. Where an edge fails, its end goes through the rest of the bucket once
more: a pass in order of doc_id, in which a document that matches no centre so far becomes one,
so that every document has met a centre it matches or is one itself, and no candidate is left out;
only centres are held in memory. Buckets of more than SPLIT such ends are split by hash, and the centres of
the parts go through the same pass together. Groups are the connected components of the verified edges.

Null doc_ids can't be told apart and take no part; null, empty or wordless texts match nothing; rows of these stay.
Rows of one doc_id with different texts are documents of their own, in order of a fingerprint of the text; of rows equal in
doc_id and text the least in all columns stays. Documents of fewer than SHINGLE words have one shingle, all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import WORD_REGEX, cut, free_name, mix, numbered, own_numbers, row_bounds, shingle_hashes, slices, word_hashes

SHINGLE = 3
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Least similarity of near duplicates.
THRESHOLD = 0.45
#: Shingles of a document that similarities are taken from.
SKETCH = 2 * BINS
#: Bucket keys that a task holds to join documents on the spot; failed ends of a bucket beyond which it is split.
_HELD, SPLIT = 1 << 20, 4096

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = np.uint32(0xFFFFFFFF)


def densify(values: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a filled one; values: rows x bins."""
    bins = values.shape[1]
    filled = values != _EMPTY
    out = values.copy()
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        to = (mix(col.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[row, to]
        out[row[hit], col[hit]] = values[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return out


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, row = word_hashes(buf, offs)
    return shingle_hashes(h, row, SHINGLE)


def signatures(s: np.ndarray, at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x BINS 16-bit signature, and whether the row has any shingle; s, at: fingerprint and row of each shingle."""
    values = np.full(rows * BINS, _EMPTY, np.uint64)
    bin_ = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    np.minimum.at(values, at * BINS + bin_.astype(np.int64), mix(s))
    values = values.reshape(rows, BINS)
    some = (values != _EMPTY).any(1)
    return (mix(densify(values)) & np.uint64(0xFFFF)).astype(np.uint16), some


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Rows x BANDS bucket keys."""
    parts = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS)
    return mix(parts ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])


def sketches(s: np.ndarray, at: np.ndarray, rows: int) -> list[bytes]:
    """The SKETCH least distinct shingles of each row, cut to 32 bits."""
    short = (mix(s ^ np.uint64(SKETCH)) >> np.uint64(32)).astype(np.uint32)
    bounds = row_bounds(at, rows)
    return [np.unique(short[bounds[i] : bounds[i + 1]])[:SKETCH].tobytes() for i in range(rows)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in slices(batches):
        s, at = shingles(buf, offs)
        sig, some = signatures(s, at, rows.num_rows)
        keep = np.flatnonzero(some)
        least = sketches(s, at, rows.num_rows)
        sig = np.ascontiguousarray(sig[keep])
        same = mix(np.bitwise_xor.reduce(mix(sig.astype(np.uint64) + (np.arange(BINS, dtype=np.uint64) << np.uint64(16))[None, :]), axis=1)) if len(keep) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(keep)), pa.array(same.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([least[i] for i in keep], pa.binary())], ["doc_id", "same", "sig", "sketch"])


def _stars(ids: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    """Of each bucket the least doc_id stands for all that are held; the others are joined to it, under keys of their own."""
    bucket, ids = band_keys(sig).ravel(), np.repeat(ids, BANDS)
    order = np.lexsort((ids, bucket))
    bucket, ids = bucket[order], ids[order]
    head = np.r_[True, bucket[1:] != bucket[:-1]]
    least = ids[np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))]
    keep = head | (ids != least)
    bucket, ids, head, least = bucket[keep], ids[keep], head[keep], least[keep]
    key = np.where(head, bucket, mix(bucket ^ mix(ids.view(np.uint64)))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(least, mask=head), pa.array(bucket.view(np.int64), mask=head)], ["key", "doc_id", "least", "bucket"])


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sigs, n = [], [], 0
    for b in batches:
        if b.num_rows:
            ids.append(b.column("doc_id").to_numpy())
            sigs.append(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, BINS))
            n += b.num_rows
        if n * BANDS > _HELD:
            yield _stars(np.concatenate(ids), np.concatenate(sigs))
            ids, sigs, n = [], [], 0
    if n:
        yield _stars(np.concatenate(ids), np.concatenate(sigs))


def _matrix(sketch: list[bytes]) -> np.ndarray:
    """Rows x SKETCH, filled up with a value that no shingle has but by a chance of 2**-32."""
    out = np.full((len(sketch), SKETCH), _NONE, np.uint32)
    for i, x in enumerate(sketch):
        out[i, : len(x) // 4] = np.frombuffer(x, np.uint32)
    return out


def similar(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarity of the sketches in each row of p and q: of the SKETCH least of the union, the share that is in both."""
    both = np.sort(np.concatenate([p, np.broadcast_to(q, p.shape)], axis=1), axis=1)
    real = both != _NONE
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twice, axis=1)
    within = rank <= SKETCH
    union = np.minimum(rank[:, -1], SKETCH)
    return (twice & within).sum(1) / np.maximum(union, 1)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            like = similar(_matrix(part.column("sketch_a").to_pylist()), _matrix(part.column("sketch_b").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(like)], ["a", "b", "similarity"])


def _centres(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of bucket, part and doc_id: each is joined to the first centre it matches, or becomes one, which is told as an edge to itself."""
        now, centres = None, []
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                bucket, part, ids = (batch.column(c).to_numpy() for c in ("bucket", "part", "doc_id"))
                sketch = _matrix(batch.column("sketch").to_pylist())
                edges = []

                def meet(centre: tuple, rest: np.ndarray) -> np.ndarray:
                    like = similar(sketch[rest], centre[1][None, :])  # noqa: B023
                    ok = like >= threshold
                    edges.extend((bucket[r], centre[0], ids[r], x) for r, x in zip(rest[ok], like[ok]))  # noqa: B023
                    return rest[~ok]

                first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
                for lo, hi in zip(first, np.r_[first[1:], len(bucket)]):
                    if (bucket[lo], part[lo]) != now:
                        now, centres = (bucket[lo], part[lo]), []
                    rest = np.arange(lo, hi)
                    for c in centres:
                        if not len(rest):
                            break
                        rest = meet(c, rest)
                    while len(rest):
                        centres.append((ids[rest[0]], sketch[rest[0]].copy()))
                        edges.append((bucket[lo], ids[rest[0]], ids[rest[0]], 1.0))
                        rest = meet(centres[-1], rest[1:])
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["bucket", "a", "b", "similarity"])

    return run


def signature_table(docs: DataFrame) -> DataFrame:
    """doc_id, same (fingerprint of the signature), sig, sketch; one row a document that has words."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return d.mapInArrow(_sign, "doc_id long, same long, sig binary, sketch binary")


def _passed(ends: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """(bucket, a, b, similarity) of ends (bucket, part, doc_id) that match a centre; of a centre a = b."""
    rows = ends.join(sketch, "doc_id").select("bucket", "part", "doc_id", "sketch")
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "doc_id").mapInArrow(_centres(threshold), "bucket long, a long, b long, similarity double")


def verified_edges(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity), a < b: star edges that hold. sigs: a written table, as it is read several times."""
    # least ids are combined in each task; of a large group, the join is what the optimizer can split
    least = sigs.groupBy("same").agg(F.min("doc_id").alias("a"))
    stars = cut(sigs.select("doc_id", "same").join(least, "same").filter("doc_id <> a"))
    equal = stars.select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    heads = sigs.join(stars.select("doc_id", "same"), ["doc_id", "same"], "left_anti")
    buckets = heads.select("doc_id", "sig").mapInArrow(_band, "key long, doc_id long, least long, bucket long")
    by_key = Window.partitionBy("key").orderBy("doc_id")
    starred = buckets.select(F.coalesce("bucket", "key").alias("bucket"), F.col("doc_id").alias("b"), F.coalesce("least", F.first("doc_id").over(by_key)).alias("a")).filter("a <> b")
    starred = cut(starred)
    pairs = starred.select("a", "b").distinct()
    sketch = sigs.select("doc_id", "sketch")
    left, right = (sketch.select(F.col("doc_id").alias(k), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    checked = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agree, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    failed = checked.filter(F.col("similarity") < threshold).select("a", "b")
    rest = cut(starred.join(failed, ["a", "b"]).select("bucket", F.col("b").alias("doc_id")))
    large = rest.groupBy("bucket").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).filter("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0)).cast("int")
    first = cut(_passed(rest.join(large, "bucket", "left").withColumn("part", part), sketch, threshold))
    centres = first.filter("a = b").join(large, "bucket", "left_semi").select("bucket", F.lit(0).alias("part"), F.col("a").alias("doc_id"))
    more = first.unionByName(_passed(centres, sketch, threshold)).filter("a <> b").select("a", "b", "similarity")
    return equal.unionByName(checked.filter(F.col("similarity") >= threshold)).unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. Large-star and small-star steps until nothing changes; each round is written to the shared folder."""
    e = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(near, "u").select(F.col("m").alias("u"), "v")
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("u"), "v").union(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
        small = cut(small)
        # done when every node has one neighbour below it, and that one has none
        inner = small.select(F.col("v").alias("u")).distinct().join(small.select("u").distinct(), "u", "left_semi")
        if inner.isEmpty() and small.groupBy("v").count().filter("count > 1").isEmpty():
            return small.select(F.col("v").alias("node"), F.col("u").alias("root"))
        e = small


def _groups(docs: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of docs (doc_id, text)."""
    return components(verified_edges(cut(signature_table(docs)), threshold))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id): each document that is a near or exact copy, and the least doc_id of its group, which stays. Both are the same where they are texts of one doc_id."""
    own, _ = own_numbers(docs)
    found = _groups(numbered(docs, own), threshold)
    if own is None:
        return found.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))
    ids = own.select("own", "doc_id")
    found = found.join(ids.withColumnsRenamed({"own": "node"}), "node").join(ids.withColumnsRenamed({"own": "root", "doc_id": "kept_id"}), "root")
    return found.select("doc_id", "kept_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group."""
    own, twice = own_numbers(docs)
    print_, id_, row = (free_name(docs, c) for c in ("print_of", "gone_id", "row_of"))
    gone = _groups(numbered(docs, own), threshold).select(F.col("node").alias(id_)).distinct()
    here = docs["doc_id"].cast("long")
    if own is None:
        kept = docs.join(gone, here == gone[id_], "left_anti")
    else:
        gone = own.join(gone, F.col("own") == gone[id_], "left_semi").select(F.col("doc_id").alias(id_), F.col("print").alias(print_))
        kept = docs.join(gone, (here == gone[id_]) & (F.xxhash64(docs["text"]) == gone[print_]), "left_anti")
    if not twice:
        return kept
    # rows equal in doc_id and text, of those that have words
    single = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(f"(?i){WORD_REGEX}")
    least = kept.filter(~single).groupBy(F.col("doc_id").alias(id_), F.xxhash64("text").alias(print_)).agg(F.min(F.struct(*docs.columns)).alias(row))
    return kept.filter(single).unionByName(least.select(f"{row}.*"))
