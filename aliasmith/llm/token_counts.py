"""Token counts of documents in flat token files, by a scan for separators.

A token file is a row of fixed-width ids without header or index; an end-of-document id closes
each document. Files are read in blocks of a fixed size, whatever documents they cut. In a block
one vectorised comparison finds the separators: their distances are the counts of the documents
inside it, and what lies before the first and after the last is left open. A prefix scan over the
blocks of each file, in Spark, carries the open ends across any number of blocks without a
separator and gives every document its place.

Adjoining separators enclose a document of 0 tokens. Tokens after the last separator are a
document that isn't ended; an empty file has none. Bytes short of a whole id at the end of a file
are not read. Null and empty texts are written as documents of 0 tokens; rows of null or repeated
doc_id are counted each for itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .kernel import cut, shared_dir, slices

#: The vocabulary for many languages, whose id 50256 is free.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256
DTYPE = "<u2"
BLOCK_BYTES = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, path: str = VOCABULARY, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """(file, ordinal, doc_id): the texts encoded into token files in `folder`, one a task, and where each document went.

    Only files named in the result count: one of a task that was lost or run twice is not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        file = f"{folder}/{uuid.uuid4().hex}.tok"
        system, name = _open(file)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        done = 0
        with system.open_output_stream(name) as out:
            for rows, buf, offs in slices(batches, lower=False):
                ids, bounds = v.encode(buf, offs)
                if len(ids) and (ids.max() > np.iinfo(dtype).max or (ids == separator).any()):
                    raise ValueError("the vocabulary has ids that don't fit the file or the id of the separator")
                out.write(np.insert(ids.astype(dtype), bounds[1:], np.array(separator, dtype)).tobytes())
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.arange(done, done + n)), rows.column("doc_id")], ["file", "ordinal", "doc_id"])
                done += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, ordinal long, doc_id long")


def scan_block(tokens: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """Separators, tokens before the first of them, tokens after the last, and counts between them; with none, all are after."""
    at = np.flatnonzero(tokens == separator)
    if not len(at):
        return 0, 0, len(tokens), at
    return len(at), int(at[0]), len(tokens) - int(at[-1]) - 1, np.diff(at) - 1


def block_summaries(files: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, n_separators, head, tail, inner) of every block of the files in column `file`."""
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                system, name = _open(file)
                n = system.get_file_info(name).size // width * width
                at = np.arange(0, n, block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(np.arange(len(at))), pa.array(np.minimum(block_bytes, n - at))], ["file", "block", "size"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, size in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("size").to_pylist()):
                system, name = _open(file)
                with system.open_input_file(name) as f:
                    n, head, tail, inner = scan_block(np.frombuffer(f.read_at(size, block * block_bytes), dtype), separator)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([n]), pa.array([head]), pa.array([tail]), pa.array([inner], pa.list_(pa.int64()))], ["file", "block", "n_separators", "head", "tail", "inner"])

    blocks = files.select("file").distinct().mapInArrow(plan, "file string, block long, size long").repartition("file", "block")
    return blocks.mapInArrow(scan, "file string, block long, n_separators long, head long, tail long, inner array<long>")


def stitch(summaries: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document. summaries: a written table, as it is read twice."""
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # tokens since the last separator: the running sum of tails, less what it was before the block that holds that separator
    running = summaries.select("file", "block", "n_separators", "tail", F.sum("tail").over(w).alias("total"), F.coalesce(F.sum("n_separators").over(before), F.lit(0)).alias("first"), F.lead("block").over(w).isNull().alias("final"))
    marked = running.withColumn("mark", F.when(F.col("n_separators") > 0, F.col("total") - F.col("tail")))
    carried = marked.withColumn("carry", F.col("total") - F.col("tail") - F.coalesce(F.last("mark", True).over(before), F.lit(0)))
    inside = summaries.filter("n_separators > 0").join(carried.select("file", "block", "first", "carry"), ["file", "block"])
    ended = inside.select("file", "first", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    left = F.col("tail") + F.when(F.col("n_separators") > 0, 0).otherwise(F.col("carry"))
    open_ = carried.filter("final").select("file", (F.col("first") + F.col("n_separators")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return ended.unionByName(open_)


def count_files(files: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the token files named in column `file`."""
    return stitch(cut(block_summaries(files, separator, dtype, block_bytes)))


def token_counts(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) of every row: docs written as token files in the shared folder, then counted there."""
    placed = cut(write_tokens(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", path, separator))
    counts = count_files(placed, separator, block_bytes=block_bytes)
    return placed.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
