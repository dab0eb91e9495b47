"""Rows packed by their tasks give what joins and sorts of the JVM give, and are sent as columns of few bytes a row."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from aliasmith import queries
from aliasmith.operators import batch, coherence, packed
from aliasmith.queries import linking

BY_FINDING = {"F2": "best_merged", "F4": "link_texts", "F10": "context_biased", "F11": "context_normalizer", "F16": "mention_pairs", "F18": "text_candidates"}


@pytest.mark.parametrize("name", ["F2", "F4", "F10", "F11", "F18"])
def test_no_line_is_sent_or_sorted_as_a_row(spark, name):
    plan = queries.QUERIES[BY_FINDING[name]](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sent = next(i for i, x in enumerate(plan) if "RepartitionByExpression" in x)
    assert any("[bucket" in x and "data" in x and "MapInArrow" in x for x in plan[sent + 1 : sent + 3])
    assert not any("Sort " in x for x in plan)


def test_few_bytes_a_line():
    r = np.random.default_rng(3)
    n = 100_000
    lines = pa.RecordBatch.from_pydict({"key": pa.array(r.integers(0, 150_000, n)), "pos": pa.array(r.integers(1, 8, n), pa.int32()), "name": pa.array([f"name of part {i}" for i in r.integers(0, 64, n)])})
    sent = sum(len(x) for b in packed._packed(iter([lines]), "key", 20) for x in b.column("data").to_pylist())
    assert sent < 6 * n


def test_bytes_and_back():
    r = np.random.default_rng(4)
    wide = pa.array([-(2**63), 2**63 - 1, 0], pa.int64())
    columns = [wide, pa.array([3, 3, 900], pa.int32()), pa.array([5, -7, 5], pa.int16()), pa.array([None, 1, 2], pa.int64()), pa.array(["a", None, "é"]).dictionary_encode(), pa.array(r.normal(size=3))]
    b = pa.RecordBatch.from_arrays(columns, names=list("abcdef"))
    assert packed._of_bytes(packed._to_bytes(b)).equals(b)


def test_matched_is_the_join_in_order(spark, monkeypatch):
    r = np.random.default_rng(5)
    lines = [(int(r.integers(-40, 40)) or None, int(r.integers(0, 3)), int(r.integers(-5, 30))) for _ in range(2000)] + [(2**62, 1, 4), (-(2**63), 1, 4), (7, None, 4), (7, 1, None)]
    table = [(i, f"n{i % 7}" if i % 5 else None, i % 3) for i in range(-5, 20)] + [(4, "another", None), (4, "another", None), (None, "n", 1)]
    a, b = spark.createDataFrame(lines, "key long, pos int, on long"), spark.createDataFrame(table, "on int, name string, asked int")
    want = rows_of(a.join(b, "on").select("key", "pos", "on", "name", "asked"))
    for rows, text in ((1 << 20, False), (50, False), (50, True)):
        monkeypatch.setattr(packed, "ROWS", rows)
        x, y = (a.withColumn("on", F.col("on").cast("string")), b.withColumn("on", F.col("on").cast("string"))) if text else (a, b)
        d = packed.matched(x, y, "on", "key", ["pos", "name"])
        if not text:
            assert rows_of(d.rows()) == want
        # in order, and a key in one task
        got = d.rows().withColumn("part", F.spark_partition_id()).collect()
        assert len(got) == len(want[1])
        first = lambda v: (v is not None, v)
        order = [(t.part, first(t.key), first(t.pos), first(t["name"])) for t in got]
        assert all(p != q or u <= v for (p, *u), (q, *v) in zip(order, order[1:]))
        assert len({(t.part, t.key) for t in got}) == len({t.key for t in got})


def test_mentions_as_lines_are_those_as_rows(spark, monkeypatch):
    # F18, F16
    lines = [(1, 1, 0), (1, 1, 1), (1, 2, 9), (1, 4, 2), (1, 3, 3), (2, 5, 0), (2, 5, 3), (None, 1, 0), (None, 2, 2), (3, 1, 9)]
    table = [(0, "b"), (1, " a"), (2, "c "), (3, "gone"), (3, None), (9, None)]
    m = coherence.Mentions(spark.createDataFrame(lines, "doc_id long, pos int, on long"), spark.createDataFrame(table, "on long, surface string"), "on")
    found = spark.createDataFrame([(x, 0, "e") for x in "abc"], "surface string, k int, entity string")
    got = rows_of(coherence.in_places(m, found)), rows_of(coherence.in_places(m.rows(), found)), rows_of(coherence._neighbours(m, found).groupBy("_before", "surface").agg(F.sum("n").alias("n")))
    assert got[0] == got[1] and got[0][1] == [(1, 1, 1, "a"), (1, 2, 4, "c"), (2, 1, 5, "b"), (None, 1, 1, "b"), (None, 2, 2, "c")]
    monkeypatch.setattr(batch, "LOCAL_ROWS", 0)
    assert got[0][1] == rows_of(coherence.in_places(m, found))[1]
    assert got[2] == rows_of(coherence._neighbours(m, found).groupBy("_before", "surface").agg(F.sum("n").alias("n")))


def test_candidates_of_texts_are_those_of_rows(spark):
    # F18
    from aliasmith.plans import linking as plans

    m, c, names, _ = linking._texts(spark, DATA)
    want = plans.text_candidates(m, c, names).select("doc_id", "pos", "surface", F.col("place").cast("int").alias("place"), F.col("k").cast("int").alias("k"), "entity_id", "entity")
    assert rows_of(queries.QUERIES["text_candidates"](spark, DATA)) == rows_of(want)
