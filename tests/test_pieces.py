"""Texts and documents put together in the tasks from rows in order are those of the JVM, and lines are read and sent once."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from aliasmith import queries
from aliasmith.operators import batch, coherence, segment
from aliasmith.queries import fixtures

BY_FINDING = {
    "F1": "best_backward",
    "F2": "best_merged",
    "F4": "link_texts",
    "F7": "context_cosine",
    "F9": "segment_textbook",
    "F10": "context_biased",
    "F11": "context_normalizer",
    "F12": "greedy_topk",
    "F13": "segment_dp",
}


@pytest.mark.parametrize("name", BY_FINDING.values(), ids=BY_FINDING.keys())
def test_lines_are_sent_once_and_gathered_in_no_row(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("l_orderkey") > 0
    assert not any(x in plan for x in ("Aggregate", "Window", "collect_"))
    assert plan.count("Join") == 1


def test_mentions_are_sent_once(spark):
    # F16, F18
    m = spark.createDataFrame([(1, 1, "a")], "doc_id long, pos int, surface string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(coherence.placed(m)).count("Exchange hashpartitioning") == 1
    d = queries.QUERIES["text_candidates"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert d.count("RepartitionByExpression") == 1 and "l_orderkey" in d
    found = spark.createDataFrame([("a", 0, "e")], "surface string, k int, entity string")
    assert "Window" not in plan(coherence._neighbours(m, found))


def test_candidates_count_lines_before_they_meet_the_parts(spark):
    plan = fixtures.candidates(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(plan) if "Join" in x)
    assert any("Aggregate [l_partkey" in x for x in plan[at:])


NAMES = ["red pen", "Red  PEN", "", " ", None, "--", "İstanbul Σ", "ΣΑΣ", "x", "With; with", "a,b;c", "𝔘 u", "é-e", "red pen"]


def _tables(spark, path):
    r = np.random.default_rng(7)
    lines = [(int(r.integers(0, 400)), int(r.integers(0, 18)), int(r.integers(0, 4))) for _ in range(3000)] + [(1000, k, 1) for k in (4, 5)] + [(1001, 4, 1), (1002, 3, 1), (None, 0, 1), (None, 8, 2)]
    # part 13 has two names, parts beyond 15 don't exist
    parts = [(i, n, f"Brand#{i % 3}" if i != 5 else None) for i, n in enumerate(NAMES)] + [(13, "blue pen", "Brand#1"), (14, "A", "Brand#4"), (15, "a", "Brand#4")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_pieces_are_the_tokens_of_the_text(spark, tmp_path):
    d = _tables(spark, tmp_path)
    want = rows_of(segment.tokenized(fixtures.query_texts(spark, d)))
    lines = fixtures.table(spark, d, "lineitem").join(fixtures.table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    asked = {(r.l_orderkey, r.p_brand) for r in lines.select("l_orderkey", "p_brand").distinct().collect()}
    key = lambda x: (x is None, x)
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            pieces = fixtures.query_pieces(spark, d, ("brand", F.col("p_brand")))
            assert rows_of(pieces.words()) == want
            got = pieces.rows.mapInArrow(lambda b: segment.put_together(b, "with", "brand"), "query_id long, words array<string>, asked array<struct<brand:string>>").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len({r.query_id for r in got}) == len(got)
        assert sorted(((r.query_id, x.brand) for r in got for x in r.asked), key=lambda x: tuple(map(key, x))) == sorted(asked, key=lambda x: tuple(map(key, x)))


def test_whole_keys_in_one_batch():
    r = np.random.default_rng(8)
    keys = np.sort(r.integers(0, 60, 500)).tolist() + [None] * 30
    b = pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "v": pa.array(range(530))})
    for cuts in ([], [3], *[np.unique(r.integers(0, 531, n)).tolist() for n in (5, 50, 400)]):
        parts = [b.slice(x, y - x) for x, y in zip([0, *cuts], [*cuts, 530])]
        got = list(batch.whole(iter(parts), "k"))
        assert sum((x.column("v").to_pylist() for x in got), []) == list(range(530))
        seen = [set(x.column("k").to_pylist()) for x in got]
        assert all(x.num_rows for x in got) and sum(map(len, seen)) == len(set(keys))
    assert list(batch.whole(iter([]), "k")) == []


def test_several_mentions_of_a_place(spark, monkeypatch):
    # F16: the least counts, blanks aside only afterwards; a place without a surface stays
    rows = [(1, 1, "b"), (1, 1, " c"), (1, 2, None), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (2, 1, "b"), (2, 9, "c"), (None, 1, "a"), (None, 2, "c")]
    m = spark.createDataFrame(rows, "doc_id long, pos int, surface string")
    assert rows_of(coherence.placed(m))[1] == sorted([(1, 1, "c"), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (2, 1, "b"), (2, 9, "c"), (None, 1, "a"), (None, 2, "c")], key=repr)
    found = spark.createDataFrame([(x, 0, "e") for x in "abc"], "surface string, k int, entity string")
    count = lambda: sorted(tuple(x) for x in coherence._neighbours(m, found).groupBy("_before", "surface").agg(F.sum("n")).collect())
    got = count()
    assert got == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1)]
    monkeypatch.setattr(batch, "LOCAL_ROWS", 0)
    assert got == count()
