"""Tables in the tasks and tables that are joined give the same results; neither makes rows of every pair or span."""

import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from aliasmith import queries
from aliasmith.operators import batch, coherence
from aliasmith.plans import linking as plans
from aliasmith.queries import linking

BY_FINDING = {
    "F1": "best_backward",
    "F2": "best_merged",
    "F3": "coherent_dp",
    "F4": "link_texts",
    "F5": "rank_contextual",
    "F6": "segment_max_v2",
    "F7": "context_cosine",
    "F8": "context_centroid",
    "F9": "segment_textbook",
    "F10": "context_biased",
    "F11": "context_normalizer",
    "F12": "greedy_topk",
    "F13": "segment_dp",
    "F14": "context_logistic",
    "F15": "link_queries",
    "F17": "grid_link",
    "F19": "context_type",
}


@pytest.mark.parametrize("name", BY_FINDING.values(), ids=BY_FINDING.keys())
def test_local_is_joined(spark, monkeypatch, name):
    got = rows_of(queries.QUERIES[name](spark, DATA))
    monkeypatch.setattr(batch, "LOCAL_ROWS", 0)
    monkeypatch.setattr(coherence, "MATRIX", 0)
    assert got == rows_of(queries.QUERIES[name](spark, DATA))
    assert len(got[1]) > 0


def test_pair_totals_are_those_of_all_mentions(spark):
    # F16; F18: the plan
    m, c, names, vectors = linking._texts(spark, DATA)
    d = plans.text_candidates(m, c, names).select("doc_id", F.col("place").alias("pos"), "surface", "k", "entity")
    want = coherence.pair_scores(d, vectors).groupBy("p", "c").agg(F.count("*").alias("n"), F.round(F.sum("pair"), 3).alias("pair"))
    near = lambda rows: {(r.p, r.c): (r.n, pytest.approx(r.pair, abs=0.01)) for r in rows}
    assert near(queries.QUERIES["mention_pairs"](spark, DATA).collect()) == {(r.p, r.c): (r.n, r.pair) for r in want.collect()}
    # mentions are placed before they become rows of candidates
    plan = plans.text_candidates(m, c, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1
