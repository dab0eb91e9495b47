"""Queries without SQL against slow transcriptions of the whole job."""

import numpy as np

from aliasmith.operators import embedding, mining, segment
from aliasmith.functions.scoring import importance
from aliasmith.queries import vectors


def test_kmeans_query_runs_to_convergence(spark, tmp_path):
    r = np.random.default_rng(5)
    x, now = r.standard_normal((300, 8)), r.integers(0, 10, 300)
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), now))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rounds = 0
    while rounds < 100:
        live = np.unique(now)
        c = np.stack([x[now == k].mean(0) for k in live])
        cos = x @ c.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(c, axis=1)
        new, rounds = live[cos.argmax(1)], rounds + 1
        if (new == now).all():
            break
        now = new
    assert 5 < rounds < 100
    assert {r.word: r.cluster for r in vectors.kmeans(spark, str(tmp_path)).collect()} == dict(enumerate(now.tolist()))


def test_entities_are_trained_on_all_words(spark):
    v = {"a": [1.0, 0.2, 0.1], "b": [0.1, 1.0, -0.3], "z": [-0.5, 0.3, 1.0]}
    words = ["a"] * 300 + ["b"] * 500
    table = spark.createDataFrame(list(v.items()), "word string, vector array<double>")
    got = embedding.train_entities(spark.createDataFrame([("e", " ".join(words))], "entity string, words string"), table, rho=40).first().vector
    x = np.array([v[k] for k in words] + [v["z"]] * 40)
    want = embedding.fit_logistic(x, np.r_[np.ones(800), np.zeros(40)])
    assert np.abs(np.array(got) - want).max() < 1e-3


def test_redirects_are_followed_however_far(spark):
    r = np.random.default_rng(2)
    edges = [(f"p{i}", f"p{i + 1}") for i in range(300)]  # one long chain
    edges += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("in", "c3"), ("in2", "in"), ("self", "self")]
    edges += [(f"r{i}", f"r{r.integers(0, 60)}") for i in range(60)] + [("r5", "r1")]
    step = {}
    for a, b in edges:
        step[a] = min(b, step.get(a, b))
    step = {a: b for a, b in step.items() if a != b}
    want = {}
    for a in step:
        trail = [a]
        while trail[-1] in step and step[trail[-1]] not in trail:
            trail.append(step[trail[-1]])
        want[a] = a if step.get(trail[-1]) == a else trail[-1]
    found = spark.createDataFrame(edges, "source string, target string")
    got = [tuple(x) for x in mining.redirect_closure(found).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert mining.redirect_closure(found.limit(0)).count() == 0


def test_negatives_are_drawn_from_all_other_words(spark):
    r = np.random.default_rng(3)
    table = spark.createDataFrame([(f"w{i}", r.standard_normal(3).tolist()) for i in range(6000)], "word string, vector array<double>")
    d = spark.createDataFrame([("e", "w1 w2 w2"), ("f", " ".join(f"w{i}" for i in range(6000)))], "entity string, words string")
    got = {x.entity: len(x.vector) for x in embedding.train_entities(d, table, rho=500, most=3).collect()}
    assert got == {"e": 3, "f": 3}


def test_assignment_in_blocks_of_centres(spark, monkeypatch):
    r = np.random.default_rng(4)
    v, c = r.standard_normal((200, 5)), r.standard_normal((30, 5))
    v[7], c[3] = 0, 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "word long, vector array<double>")
    centres = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "cluster int, vector array<double>")
    norm = lambda x: x / np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)[:, None]
    cos = norm(v) @ norm(c).T
    for size in (64, 1 << 20):
        monkeypatch.setattr(embedding, "CENTRE_BYTES", size)
        got = {x.word: (x.cluster, x.closeness) for x in embedding.assign_closest(vectors, centres).collect()}
        assert got.pop(900) == got.pop(901) == (-1, -1.0)
        assert [got[i][0] for i in range(200)] == cos.argmax(1).tolist() and np.allclose([got[i][1] for i in range(200)], cos.max(1))


def test_start_from_the_first_vectors(spark):
    r = np.random.default_rng(5)
    v = spark.createDataFrame([(f"w{i:03}", r.standard_normal(4).tolist()) for i in range(50)], "word string, vector array<double>")
    got = embedding.kmeans_cosine(v, 3).collect()
    assert len(got) == 50 and {x.cluster for x in got} <= {0, 1, 2}


def test_a_long_query(spark):
    words = spark.createDataFrame([(1, [f"w{i}" for i in range(2300)])], "query_id int, words array<string>")
    met = spark.createDataFrame([(1, 2200, 2201, 7, -1.5), (1, 0, 0, 8, -2.0)], "query_id int, start int, end int, entity_id int, score double")
    got = [tuple(x)[1:] for x in segment.segment(words, met).filter("entity_id >= 0").collect()]
    assert sorted(got) == [(0, 0, 8, -2.0), (2200, 2201, 7, -1.5)]


def test_importance_with_search_counts(spark):
    names = ["search_total", "alt_total", "graph_total", "entity_total", "search_alias_freq", "alt_alias_freq", "graph_alias_freq", "search_alias_entity_freq", "alt_alias_entity_freq", "graph_alias_entity_freq", "search_clicks"]
    rows = [(40, 25, 100, 3, 30, 20, 60, 12, 7, 33, 9), (0, 5, 10, 1, 0, 2, 4, 0, 1, 4, 0)]
    d = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    for row, got in zip(rows, d.select(*[c.alias(k) for k, c in importance().items()]).collect()):
        st, at, gt, n, saf, aaf, gaf, saef, aaef, gaef, clicks = map(float, row)
        ps, sa, se = (st + 1) / (st + gt + 2), (clicks + 1) / (st + 2), (saef + 1) / (saf + n)
        aa, ae, ga, ge = (aaf + 1) / (at + 2), (aaef + 1) / (aaf + n), (gaf + 1) / (gt + 2), (gaef + 1) / (gaf + n)
        ws, wa = (st + 1) / (st + at + gt + 3), (at + 1) / (st + at + gt + 3)
        want = {"search_prob_phrase": ps, "search_prob_alias": sa, "search_prob_entity_alias": se, "alt_search_prob_alias": aa, "alt_search_prob_entity_alias": ae, "search_weight": ws, "alt_search_weight": wa}
        want |= {"graph_prob_phrase": 1 - ps, "graph_prob_alias": ga, "graph_prob_entity_alias": ge, "graph_weight": 1 - ws - wa, "link_importance_00": ps * sa * se + (1 - ps) * ga * ge}
        want |= {"link_importance_01": ps * ga * se + (1 - ps) * ga * ge, "link_importance_02": ws * sa * se + wa * aa * ae + (1 - ws - wa) * ga * ge}
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and set(want) == set(got.asDict())
