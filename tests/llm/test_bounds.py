"""Hostile texts, and what a task or the driver holds."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from test_operators import docs_of, words

from aliasmith.llm import decontaminate, html_extract, token_counts, toxicity
from aliasmith.llm.kernel import flat


def test_repeated_words_against_repeated_words():
    items = decontaminate.Items([1], ["again " * 300])
    began = time.perf_counter()
    found = items.search(*flat(pa.array(["again " * 60_000])), 0.25)
    assert time.perf_counter() - began < 2 and found == [(0, 0, 0, 1.0)]


def test_common_weight_is_that_of_the_multisets():
    r = random.Random(1)
    for k in range(200):
        item = r.choices("abc", k=r.randint(1, 12))
        text = r.choices("abcd", k=r.randint(1, 60))
        items = decontaminate.Items([1], [" ".join(item)])
        got = items.search(*flat(pa.array([" ".join(text)])), 0.2)
        n = min(3, len(item))
        best = (0.0, 0)
        for p in range(max(1, len(text) - len(item) + 1)):
            w = text[p : p + len(item)]
            a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (w, item))
            both = sum(min(a.count(s), b.count(s)) for s in set(a))
            best = max(best, (both / max(1, len(a) + len(b) - both), -p))
        want = [] if best[0] < 0.2 else [(0, 0, -best[1])]
        assert [x[:3] for x in got] == want and all(abs(x[3] - best[0]) < 1e-9 for x in got)


def test_items_that_all_share_a_shingle(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_HITS", 50)
    r = random.Random(2)
    texts = [f"one two three {words(r, 8)}" for _ in range(40)]
    items = decontaminate.Items(list(range(40)), texts)
    body = " ".join(f"{words(r, 5)} {t}" for t in texts)
    assert [(i, s) for _, i, _, s in items.search(*flat(pa.array([body])), 0.5)] == [(i, 1.0) for i in range(40)]


def test_items_in_groups(spark):
    r = random.Random(3)
    texts = [words(r, 20) for _ in range(7)]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    assert [len(g) for g in decontaminate.item_groups(b, 2 * len(texts[0]))] != [7] and sum(map(len, decontaminate.item_groups(b, 200))) == 7


def test_deep_nesting():
    began = time.perf_counter()
    texts, features = html_extract.blocks("".join(f'<div class="c{i}">t{i}' for i in range(20_000)) + "</section>" * 20_000 + "</div>" * 20_000)
    assert time.perf_counter() - began < 3 and len(texts) == 20_000
    in_div, parent = html_extract._ID["in-div"], html_extract._ID["parent-div"]
    assert all(in_div in f and parent in f for f in features)
    texts, features = html_extract.blocks('<nav class="menu"><div>a</div></nav><p>b')
    assert texts == ["a", "b"] and html_extract._ID["name-menu"] in features[0] and html_extract._ID["in-nav"] in features[0] and html_extract._ID["in-nav"] not in features[1]


def test_a_separator_that_the_vocabulary_has(spark, tmp_path):
    d = docs_of(spark, [(1, "some text of several words")])
    first = token_counts.vocabulary(token_counts.VOCABULARY).encode(*flat(pa.array(["some text"])))[0][0]
    with pytest.raises(Exception, match="separator"):
        token_counts.write_tokens(d, str(tmp_path), separator=int(first)).collect()


def slow_toxicity(rows, labels, score):
    """The classifier with dictionaries of n-grams, a text at a time."""
    import math

    def grams(t):
        b, out = t.lower().encode(), []
        for n in toxicity.ORDERS:
            for i in range(len(b) - n + 1):
                h = b[i]
                for c in b[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                out.append((((h ^ ((n - 1) * 0x9E3779B1 & 0xFFFFFFFF)) * 2654435761) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        return out

    x = {i: grams(t) for i, t in rows}
    train = sorted(i for i in labels)
    n = [sum(labels[i] == k for i in train) for k in (0, 1)]
    seen = [{}, {}]
    for i in train:
        for g in set(x[i]):
            seen[labels[i]][g] = seen[labels[i]].get(g, 0) + 1
    r = {}
    for g in set(seen[0]) | set(seen[1]):
        c, t = seen[0].get(g, 0), seen[1].get(g, 0)
        v = math.log((1 + t) / (2 + n[1])) - math.log((1 + c) / (2 + n[0]))
        if c + t >= toxicity.LEAST_TEXTS and abs(v) >= toxicity.LEAST_RATIO:
            r[g] = v
    f = {i: {g: x[i].count(g) / len(x[i]) * r[g] for g in set(x[i]) if g in r} for i in x}
    unit = 1 / (math.sqrt(sum(v * v for i in train for v in f[i].values()) / len(train)) + 1e-12)
    w, m, v, b, mb, vb = {g: 0.0 for i in train for g in f[i]}, {}, {}, 0.0, 0.0, 0.0
    for t in range(1, toxicity.STEPS + 1):
        gw, gb = {g: toxicity.L2 * k for g, k in w.items()}, 0.0
        for i in train:
            z = sum(k * unit * w[g] for g, k in f[i].items()) + b
            e = 0.5 / n[labels[i]] * (1 / (1 + math.exp(-z)) - labels[i])
            gb += e
            for g, k in f[i].items():
                gw[g] += k * unit * e
        step = 0.3 * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for g, k in gw.items():
            m[g], v[g] = 0.9 * m.get(g, 0) + 0.1 * k, 0.99 * v.get(g, 0) + 0.01 * k * k
            w[g] -= step * m[g] / (math.sqrt(v[g]) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= step * mb / (math.sqrt(vb) + 1e-9)
    return {i: 1 / (1 + math.exp(-(sum(k * unit * w.get(g, 0) for g, k in f[i].items()) + b))) for i in score}


def test_toxicity_is_that_of_dictionaries(spark):
    r = random.Random(4)
    bad, good = [words(r, 1) for _ in range(4)], [words(r, 1) for _ in range(60)]
    rows = [(i, " ".join(r.choices(good, k=12) + (r.choices(bad, k=3) if i % 3 == 0 else [])) + " Éa") for i in range(40)]
    labels = {i: int(i % 3 == 0) for i in range(24)}
    table = spark.createDataFrame([(i, y) for i, y in labels.items()] + [(1000 + i, 1) for i in range(3000)], "doc_id long, toxic int")
    d = docs_of(spark, [*rows, rows[3]])
    got = {x.doc_id: x.toxicity for x in toxicity.score(d, toxicity.train(d, table)).collect()}
    want = slow_toxicity(rows, labels, range(40))
    assert all(abs(got[i] - want[i]) < 1e-4 for i in want)
    assert toxicity.sample(d, table).count() == 24 and np.isfinite(list(got.values())).all()
