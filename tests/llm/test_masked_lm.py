"""The language model against networks and sums by hand."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from test_operators import docs_of, edge, empty

from aliasmith.llm import masked_lm as lm
from aliasmith.llm.kernel import slices


def batch(*texts):
    return iter(pa.table({"text": pa.array(texts, pa.string())}).to_batches())


@pytest.fixture(scope="module")
def trained(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()
    counts = lm.count_words(d)
    return d, counts, lm.train(d, counts)


def test_all_words_are_counted(trained):
    d, counts, net = trained
    want = Counter()
    for r in d.collect():
        (_, buf, offs), = slices(batch(r.text)) or ((None, np.zeros(0, np.uint8), np.zeros(2, int)),)
        want.update(lm.span_hash(buf, *lm.words(buf, offs)[:2]).view(np.int64).tolist())
    assert {r.word: r.n for r in counts.collect()} == want
    rare = [r for r in counts.collect() if np.uint64(r.word & (2**64 - 1)) not in set(net.words.tolist())]
    total = np.ones(lm.TAILS)
    for r in rare:
        total[r.tail] += r.n
    assert (total == net.total).all() and len(net.words) == min(lm.HEAD, len(want))


def test_score_of_a_document_by_hand(trained):
    d, counts, net = trained
    got = {x.doc_id: x for x in lm.score(d, net, counts).collect()}
    n_of = {r.word: r.n for r in counts.collect()}
    assert sum(x.n_tokens for x in got.values()) == sum(n_of.values())
    for row in [r for r in d.orderBy("doc_id").collect() if r.text and 20 < got[r.doc_id].n_tokens < 200][:3]:
        (_, buf, offs), = slices(batch(row.text))
        token, at, h, tail = net.tokens(buf, offs)
        total = 0.0
        for i, t in enumerate(token):
            context = [token[i + k] + 1 if 0 <= i + k < len(token) else 0 for k in range(-lm.SIDE, lm.SIDE + 1) if k]
            v = np.tanh(np.concatenate([net.emb[c] for c in context]) @ net.w + net.b)
            c, s = divmod(int(t), lm.SLOTS)
            for z, own in ((v @ net.w1 + net.b1, c), (v @ net.w2[c] + net.b2[c], s)):
                z = z.astype(np.float64)
                total += z[own] - np.log(np.exp(z).sum())
            if tail[i] >= 0:
                total += math.log(n_of[int(h[i : i + 1].view(np.int64)[0])] / net.total[tail[i]])
        assert abs(total - got[row.doc_id].log_likelihood) < 2e-2


def test_probabilities_add_up_to_one(trained):
    _, counts, net = trained
    outcomes = np.arange(lm.CLASSES * lm.SLOTS)
    p = np.exp(net.log_probability(np.tile([5, 9, 100, 0], (len(outcomes), 1)), outcomes).astype(np.float64))
    assert abs(p.sum() - 1) < 1e-4
    # the words counted in a slot and one count for all others make up the slot
    head = set(net.words.view(np.int64).tolist())
    share = np.zeros(lm.TAILS)
    for r in counts.collect():
        if r.word not in head:
            share[r.tail] += r.n / net.total[r.tail]
    assert np.allclose(share + 1 / net.total, 1)


def test_order_and_training_count(spark, trained):
    d, counts, net = trained
    before = sum(x.log_likelihood for x in lm.score(d, lm.start(counts), counts).collect())
    after = sum(x.log_likelihood for x in lm.score(d, net, counts).collect())
    assert after > before
    rows = [r for r in d.collect() if r.text and len(r.text.split()) > 30]
    r = random.Random(1)
    mixed = [(2 * i + k, t) for i, x in enumerate(rows) for k, t in enumerate([x.text, " ".join(r.sample(x.text.split(), len(x.text.split())))])]
    got = {x.doc_id: x.per_token for x in lm.score(docs_of(spark, mixed), net, counts).collect()}
    better = [got[2 * i] > got[2 * i + 1] for i in range(len(rows))]
    assert np.mean(better) > 0.8 and np.mean([got[2 * i] - got[2 * i + 1] for i in range(len(rows))]) > 0


def test_result_does_not_depend_on_partitions(spark, trained):
    d, counts, _ = trained
    some = d.filter("doc_id < 60")
    c = lm.count_words(some)
    a, b = (lm.train(x, c, shard_tokens=4000) for x in (some.repartition(7), some.coalesce(1)))
    assert np.abs(a.flat() - b.flat()).max() < 1e-4
    one, two = ({x.doc_id: x.log_likelihood for x in lm.score(x, a, c).collect()} for x in (some.repartition(7), some.coalesce(1)))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) <= 1e-5 * abs(one[k]) for k in one)


def test_edges(spark):
    out = lm.scored(edge(spark)).collect()
    got = {(x.doc_id, x.n_tokens): x for x in out}
    assert len(out) == 8 and out[0].asDict().keys() == {"doc_id", "n_tokens", "log_likelihood", "per_token"}
    assert got[1, 0].log_likelihood == 0 and got[1, 0].per_token is None and got[5, 60_000].log_likelihood < 0 and (None, 3) in got
    assert sum(x.doc_id == 4 for x in out) == 2
    assert lm.scored(empty(spark)).count() == 0
    # words that were never counted have a probability too
    counts = lm.count_words(docs_of(spark, [(1, "a b c")]))
    assert all(x.log_likelihood < 0 for x in lm.score(docs_of(spark, [(1, "never seen")]), lm.start(counts), counts).collect())


def test_gradient_against_differences():
    r = np.random.default_rng(3)
    normal = lambda *s: r.normal(size=s, scale=0.3)
    net = lm.Network(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(lm.TAILS), normal(1 + lm.CLASSES * lm.SLOTS, lm.DIM), normal(2 * lm.SIDE * lm.DIM, lm.HIDDEN), normal(lm.HIDDEN), normal(lm.HIDDEN, lm.CLASSES), normal(lm.CLASSES), normal(lm.CLASSES, lm.HIDDEN, lm.SLOTS), normal(lm.CLASSES, lm.SLOTS))
    context, token = r.integers(0, 50, (64, 2 * lm.SIDE)), r.integers(0, lm.CLASSES * lm.SLOTS, 64)

    def loss():
        h = np.tanh(net.emb[context].reshape(64, -1) @ net.w + net.b)
        c, s = token // lm.SLOTS, token % lm.SLOTS
        z1, z2 = h @ net.w1 + net.b1, np.einsum("nh,nhk->nk", h, net.w2[c]) + net.b2[c]
        return -np.mean(sum(z[np.arange(64), k] - np.log(np.exp(z).sum(1)) for z, k in ((z1, c), (z2, s))))

    for part, g in zip(lm.Network.PARTS, net.gradient(context, token)):
        x = getattr(net, part)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, e = x[at], 1e-4
        x[at] = keep + e
        up = loss()
        x[at] = keep - e
        down = loss()
        x[at] = keep
        assert abs((up - down) / (2 * e) - g[at]) < 1e-5
