"""Decontamination of documents that hold less or other words than the item."""

import random

from aliasmith.llm import decontaminate


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def test_documents_shorter_than_the_item(spark):
    r = random.Random(7)
    items = [(i, words(r, 10 + 3 * i)) for i in range(12)]
    rows = [(i, " ".join(t.split()[1:])) for i, t in items] + [(100 + i, " ".join(t.split()[: len(t.split()) - 2])) for i, t in items] + [(200 + i, words(r, 9)) for i in range(12)] + [(300, "a b"), (301, ""), (302, None)]

    def grams(t):
        w = t.split()
        return {tuple(w[k : k + 3]): sum(map(len, w[k : k + 3])) for k in range(len(w) - 2)}

    want = {}
    for d, t in rows:
        for i, x in items:
            a, b = grams(t or ""), grams(x)
            sim = sum(a[k] for k in a.keys() & b.keys()) / sum((a | b).values())
            if sim >= decontaminate.SIMILARITY:
                want[d, i] = sim
    assert {(i, i) for i in range(12)} <= set(want)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k].similarity - want[k]) < 1e-9 and got[k].start_word == 0 for k in got)
    assert {x.doc_id for x in decontaminate.drop_leaks(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_items_with_several_words_replaced(spark):
    r = random.Random(11)
    items = [(i, words(r, r.randint(15, 59))) for i in range(40)]
    rows = []
    for i, t in items:
        for edits in (0, 1, 2, max(2, len(t.split()) // 10)):
            w = t.split()
            for at in r.sample(range(len(w)), edits):
                w[at] = words(r, 1) + "z"
            rows.append((len(rows), " ".join([words(r, 40), *w, words(r, 40)]), i))
    clean = [(1000 + k, words(r, 120), None) for k in range(40)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows + clean], "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, _, i in rows}
