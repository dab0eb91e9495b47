"""Shared passages without loss: repeated doc_ids, texts that lower-casing changes, passages of just 50 words, hot passages."""

import random

import numpy as np
from test_operators import brute_windows, docs_of, words

from aliasmith.llm import substring


def test_every_passage_of_just_50_words_is_found():
    r = np.random.default_rng(1)
    for k in range(400):
        # a small vocabulary makes runs and equal neighbours
        v = 3 if k % 4 == 0 else 40 if k % 4 == 1 else 1 << 62
        shared = r.integers(0, v, 50)
        docs = [np.r_[r.integers(0, v, r.integers(0, 80)), shared, r.integers(0, v, r.integers(0, 80))] for _ in range(2)]
        h, row = substring.mix(np.concatenate(docs).astype(np.uint64)), np.repeat([0, 1], [len(d) for d in docs])
        bounds = np.array([0, len(docs[0]), len(h)])
        name, start, _, _ = substring.telling(h, row, 50)
        u, inverse, n = np.unique(name, return_inverse=True, return_counts=True)
        got = set(substring.window_places(h, row, bounds, start[n[inverse] > 1], 50).tolist())
        at = {}
        for d in (0, 1):
            for p in range(bounds[d], bounds[d + 1] - 49):
                at.setdefault(h[p : p + 50].tobytes(), []).append(p)
        assert {p for x in at.values() if len(x) > 1 for p in x} <= got


def test_rows_of_one_doc_id_with_different_texts(spark):
    r = random.Random(7)
    passage = words(r, 70)
    rows = [(1, words(r, 350)), (1, words(r, 3)), (2, f"{words(r, 30)} {passage}"), (2, f"{passage} {words(r, 90)}"), (2, f"{passage} {words(r, 90)}"), (3, words(r, 60)), (3, passage)]
    rows.append(rows[4])
    got = sorted((x.doc_id, x.end_word - x.start_word, x.later_words) for x in substring.shared_passages(docs_of(spark, rows)).collect())
    assert [x[:2] for x in got] == [(2, 70)] * 3 + [(3, 70)] and sorted(x[2] for x in got) == [0, 70, 70, 70]
    kept = [(x.doc_id, x.text) for x in substring.drop_shared_passages(docs_of(spark, rows)).collect()]
    assert sum(passage in t for _, t in kept) in (1, 2) and len(kept) == 7
    assert {t for d, t in kept if d == 1} == {rows[0][1], rows[1][1]} and not any(passage in t for d, t in kept if d == 3)


def test_letters_that_grow_or_shrink_in_lower_case(spark):
    r = random.Random(8)
    passage = words(r, 60)
    rows = [(1, f"Ⱥbc {passage} ẞ end"), (2, f"Ⱥ İ K {passage} ẞz ⱥ tail"), (3, f"ẞ {passage.upper()}")]
    kept = {x.doc_id: x.text for x in substring.drop_shared_passages(docs_of(spark, rows)).collect()}
    assert kept[1] == rows[0][1] and kept[2].split() == ["Ⱥ", "İ", "K", "ẞz", "ⱥ", "tail"] and kept[3].split() == ["ẞ"]


def test_a_passage_in_every_document(spark, monkeypatch):
    r = random.Random(9)
    passage = words(r, 55)
    rows = [(i, f"{words(r, r.randint(0, 30))} {passage} {words(r, r.randint(0, 30))} {'x y ' * (i % 7)}") for i in range(300)]
    want = brute_windows(rows, substring.LENGTH)
    got = {(x.doc_id, x.pos): x.first for x in substring.repeated_windows(docs_of(spark, rows).repartition(3)).collect()}
    assert got == want
