"""contexts of all entities at once and of those asked for are the same; the best of a span is found without sorting."""

import numpy as np
import pyarrow as pa

from aliasmith.operators import batch, context


def test_contexts_of_all_are_those_asked(monkeypatch):
    r = np.random.default_rng(1)
    words = pa.array([["a", "b"], [], ["c"], ["none"], ["z"], ["a", "c", "b", "a"]])
    names, vectors, entities = pa.array(["a", "b", "c", "z"]), np.vstack([r.normal(size=(3, 8)), np.zeros((1, 8))]), r.normal(size=(3, 8))
    vector = np.array([2, -1, 0, 1])
    row, what = r.integers(0, 6, 400), r.integers(0, 4, 400)
    bag = lambda: context._Bag(words, names, [1, 2])
    with np.errstate(all="ignore"):
        every = context._contexts(bag(), vectors, row, what, vector, entities)
        monkeypatch.setattr(batch, "CELLS", 0)
        asked = context._contexts(bag(), vectors, row, what, vector, entities)
    np.testing.assert_array_equal(every, asked)
    assert np.isnan(every).any() and (every == context.NO_CONTEXT).any()


def test_first_greatest():
    of = np.array([0, 0, 0, 2, 2, 5, 7, 7])
    value = np.array([1.0, 3, 3, -np.inf, -np.inf, 0, 2, 1])
    assert context._first_greatest(of, value).tolist() == [1, 3, 5, 6]
    assert context._first_greatest(of[:0], value[:0]).tolist() == []
