"""Leaders of a document by products of many rows; terms hashed once."""

import numpy as np

from recallforge.operators import clusters, search

from .test_pairs import greedy


def test_leaders_settle_together(monkeypatch):
    monkeypatch.setattr(clusters, "TOGETHER", 7)
    monkeypatch.setattr(clusters, "ROWS", 10)
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(90, 3)), np.zeros((20, 2)), np.ones((30, 2)), np.empty((0, 4)), rng.normal(size=(7, 2))):
        for threshold in (0.7, 2.0, -2.0):
            assert clusters.greedy_leaders(x, threshold).tolist() == greedy(list(enumerate(x)), threshold)


def test_a_term_is_hashed_once_in_a_worker():
    search._bucket.cache_clear()
    x = search.term_vectors(["The fox", "the FOX the", "", "fox_9"])
    assert search._bucket.cache_info().misses == 3
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 1, 0, 1])
