"""The block-max search gives the k nearest of all pairs and puts candidates in order twice at most."""

import numpy as np

from reelspan.llm import toxicity


def test_search_equals_all_pairs_in_two_visits(monkeypatch):
    deal, n, size = np.random.default_rng(3), 6000, 60
    dense = np.zeros((n, size))
    vectors = []
    for i in range(n):
        f = np.sort(deal.choice(size, deal.integers(1, 9), replace=False))
        w = deal.integers(1, 4, len(f)).astype(float)  # few values, so that many cosines are equal
        vectors.append((f, w / np.sqrt((w * w).sum())))
        dense[i, f] = vectors[-1][1]
    index = toxicity.BlockMaxIndex.build(list(range(n)), [0] * n, vectors)
    place = {i: p for p, i in enumerate(index.ids)}
    calls, sort = [], np.lexsort
    monkeypatch.setattr(toxicity.np, "lexsort", lambda keys: calls.append(1) or sort(keys))
    for i in range(0, n, 100):
        for without in (None, place[i]):
            calls.clear()
            places, cosines = index.nearest(*vectors[i], without=without)
            assert len(calls) <= 2  # before, once for each of the blocks visited
            all_ = np.minimum(dense[index.ids] @ dense[i], 1.0)
            all_[all_ <= 0] = -1
            if without is not None:
                all_[without] = -1
            want = sort((np.arange(n), -np.round(all_, 12)))[:toxicity.NEIGHBOURS]
            want = want[all_[want] > 0]
            assert np.allclose(cosines, all_[want], atol=1e-11)
            assert np.array_equal(places, want)
    assert index.nearest(np.array([size + 1]), np.array([1.0]))[0].size == 0
