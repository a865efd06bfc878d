"""Exact quantiles against numpy, with tiny leaves so that the search takes many steps."""

import numpy as np
import pytest

from reelspan.operators import quantiles as qt


@pytest.mark.parametrize("pieces, leaf", [(1024, 4096), (16, 5)])
def test_equals_numpy(spark, monkeypatch, pieces, leaf):
    monkeypatch.setattr(qt, "PIECES", pieces)
    monkeypatch.setattr(qt, "LEAF", leaf)
    rng = np.random.default_rng(3)
    groups = {
        "even": rng.uniform(-5, 100, 300).tolist(), "ties": rng.integers(0, 4, 200).astype(float).tolist(), "one": [7.25], "two": [1.0, 2.0],
        "wide": [*(10.0 ** rng.uniform(-8, 8, 40)).tolist(), -1e308, 1e308], "close": (1.0 + np.arange(60) * 2.0 ** -52).tolist(), None: [3.0, 1.0, 2.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("even", float("nan")), ("empty", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in qt.exact_quantiles(d, ["g"], "x", {"low": 0.0, "mid": 0.5, "p95": 0.95, "high": 1.0}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        want = np.quantile(xs, [0, 0.5, 0.95, 1.0])
        np.testing.assert_allclose([got[g].low, got[g].mid, got[g].p95, got[g].high], want, rtol=1e-12)
    everything = [x for xs in groups.values() for x in xs]
    assert qt.exact_quantiles(d, [], "x", {"m": 0.5}).collect()[0].m == pytest.approx(float(np.median(everything)), rel=1e-12)
    assert qt.exact_quantiles(d.where("x is null"), [], "x", {"m": 0.5}).count() == 0


def test_auc_is_the_share_of_ordered_pairs(spark):
    from reelspan.operators import learning as ln

    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(2)), float(x)) for x in np.round(rng.uniform(0, 1, 400), 2)] + [(1, 1.0), (0, 0.0), (1, None)]
    pos, neg = ([x for y, x in rows if y == k and x is not None] for k in (1, 0))
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    d = spark.createDataFrame(rows, "label int, model_probability double")
    assert ln.roc_auc(d).first().roc_auc == pytest.approx(want, rel=1e-12)
    assert ln.roc_auc(d.where("label = 1")).first().roc_auc is None


@pytest.mark.parametrize("shapes, k", [([(1, 1)] * 5, 5), ([(1, 1), (3, 0), (0, 2)], 2), ([(1, 0)] * 4 + [(0, 1)] * 3, 3), ([(9, 9), (1, 1), (1, 0), (1, 0), (0, 1)], 3), ([(1, 0), (0, 1)], None), ([(2, 2)], None)])
def test_folds_are_never_empty(spark, shapes, k):
    """Whatever the projects are called, each fold gets some, and every training part has both labels."""
    from reelspan.operators import learning as ln

    for salt in range(2):
        rows = [(f"p{salt}{i}", y) for i, (p, n) in enumerate(shapes) for y in [1] * p + [0] * n]
        d = spark.createDataFrame(rows, "project_id string, label int")
        split = ln.fold_map(d)
        if k is None:
            assert split is None
            continue
        folds = {r.project_id: r.fold for r in split[0].collect()}
        assert split[1] == k and set(folds.values()) == set(range(k)) and len(folds) == len(shapes)
        for f in range(k):
            assert {y for p, y in rows if folds[p] != f} == {0, 1}
        members = ln.fold_membership(*split).collect()
        assert len(members) == k * len(shapes) and sum(r.part == "validation" for r in members) == len(shapes)
