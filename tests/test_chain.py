"""Greedy interval suppression against the sequential loop, and its rounds."""

import random

import pytest

from reelspan.operators import chain as ch


def loop(rows, tolerance=0.55):
    """rows: (project_id, id, start, end, final_score)."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[3], r[1])):
        if all(k[0] != r[0] or min(k[3], r[3]) - max(k[2], r[2]) < tolerance * min(k[3] - k[2], r[3] - r[2]) for k in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


def run(spark, rows):
    d = spark.createDataFrame(rows, "project_id long, id string, start double, end double, final_score double")
    return {(r.project_id, r.id) for r in ch.merge_overlapping(d).collect()}


@pytest.mark.parametrize("step", [12.0, 7.0, 3.0])
def test_rising_scores_take_few_rounds(spark, monkeypatch, step):
    """Each row overlaps the next one, two or more, and the next is always better."""
    rows = [(1, f"m{i}", i * step, i * step + 30.0, float(i)) for i in range(2000)]
    rounds, plain = [], ch.first_independent
    monkeypatch.setattr(ch, "first_independent", lambda *a: (lambda r: (rounds.append(r[1]), r)[1])(plain(*a)))
    assert run(spark, rows) == loop(rows)
    assert rounds[0] <= 15


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows(spark, seed):
    """Crowded rows of several recordings with equal scores, equal intervals and rising runs."""
    rng = random.Random(seed)
    rows = []
    for p in (1, 2, 3):
        for i in range(250):
            s = rng.choice([rng.uniform(0, 900), float(rng.randrange(900)), 300.0])
            score = rng.choice([rng.uniform(0, 100), float(rng.randrange(5)), s / 9])
            rows.append((p, f"m{i}", s, s + rng.choice([10.0, 30.0, rng.uniform(5, 48)]), score))
    assert run(spark, rows) == loop(rows)


def test_nothing(spark):
    assert run(spark, [(1, "a", 0.0, 1.0, 1.0)]) == {(1, "a")}
    d = spark.createDataFrame([], "project_id long, id string, start double, end double, final_score double")
    assert ch.merge_overlapping(d).count() == 0
