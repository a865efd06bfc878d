"""Clusters of voices against a plain statement of the rounds, and the size of the plan."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from reelspan.operators import speakers as sp
from reelspan.params import SpeakerParams

SF = "/root/testdata/sf0.001"


def unit(v):
    return v / np.linalg.norm(v)


def plain(u, p=SpeakerParams(), rounds=12):
    """Cluster numbers of unit vectors in order, or None for a single voice."""
    dist = lambda a, b: 1 - a @ b
    starts = [0]
    while len(starts) < p.max_speakers:
        near = [min(dist(x, u[s]) for s in starts) for x in u]
        starts.append(max(range(len(u)), key=lambda i: (near[i], -i)))
    best = None
    for k in range(2, min(p.max_speakers, len(u) - 1) + 1):
        c = [u[s] for s in starts[:k]]
        for _ in range(rounds):
            near = np.array([min(range(len(c)), key=lambda j: (dist(x, unit(c[j])), j)) for x in u])
            c = [u[near == j].mean(axis=0) for j in sorted(set(near))]
        near = np.array([min(range(len(c)), key=lambda j: (dist(x, unit(c[j])), j)) for x in u])
        groups = [np.flatnonzero(near == j) for j in sorted(set(near))]
        least = 1 if len(u) < 8 else max(2, math.ceil(len(u) * 0.03))
        means = [unit(u[g].sum(axis=0)) for g in groups]
        gap = min((dist(a, b) for i, a in enumerate(means) for b in means[i + 1:]), default=-1)
        if len(groups) < 2 or min(map(len, groups)) < least or gap < max(0.06, p.distance_threshold * 0.35):
            continue
        scores = []
        for g in groups:
            for i in g:
                a = np.mean([dist(u[i], u[j]) for j in g if j != i]) if len(g) > 1 else None
                b = min(np.mean([dist(u[i], u[j]) for j in h]) for h in groups if h is not g)
                scores.append(0.0 if a is None else (b - a) / max(a, b) if max(a, b) > 0 else 0.0)
        score = np.mean(scores) - max(0, k - 2) * 0.008
        if score >= 0.10 and (best is None or score > best[0] + 1e-9):
            best = (score, near)
    return None if best is None else best[1]


@pytest.mark.parametrize("voices", [1, 2, 3])
def test_clusters_equal_plain_rounds(spark, voices):
    rng = np.random.default_rng(voices)
    rows, want = [], {}
    for project in range(3):
        centres = rng.normal(size=(voices, 12))
        u = np.array([unit(centres[rng.integers(voices)] + rng.normal(size=12) * 0.25) for _ in range(40)])
        rows += [(project, i, [float(x) for x in v]) for i, v in enumerate(u)]
        want[project] = plain(u)
    got = sp.cluster_recordings(spark.createDataFrame(rows, "project_id long, pos long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    for project, near in want.items():
        mine = [r.cluster for r in sorted((r for r in got if r.project_id == project), key=lambda r: r.pos)]
        near = [0] * 40 if near is None else near.tolist()
        assert len(set(zip(mine, near))) == len(set(mine)) == len(set(near))  # the same parts, whatever their numbers


def test_final_plan_is_small(spark):
    plan = entry.queries()["voice_clusters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 25
