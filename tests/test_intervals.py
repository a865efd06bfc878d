"""Interval joins against all pairs, with bounds of every size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reelspan.operators import intervals as iv

INF, NAN = math.inf, math.nan


def made(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        s = rng.choice([rng.uniform(-100, 5000), float(60 * rng.randrange(20)), rng.uniform(0, 300)])
        out.append((rng.choice([1, 1, 2]), i, s, s + rng.choice([0.0, rng.uniform(0, 3), rng.uniform(0, 70), 60.0, 240.0, rng.uniform(0, 4000)])))
    return out + [(1, n, 10.0, 1e12), (1, n + 1, -1e300, 1e300), (2, n + 2, 5.0, INF), (1, n + 3, None, 9.0), (1, n + 4, 7.0, None), (None, n + 5, 0.0, 9.0), (1, n + 6, 90.0, 30.0)]


@pytest.fixture(scope="module")
def sides(spark):
    left, right = made(1, 150), made(2, 150)
    kind = "project_id long, id long, start double, end double"
    return left, right, spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)


def pairs(left, right, ok):
    return sorted((a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (*a, *b) and ok(a, b))


@pytest.mark.parametrize("closed, slack", [(True, 0.0), (False, 0.0), (False, 0.5)])
def test_overlaps_equal_all_pairs(sides, closed, slack):
    left, right, a, b = sides
    ok = (lambda x, y: y[3] >= x[2] and y[2] <= x[3]) if closed else (lambda x, y: y[3] > x[2] + slack and y[2] < x[3] - slack)
    # an interval whose end lies before its start stands for its start
    left, right = ([r for r in s if None in r or r[3] >= r[2]] for s in (left, right))
    got = iv.overlap_join(a.where("end >= start or start is null or end is null"), b.where("end >= start or start is null or end is null"), "project_id", closed=closed, slack=slack)
    assert sorted((r.id, r.r_id) for r in got.select("id", "r_id").collect()) == pairs(left, right, ok)


def test_every_left_row_is_kept_once(sides):
    left, right, a, b = sides
    d = iv.overlap_aggregate(a.withColumn("wide", F.lit("w")), b, "project_id", ["id"], [F.count("r_id").alias("n"), F.min("r_start").alias("m")], closed=True)
    assert d.columns == ["project_id", "id", "start", "end", "wide", "n", "m"] and d.count() == len(left)
    want = {}
    for i, _ in pairs([x for x in left if None in x or x[3] >= x[2]], [x for x in right if None in x or x[3] >= x[2]], lambda x, y: y[3] >= x[2] and y[2] <= x[3]):
        want[i] = want.get(i, 0) + 1
    straight = {r.id: r.n for r in d.where("id < 150").collect()}
    odd = 156  # the turned right row counts where it lies inside
    turned = {x[1] for x in left if x[0] == 1 and None not in x and 30.0 >= x[2] and 90.0 <= x[3]}
    assert all(straight[i] - (i in turned) == want.get(i, 0) for i in straight), odd


def test_points_equal_all_pairs(sides, spark):
    left, right, a, b = sides
    got = iv.point_join(a, b.select("project_id", "id", "start", "end"), "project_id", "start", "start", "end", width=60.0)
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] is not None and x[0] == y[0] and None not in (x[2], *y) and y[2] <= x[2] <= y[3])
    assert sorted((r.id, r.r_id) for r in got.collect()) == want


def test_only_bounds_go_through_the_join(sides):
    _, _, a, b = sides
    d = iv.overlap_aggregate(a.withColumn("wide", F.repeat(F.lit("w"), 10)), b, "project_id", ["id"], [F.count("r_id").alias("n")], closed=True)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):]
    assert "wide" in plan and "wide" not in below.split("LogicalRDD")[0]


def test_buckets_stay_few(sides):
    _, _, a, b = sides
    few = a.where("start is not null and end is not null")
    every = F.array(*[F.lit(i) for i in range(iv.LEVELS + 1)])
    spread = iv._spread(few, F.col("start"), F.col("end"), 60.0, every, "_b")
    assert spread.count() <= 2 * (iv.LEVELS + 1) * few.count()
