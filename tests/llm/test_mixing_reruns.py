"""The mix depends on the rows alone, not on their order or partitions; its rates are the dual's."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelspan.llm import mixing
from tests.llm.test_cases import docs  # noqa: F401


def taken(df):
    return Counter((r.doc_id, r.size, r.copies) for r in mixing.mixed_sizes(df).select("doc_id", "size", "copies").collect())


def test_reruns_agree_under_other_partitions(spark, docs):  # noqa: F811
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = taken(d.repartition(3))
    assert first == taken(d.orderBy(F.rand(5)).repartition(7)) and sum(first.values()) == 1000
    twice = docs.unionByName(docs)
    assert taken(twice.repartition(5)) == taken(twice.coalesce(1))


def test_equal_rows_share_their_copies(spark):
    d = spark.createDataFrame([("a", 3, "x")] * 5000 + [("a", 5, "y")] * 7 + [("b", 4, "z")] * 3000, "source string, size long, name string")
    got = Counter((r.source, r.size, r.copies) for r in mixing.balance(d).collect())
    assert sum(got.values()) == 8007
    for key in {k[:2] for k in got}:
        assert max(c for s, z, c in got if (s, z) == key) - min(c for s, z, c in got if (s, z) == key) <= 1


def test_copies_follow_the_dual(spark):
    """Bisection on each source's convex dual gives the rates; copies of a size differ from them by rounding only."""
    sizes = {"a": [1 + i * 37 % 50 for i in range(4000)], "b": [1 + i * 11 % 9 for i in range(1500)], None: [5 + i % 40 for i in range(900)]}
    d = spark.createDataFrame([(s, z, i) for s, zs in sizes.items() for i, z in enumerate(zs)], "source string, size long, name long")
    rows = mixing.balance(d).collect()
    target = {r.source: r.target for r in rows}
    for s, zs in sizes.items():
        mean = sum(zs) / len(zs)
        rate = lambda z, lam: 2 / (1 + math.exp(-lam * z / mean))
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(z * rate(z, mid) for z in zs) < target[s] else (lo, mid)
        by_size, n = Counter(), Counter(zs)
        for r in rows:
            if r.source == s:
                by_size[r.size] += r.copies
        capped = target[s] >= 2 * sum(zs)
        for z in n:
            want = n[z] * (2.0 if capped else rate(z, lo))
            assert abs(by_size[z] - want) <= 6, (s, z, by_size[z], want)
