"""Relays of the suffix tree change nothing, and what chunks send grows with the text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import suffix_tree


@pytest.mark.parametrize("groups, most", [(1, 64), (8, 64), (64, 64), (65, 64), (211, 64), (4097, 64), (30, 3)])
def test_routes(groups, most):
    fan, hops = suffix_tree.routes(groups, most)
    assert fan <= most and fan ** hops >= groups and (hops == 1 or most ** (hops - 1) < groups)


def test_distinct_equals_numpy():
    x = np.random.default_rng(3).integers(0, 50, 1000).astype(np.uint64)
    for kind in ("quicksort", "stable"):
        keys, first, inverse = suffix_tree.distinct(x, kind)
        own, own_inverse = np.unique(x, return_inverse=True)
        assert (keys == own).all() and (inverse == own_inverse).all() and (x[first] == keys).all()
    assert all(len(a) == 0 for a in suffix_tree.distinct(np.empty(0, np.uint64)))


@pytest.mark.parametrize("fanout", [3, 5])
def test_relays_give_the_same_scores(spark, fanout):
    """Small chunks and fan-out: several hops there and back."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {r.doc_id: r for r in suffix_tree.score(docs).collect()}
    got = {r.doc_id: r for r in suffix_tree.score(docs, chunk_tokens=300, fanout=fanout).collect()}
    assert got.keys() == plain.keys() and len(got) > 50
    for i, r in got.items():
        assert r.asDict() == plain[i].asDict() | {"score": r.score, "base_score": r.base_score}
        assert math.isclose(r.score, plain[i].score, rel_tol=1e-9) and math.isclose(r.base_score, plain[i].base_score, rel_tol=1e-9)


def test_rows_grow_with_the_text(spark):
    """Four times the text: four times the chunks, and at each hop no more than a fan-out of rows to each."""
    one = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit(True).alias("train"), "text")
    rows = []
    for times in (1, 4):
        many = one.crossJoin(spark.range(times)).drop("id").repartition(2)
        chunks = many.mapInArrow(suffix_tree._to_chunks(200), suffix_tree._CHUNK_SCHEMA)
        n = chunks.count()
        fan, hops = suffix_tree.routes(n, 4)
        asked = chunks.mapInArrow(suffix_tree._ask_words(fan, hops), suffix_tree._ASK)
        assert hops > 1 and asked.count() <= n * fan
        relayed = asked.withColumn("block", F.pmod(F.xxhash64("chunk"), F.lit(-(-n // fan)))).groupBy("g", "block")
        assert relayed.applyInArrow(suffix_tree._relay(fan, hops - 1), suffix_tree._ASK).count() <= n * fan * 2
        rows.append((n, asked.count()))
    assert rows[1][0] <= rows[0][0] * 4.5 and rows[1][1] <= rows[0][1] * 4.5 * 4 / 3
