"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelspan.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """node, component (long) for every node of the edges a, b (long; direction does not matter, repeats do no harm).

    In each round a node moves to the neighbour that comes first in a fixed random order, if it comes before the node
    itself, and the edges move along; nodes that have met become one. The random order keeps the rounds logarithmic on
    chains, the minimum is combined before the shuffle so that a node of a million edges is as good as any other.
    Nothing but the test for an empty edge table reaches the driver.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = stage(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        moves = edges.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a"))).alias("to"))
        moves = stage(moves.select("a", F.col("to.n").alias("to")))
        left = moves.withColumnsRenamed({"a": "component", "to": "_to"})
        labels = stage(labels.join(left, "component", "left").select("node", F.coalesce("_to", "component").alias("component")))
        right = moves.withColumnsRenamed({"a": "b", "to": "_b"})
        edges = edges.join(moves, "a").join(right, "b").select(F.col("to").alias("a"), F.col("_b").alias("b"))
        edges = stage(edges.where("a <> b").distinct())
    return labels


def merge_groups(groups: DataFrame, others: DataFrame) -> DataFrame:
    """_k1, _k2, component of every row of ``groups``, where groups that share rows of one of the ``others`` are one.

    Both have _k1, _k2 (``row_keys``) and component (long) of the same rows."""
    keys = ["_k1", "_k2"]
    groups = stage(groups.select(*keys, "component"))
    met = groups.join(others.select(*keys, F.col("component").alias("other")).distinct(), keys).select("component", "other").distinct()
    met = stage(met)
    low = met.groupBy("other").agg(F.min("component").alias("b"))
    to = components(met.join(low, "other").select(F.col("component").alias("a"), "b")).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return groups.join(to, "component", "left").select(*keys, F.coalesce("_to", "component").alias("component"))
