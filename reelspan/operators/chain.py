"""Order-dependent selection without a sequential pass over a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reelspan.operators.intervals import overlap_join, overlap_ratio, point_join
from reelspan.operators.scan import running
from reelspan.session import cut_lineage


def greedy_spacing(df: DataFrame, key: str, coord: str, step: float, pos: str, chunk: float) -> DataFrame:
    """Keep the first event, then always the next one at least ``step`` after the last kept.

    ``pos`` must be dense per key in ``coord`` order. Every event ``step`` or
    more after its predecessor is kept for certain; the rest follows links to
    the next admissible event, whose reach doubles each round, so the rounds
    grow with the logarithm of the longest run, not with its length.
    """
    prev = running(
        df.select(key, pos, coord), [key], [coord, pos], F.floor(F.col(coord) / F.lit(chunk)),
        {"_prev": ("max", F.col(coord))},
    )
    events = cut_lineage(prev)
    # (predecessor, event] answers "first event at or after t"; equal stamps cannot be first
    spans = events.where(F.col("_prev").isNotNull() & (F.col("_prev") < F.col(coord))).select(
        key, F.col(pos).alias("to"), F.col("_prev").alias("lo"), F.col(coord).alias("hi")
    )
    head = F.col("_prev").isNull() | (F.col(coord) >= F.col("_prev") + F.lit(step))
    links = point_join(
        events.where(F.col(coord).isNotNull()).withColumn("_t", F.col(coord) + F.lit(step)),
        spans, key, "_t", "lo", "hi", width=chunk, open_lo=True,
    ).select(F.col(key), F.col(pos).alias("from"), F.col("r_to").alias("to"))
    links = cut_lineage(links)
    kept = cut_lineage(events.where(head).select(key, pos))
    size = kept.count()
    while True:
        k, n = kept.alias("k"), links.alias("n")
        step_on = k.join(
            n, (F.col(f"k.{key}") == F.col(f"n.{key}")) & (F.col(f"k.{pos}") == F.col("n.from"))
        ).select(F.col(f"k.{key}").alias(key), F.col("n.to").alias(pos))
        kept = cut_lineage(kept.union(step_on).distinct())
        grown = kept.count()
        if grown == size:
            break
        size = grown
        a, b = links.alias("a"), links.alias("b")
        links = cut_lineage(
            a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.to") == F.col("b.from"))).select(
                F.col(f"a.{key}").alias(key), F.col("a.from").alias("from"), F.col("b.to").alias("to")
            )
        )
    return df.join(kept, [key, pos], "left_semi")


def merge_overlapping(df: DataFrame, tolerance: float = 0.55, key: str = "project_id") -> DataFrame:
    """Greedy non-maximum suppression: best score first, drop what overlaps a kept row.

    Rows with the same interval share one fate, only their best can survive; that removes copies before any pairing.
    What is left is numbered in order of rank, so a conflict is a pair of numbers whose smaller one wins, and
    ``first_independent`` finds the kept ones in rounds that do not follow chains of conflicts.
    """
    w = Window.partitionBy(key, "start", "end").orderBy(F.desc("final_score"), F.asc("id"))
    nodes = df.select(key, "id", "start", "end", "final_score").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    # a global sort: ranges ascend with the partitions, and so do the numbers; the checkpoint holds them fast
    nodes = cut_lineage(nodes.orderBy(F.desc("final_score"), "start", "end", "id").select(
        key, "id", "start", "end", F.monotonically_increasing_id().alias("v")))
    spans = nodes.select(key, "start", "end", "v")
    edges = overlap_join(spans, spans, key).where(
        (F.col("r_v") < F.col("v")) & (overlap_ratio(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) >= tolerance)
    ).select("v", F.col("r_v").alias("u"))
    kept, _ = first_independent(nodes.select("v"), edges)
    return df.join(nodes.join(kept, "v", "left_semi").select(key, "id"), [key, "id"], "left_semi")


def first_independent(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """The numbers a walk in ascending order keeps that skips each one joined to a kept one, and the rounds it took.

    nodes: v (long, distinct); edges: v, u (u < v, distinct), the smaller number wins. A round keeps what has no open
    winner, and settles further nodes without waiting for their winners one by one:

    * a single open winner: the node's fate is the opposite of its winner's;
    * let w be the weakest open winner, all others be winners of w too. One of w and its winners is kept for certain.
      If these are the node's own winners, the node is dropped. If there is one more, x, and x is joined to all of the
      node's winners, the node is kept exactly if x is.

    Fates that hang on another's form chains, whose reach doubles each time, as in pointer jumping: a chain of n takes
    log2(n) steps. Each doubling counts as a round. Winners are only counted, summed and matched by equi-joins; no list
    of neighbours is held.
    """
    edges = cut_lineage(edges)
    rounds, kept, open_nodes = 0, None, nodes
    while True:
        rounds += 1
        own = cut_lineage(edges.groupBy("v").agg(F.count("*").alias("d"), F.max("u").alias("w"), F.bit_xor("u").alias("x")))
        top = open_nodes.join(own, "v", "left_anti")
        fates, doublings = _settled(edges, own, top)
        rounds += doublings
        chosen = fates.where("keep").select("v")
        kept = chosen if kept is None else kept.union(chosen)
        beaten = edges.join(chosen.withColumnRenamed("v", "u"), "u", "left_semi").select("v").distinct()
        done = cut_lineage(fates.select("v").union(beaten).distinct())
        open_nodes = cut_lineage(open_nodes.join(done, "v", "left_anti"))
        if open_nodes.isEmpty():
            return cut_lineage(kept), rounds
        edges = cut_lineage(edges.join(done, "v", "left_anti").join(done.withColumnRenamed("v", "u"), "u", "left_anti").select("v", "u"))


def _settled(edges: DataFrame, own: DataFrame, top: DataFrame) -> tuple[DataFrame, int]:
    """(v, keep) of all nodes whose fate follows from those without winners, and the doublings it took."""
    single = own.where("d = 1").select("v", F.col("w").alias("to"), F.lit(True).alias("flip"))
    several = own.where("d > 1").select("v", "d", "w", "x")
    # winners besides w that are winners of w
    pairs = edges.join(several, "v").where("u <> w").select("v", "w", "u")
    shared = pairs.join(edges.select(F.col("v").alias("w"), "u"), ["w", "u"]).groupBy("v").agg(F.count("*").alias("shared"))
    of_w = own.select(F.col("v").alias("w"), F.col("d").alias("dw"), F.col("x").alias("xw"))
    nested = several.join(shared, "v").where("shared = d - 1").join(of_w, "w").where("dw - shared <= 1")
    # the one winner of w that is none of v's: what is left of all numbers put together by exclusive or
    nested = cut_lineage(nested.select("v", "d", (F.col("dw") == F.col("shared")).alias("sure"), F.expr("xw ^ x ^ w").alias("to")))
    ask = edges.join(nested.where("NOT sure"), "v").select("v", "d", "to", F.greatest("u", "to").alias("hi"), F.least("u", "to").alias("lo"))
    met = ask.join(edges.select(F.col("v").alias("hi"), F.col("u").alias("lo")), ["hi", "lo"])
    twin = met.groupBy("v", "d", "to").agg(F.count("*").alias("n")).where("n = d").select("v", "to", F.lit(False).alias("flip"))
    known = cut_lineage(top.select("v", F.lit(True).alias("keep")).union(nested.where("sure").select("v", F.lit(False).alias("keep"))))
    links = cut_lineage(single.union(twin))
    doublings = 0
    while not links.isEmpty():
        far = links.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("flip").alias("_flip"))
        links = cut_lineage(links.join(far, "to", "left").select(
            "v", F.coalesce("_to", "to").alias("to"), (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"), F.col("_to").isNotNull().alias("moved")))
        doublings += 1
        moved = not links.where("moved").isEmpty()
        links = links.drop("moved")
        if not moved:
            break
    end = known.select(F.col("v").alias("to"), "keep")
    return known.union(links.join(end, "to").select("v", (F.col("keep") != F.col("flip")).alias("keep"))), doublings
