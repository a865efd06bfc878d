"""Exact quantiles per group by distributed selection; no input is rounded and no group is held or sorted whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelspan.session import cut_lineage

#: Pieces a range of values is cut into per step; distinct values of a range that are walked one by one.
PIECES, LEAF = 1_024, 4_096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``keys`` and, for each name in ``wanted``, the quantile at its share (0 to 1), linear between neighbouring ranks.

    Null and NaN values take no part; groups without values do not appear (without keys: no row). Equal values are
    counted, map-side, as (group, value, n). A rank is then looked for in a range of values, at first the group's own:
    the range is cut into PIECES, the pieces' counts and bounds are added up, running counts say which piece holds the
    rank, and the search goes on there, until a range has at most LEAF distinct values. So a task holds PIECES counts or
    LEAF values of a range, however large the group; each step makes the ranges up to PIECES times smaller, and at
    least parts their smallest from their largest value.
    """
    # without keys all values form one group, whose few ranges are sent to all of them
    named, single = [f"_k{i}" for i in range(max(1, len(keys)))], not keys
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)] or [F.lit(0).alias("_k0")], F.col(value).cast("double").alias("v"))
    values = cut_lineage(d.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*named, "v").agg(F.count("*").alias("n")))
    groups = values.groupBy(*named).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("size"))
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for n, q in wanted.items()]))
    ranks = groups.select(*named, "lo", "hi", "size", ends.alias("q"))
    ranks = ranks.select(*named, "lo", "hi", "size", "q.name", "q.at", F.explode(F.array(F.floor("q.at"), F.ceil("q.at"))).alias("rank"))
    todo = cut_lineage(ranks.distinct().withColumn("before", F.lit(0).cast("long")))  # before: values below the range
    found = None
    while True:
        leaf = _leaf(values, todo.where(F.col("size") <= LEAF), named, single)
        found = leaf if found is None else found.unionByName(leaf)
        todo = todo.where(F.col("size") > LEAF)
        if todo.isEmpty():
            break
        todo = cut_lineage(_narrowed(values, todo, named, single))
    got = found.groupBy(*named, "name").agg(F.max_by("v", "rank").alias("above"), F.min_by("v", "rank").alias("below"), F.first("at").alias("at"))
    share = F.col("at") - F.floor("at")
    x = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(F.col("below") * (1 - share) + F.col("above") * share)
    out = got.groupBy(*named).agg(*[F.max(F.when(F.col("name") == n, x)).alias(n) for n in wanted])
    return out.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], *wanted)


def _inside(values: DataFrame, ranges: DataFrame, named: list[str], single: bool) -> DataFrame:
    """The values of each distinct range of the same group."""
    r = ranges.select(*[F.col(k).alias(f"r{k}") for k in named], "lo", "hi").distinct()
    on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for k in named:
        on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
    # one group has at most as many ranges as ranks asked for
    return values.join(F.broadcast(r) if single else r, on).drop(*[f"r{k}" for k in named])


def _matched(ranks: DataFrame, parts: DataFrame, named: list[str]) -> DataFrame:
    """Each rank with the part of its range that holds it: parts have lo, hi, n and start (values of the range before them)."""
    r, p = ranks.alias("r"), parts.alias("p")
    here = F.col("r.rank") - F.col("r.before")
    on = (F.col("r.lo") == F.col("p.lo")) & (F.col("r.hi") == F.col("p.hi")) & (here >= F.col("p.start")) & (here < F.col("p.start") + F.col("p.n"))
    for k in named:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}"))
    return r.join(p, on)


def _started(parts: DataFrame, named: list[str], order: str) -> Column:
    w = Window.partitionBy(*named, "lo", "hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def _leaf(values: DataFrame, ranks: DataFrame, named: list[str], single: bool) -> DataFrame:
    parts = _inside(values, ranks, named, single)
    parts = parts.withColumn("start", _started(parts, named, "v"))
    return _matched(ranks, parts, named).select(*[F.col(f"r.{k}").alias(k) for k in named], "r.name", "r.at", "r.rank", "p.v")


def _narrowed(values: DataFrame, ranks: DataFrame, named: list[str], single: bool) -> DataFrame:
    # halves, as the difference of two large numbers may overflow; the quotient never falls while v rises
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    piece = F.when(F.col("v") == F.col("hi"), PIECES).otherwise(F.least(F.floor(share * PIECES), F.lit(PIECES - 1)))
    parts = _inside(values, ranks, named, single).withColumn("piece", piece).groupBy(*named, "lo", "hi", "piece").agg(
        F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size"))
    parts = parts.withColumn("start", _started(parts, named, "piece"))
    return _matched(ranks, parts, named).select(
        *[F.col(f"r.{k}").alias(k) for k in named], F.col("p.low").alias("lo"), F.col("p.high").alias("hi"), "p.size",
        "r.name", "r.at", "r.rank", (F.col("r.before") + F.col("p.start")).alias("before"))
