"""Interval joins as equi-joins on time buckets of several widths.

A plain range condition on ``project_id`` alone compares all pairs of a recording in one task. Here both sides are spread
over buckets. An interval's own buckets are the narrowest, of ``width`` times a power of four, that are no shorter than it,
so it touches two of them at most, be it a word or a span to the end of time. Two intervals meet in the buckets of the longer
one; the shorter one is therefore also put into the wider buckets that are the own ones of some interval of the other side,
which for most tables are none. A pair is emitted in the first of those buckets that both sides share, so exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.session import cut_lineage

#: Widths are ``width`` times 4 to the power of 0 ... LEVELS; times beyond LIMIT stand at LIMIT.
LEVELS, LIMIT = 22, 1e15


def _bound(x: Column) -> Column:
    """A time for buckets: within the limits, null for NaN."""
    x = x.cast("double")
    return F.when(~F.isnan(x), F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x)))


def _level(lo: Column, hi: Column, width: float) -> Column:
    """Number of the narrowest buckets that are no shorter than the interval."""
    times = F.greatest(F.lit(1.0), (hi - lo) / F.lit(float(width)))
    return F.least(F.lit(LEVELS), F.ceil(F.log2(times) / 2)).cast("int")


def _bucket(x: Column, width: float, level: Column) -> Column:
    return F.floor(x / (F.lit(float(width)) * F.pow(F.lit(4.0), level)))


def _levels(df: DataFrame, level: Column) -> Column:
    """The levels that occur, as a scalar: at most LEVELS + 1 numbers."""
    return F.coalesce(df.agg(F.collect_set(level)).scalar(), F.array().cast("array<int>"))


def _spread(df: DataFrame, lo: Column, hi: Column, width: float, others: Column, out: str, outer: bool = False) -> DataFrame:
    """``df`` in all its buckets, with ``out`` = struct(own, level, bucket): its own level, and the ``others`` above."""
    lo, hi = _bound(lo), F.greatest(_bound(lo), _bound(hi))
    own = _level(lo, hi, width)

    def at(level: Column) -> Column:
        cells = F.sequence(_bucket(lo, width, level), _bucket(hi, width, level))
        return F.transform(cells, lambda c: F.struct(own.alias("own"), level.cast("int").alias("level"), c.alias("bucket")))

    levels = F.array_union(F.array(own), F.filter("_levels", lambda x: x > own))
    cells = F.flatten(F.transform(levels, at))
    # a row without bounds meets nothing, but stays in a left join
    cells = F.when(lo.isNotNull() & hi.isNotNull(), cells)
    return df.withColumn("_levels", others).withColumn(out, (F.explode_outer if outer else F.explode)(cells)).drop("_levels")


def overlap_join(
    left: DataFrame, right: DataFrame, key: str, width: float = 60.0,
    slack: float = 0.0, closed: bool = False,
    l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("start", "end"), how: str = "inner",
) -> DataFrame:
    """Join of overlapping intervals. Right columns get the prefix ``r_``.

    ``closed`` keeps touching intervals; otherwise both ends must overlap by
    more than ``slack``. With ``how="left"`` a left row also appears, without
    right side, in every bucket where it meets nothing (see overlap_aggregate).
    Bounds are read once more to see which bucket widths occur.
    """
    ls, le = F.col(l[0]), F.col(l[1])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    rs, re_ = F.col(f"r_{r[0]}"), F.col(f"r_{r[1]}")

    def level(lo: Column, hi: Column) -> Column:
        return _level(_bound(lo), F.greatest(_bound(lo), _bound(hi)), width)

    a = _spread(left, ls, le, width, _levels(b, level(rs, re_)), "_b", how == "left")
    b = _spread(b, rs, re_, width, _levels(left, level(ls, le)), "_rb")
    hit = (re_ >= ls) & (rs <= le) if closed else (re_ > ls + slack) & (rs < le - slack)
    at = F.col("_b.level")
    first_shared = F.col("_b.bucket") == F.greatest(_bucket(_bound(ls), width, at), _bucket(_bound(rs), width, at))
    return a.join(
        b, (F.col(key) == F.col(f"r_{key}")) & (at == F.col("_rb.level")) & (F.col("_b.bucket") == F.col("_rb.bucket"))
        & (at == F.greatest("_b.own", "_rb.own")) & first_shared & hit, how
    ).drop("_b", "_rb", f"r_{key}")


def overlap_aggregate(
    left: DataFrame, right: DataFrame, key: str, ids: list[str], aggs: list[Column],
    l: tuple[str, str] = ("start", "end"), uses: tuple[str, ...] = ("start", "end"), **join
) -> DataFrame:
    """Left rows (unique by ``key`` and ``ids``) plus aggregates over the right rows they overlap.

    Only the left row's key, ids, bounds and the columns in ``uses`` go through buckets, join and grouping; the aggregates
    may refer to those. The row itself is checkpointed and joined back once. Aggregates must ignore nulls: rows without
    any partner arrive with an empty right side.
    """
    left = cut_lineage(left)
    narrow = left.select(*dict.fromkeys([key, *ids, *l, *(c for c in uses if c in left.columns)]))
    g = overlap_join(narrow, right, key, l=l, how="left", **join).groupBy(key, *ids).agg(*aggs)
    extra = [c for c in g.columns if c not in (key, *ids)]
    a, b = left.alias("a"), g.alias("b")
    on = F.lit(True)
    for c in (key, *ids):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).select("a.*", *[F.col(f"b.{c}").alias(c) for c in extra])


def point_join(
    points: DataFrame, spans: DataFrame, key: str, point: str, lo: str, hi: str, width: float,
    open_lo: bool = False, open_hi: bool = False,
) -> DataFrame:
    """Inner join of points with the spans that contain them; span columns get ``r_``. A point is put into one bucket of
    each width that some span has, a span into its own buckets."""
    b = spans.select(*[F.col(c).alias(f"r_{c}") for c in spans.columns])
    lo_c, hi_c, p = F.col(f"r_{lo}"), F.col(f"r_{hi}"), F.col(point)
    level = _level(_bound(lo_c), F.greatest(_bound(lo_c), _bound(hi_c)), width)
    cells = F.transform("_levels", lambda x: F.struct(x.alias("level"), _bucket(_bound(p), width, x).alias("bucket")))
    a = points.withColumn("_levels", _levels(b, level)).withColumn("_b", F.explode(F.when(_bound(p).isNotNull(), cells))).drop("_levels")
    b = _spread(b, lo_c, hi_c, width, F.array().cast("array<int>"), "_rb")
    hit = (p > lo_c if open_lo else p >= lo_c) & (p < hi_c if open_hi else p <= hi_c)
    return a.join(
        b, (F.col(key) == F.col(f"r_{key}")) & (F.col("_b.level") == F.col("_rb.level")) & (F.col("_b.bucket") == F.col("_rb.bucket")) & hit
    ).drop("_b", "_rb", f"r_{key}")


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap divided by the shorter interval."""
    shorter = F.least(F.greatest(F.lit(0.0), e1 - s1), F.greatest(F.lit(0.0), e2 - s2))
    return overlap_seconds(s1, e1, s2, e2) / F.greatest(F.lit(0.001), shorter)
