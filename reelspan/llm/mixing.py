"""Mixing sources to target weights by entropy balancing.

Every document starts at rate one copy. Among all rates between 0 and ``MOST`` whose words add up to the target of each
source, entropy balancing takes those nearest to the start: rate = MOST * s(lambda * z), s the logistic function, z the
document's words over its source's mean, which is an exponential tilt of the odds rate : (MOST - rate). The lambdas
solve a convex dual, one constraint a source; Newton steps on the counts per (source, size) find them, all sources at
once, with a bracket that a step may not leave. Rates become copies by systematic rounding along each source, so the
words taken stay within about one document of the target, and a last step moves single documents to close the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from reelspan.llm.common import WORD, keep_rows, row_keys, stage

#: Copies a document may have; weights in turn by source; share of all words that the mix takes.
MOST, WEIGHTS, SHARE = 2, (3, 1, 2), 1.5
#: Newton steps at most, relative error at which they end, unit of the rates (sums of integers do not depend on order).
STEPS, ERROR, UNIT_BITS, ROWS_A_BLOCK = 60, 1e-9, 24, 20_000
_EXACT = "decimal(38,9)"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, times: str = "1") -> DataFrame:
    """sid, source, source_size, target, mean, n: one row per source of ``sizes`` (source, size), whose rows stand for ``times`` documents.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all words; no target is
    above ``most`` times its source's size, what is cut goes to the others by weight. With c(w) = least c at which the
    targets min(most * size, c * weight) reach the sum: sources are capped in the order of size / weight, and the first
    c that is not above the next ratio is the one. The windows see one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum(F.expr(f"size * {times}")).alias("source_size"), F.sum(F.expr(times)).alias("n"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    s = s.withColumn("sid", place)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int") + 1))
    ratio = F.col("source_size") * most / F.col("weight")
    by_ratio = W.orderBy(ratio, "sid")
    upto = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({
        "_ratio": ratio, "_all": F.sum("source_size").over(everything), "_capped": F.coalesce(F.sum("source_size").over(upto), F.lit(0)),
        "_open": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))})
    s = s.withColumn("_c", (F.col("_all") * share - F.col("_capped") * most) / F.col("_open"))
    c = F.min(F.when(F.col("_c") <= F.col("_ratio"), F.struct("_ratio", "sid", "_c"))).over(everything)["_c"]
    s = s.withColumn("target", F.least(F.col("source_size") * float(most), F.coalesce(c, F.lit(float("inf"))) * F.col("weight")))
    return s.select("sid", "source", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean"), "n")


def solve(counts: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """sid, lam: the dual's solution for each source that needs one. counts: sid, size, n (documents of that size)."""
    open_ = (F.col("target") < F.col("source_size") * most) & (F.col("target") > 0)
    point = stage(sources.where(open_).select(
        "sid", "mean", (F.col("target") / F.col("mean")).alias("goal"), F.lit(0.0).alias("lam"), F.lit(-float("inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
    z = F.col("size") / F.col("mean")
    s = 1 / (1 + F.exp(-F.col("lam") * z))
    for _ in range(STEPS):
        sums = counts.join(point, "sid").groupBy("sid").agg(
            F.sum((F.col("n") * z * most * s).cast(_EXACT)).cast("double").alias("got"),
            F.sum((F.col("n") * z * z * most * s * (1 - s)).cast(_EXACT)).cast("double").alias("slope"))
        d = point.join(sums, "sid")
        gap = F.col("goal") - F.col("got")
        d = d.withColumns({"gap": gap, "lo": F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(gap < 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") + F.col("gap") / F.col("slope")
        ok = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 2 + 2 * F.abs("lam"))
        half = F.when((F.col("lo") > -float("inf")) & (F.col("hi") < float("inf")), (F.col("lo") + F.col("hi")) / 2).otherwise(
            F.col("lam") + F.signum("gap") * (2 + F.abs("lam")))
        d = d.withColumn("next", F.when(F.abs("gap") <= F.col("goal") * ERROR, F.col("lam")).when(ok, newton).otherwise(half))
        step = stage(d.select("sid", "mean", "goal", F.col("next").alias("lam"), "lo", "hi", (F.abs("gap") / F.col("goal")).alias("error")))
        point = step.drop("error")
        if step.where(F.col("error") > ERROR).isEmpty():
            break
    return point.select("sid", "lam")


def balance(sized: DataFrame, most: int = MOST) -> DataFrame:
    """``sized`` (source, size long, and names of the row) with source_size, target and copies, one row per row.

    Rows that are equal in all columns are one item with their number, ``_m``, until the end, when its copies are dealt to
    them evenly. Items are named by their columns, so that what is rounded and corrected depends on the data alone:
    reruns agree under any order and partitioning of the rows, and all sums that decide are exact. The items are staged
    once; the sources' numbers are joined to them. A source of any number of items is cut into blocks of about
    ROWS_A_BLOCK by a hash. Null sources are one source; rows without words cost nothing and keep about one copy; a
    target of zero takes nothing. An empty table gives an empty table.
    """
    names = [c for c in sized.columns if c not in ("source", "size")]
    rows = sized.groupBy(*sized.columns).agg(F.count("*").alias("_m"))
    h = F.xxhash64(*names, "source", "size", F.lit(7))
    rows = stage(rows.withColumn("_row", F.struct(h.alias("_h"), *names, "source", "size")))
    sources = stage(source_targets(rows, most=most, times="_m"))
    rows = rows.withColumn("_s", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    named = sources.withColumn("_s", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))).drop("source")
    counts = stage(rows.groupBy("_s", "size").agg(F.sum("_m").alias("n")).join(named.select("_s", "sid"), "_s").select("sid", "size", "n"))
    lams = solve(counts, sources, most)
    known = stage(named.join(lams, "sid", "left"))

    unit = 1 << UNIT_BITS
    n = rows.count()
    blocks = max(1, -(-n // ROWS_A_BLOCK))
    z = F.col("size") / F.col("mean")
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(most)).otherwise(most / (1 + F.exp(-F.col("lam") * z)))
    d = rows.join(known, "_s").withColumns({"_block": F.pmod("_row._h", F.lit(blocks)).cast("int"), "_r": F.round(rate * unit).cast("long") * F.col("_m")})
    # every other block runs backwards, so that sizes do not jump where blocks meet
    way = F.when(F.col("_block") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    here = F.sum("_r").over(W.partitionBy("sid", "_block").orderBy(way, "_row"))
    carry = d.groupBy("sid", "_block").agg(F.sum("_r").alias("_sum"))
    carry = carry.select("sid", "_block", (F.sum("_sum").over(W.partitionBy("sid").orderBy("_block")) - F.col("_sum")).alias("_before"))
    d = d.withColumn("_here", here).join(carry, ["sid", "_block"])
    upto = F.col("_before") + F.col("_here") + unit // 2
    d = d.withColumn("copies", (F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("_r"), UNIT_BITS)))
    d = stage(d.drop("_block", "_r", "_here", "_before", "mean", "n", "lam", "_s"))
    moves = _corrections(d, most)
    # names are never null as a whole, and equal ones have equal hashes
    d = d.join(moves, "_row", "left").withColumn("_all", F.col("copies") + F.coalesce("_move", F.lit(0)))
    # the rows of an item again, in two steps, as their number has no bound; the first ones take what cannot be dealt evenly
    many = 4_096
    d = d.withColumn("_page", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / many))))
    d = d.withColumn("_i", F.explode(F.sequence(F.col("_page") * many, F.least((F.col("_page") + 1) * many, "_m") - 1)))
    copies = F.floor(F.col("_all") / F.col("_m")) + (F.col("_i") < F.col("_all") % F.col("_m")).cast("int")
    return d.withColumn("copies", copies.cast("int")).drop("_row", "sid", "_move", "_m", "_all", "_page", "_i")


def _corrections(d: DataFrame, most: int, rounds: int = 4) -> DataFrame:
    """_row, _move (+1 or -1): per source at most ``rounds`` documents whose size is nearest to the gap that is left."""
    gap = d.groupBy("sid").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    up = F.min(F.when(F.col("copies") < F.col("_m") * most, F.col("_row"))).alias("up")
    down = F.min(F.when(F.col("copies") > 0, F.col("_row"))).alias("down")
    sizes = stage(d.where("size > 0").groupBy("sid", "size").agg(up, down))
    gap = gap.withColumn("used", F.array().cast("array<bigint>"))
    out = None
    for _ in range(rounds):
        c = sizes.join(gap, "sid").where(~F.array_contains("used", F.col("size")))
        row = F.when(F.col("gap") > 0, F.col("up")).otherwise(F.col("down"))
        left = F.abs(F.abs("gap") - F.col("size"))
        c = c.withColumns({"row": row, "left": left}).where(row.isNotNull() & (left < F.abs("gap")))
        pick = c.groupBy("sid").agg(F.min(F.struct("left", "size", "row")).alias("p"))
        gap = stage(gap.join(pick, "sid", "left"))
        sign = F.signum("gap").cast("int")
        move = gap.where("p is not null").select(F.col("p.row").alias("_row"), sign.alias("_move"))
        out = move if out is None else out.union(move)
        gap = gap.select("sid", F.when(F.col("p").isNull(), F.col("gap")).otherwise(F.col("gap") - F.signum("gap") * F.col("p.size")).alias("gap"),
                         F.when(F.col("p").isNull(), F.col("used")).otherwise(F.array_append("used", F.col("p.size"))).alias("used"))
    return out


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """_k1, _k2 (``row_keys``), doc_id, size, source_size, target, copies of every row of ``docs``. Null texts have no words."""
    k1, k2 = row_keys()
    d = balance(docs.select(k1.alias("_k1"), k2.alias("_k2"), "doc_id", "source", words(F.col("text")).alias("size")))
    return d.select("_k1", "_k2", "doc_id", "size", "source_size", "target", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Same columns."""
    d = mixed_sizes(docs).groupBy("_k1", "_k2").agg(F.sum("copies").cast("int").alias("copies"), (F.count("*") > 1).alias("single"))
    return keep_rows(docs, d)
