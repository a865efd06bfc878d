"""Ordered scans that never put one key's whole history into one task.

A recording (or a project) may hold a third of all rows. Running sums and
maxima are therefore two-level: inside (key, block) windows, plus a carry
computed over one row per block. Look-arounds of bounded reach use chunks with
a halo: rows near a chunk edge are repeated in the neighbouring chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(
    df: DataFrame, keys: list[str], order: list, block: Column,
    aggs: dict[str, tuple[str, Column]], inclusive: bool = False,
) -> DataFrame:
    """Add running aggregates over all earlier rows of the key.

    ``order`` is a total order inside a key, ``block`` an integer that never
    decreases along it, ``aggs`` maps a name to ("sum" | "max", column).
    Sums start at 0; maxima start at null and accept structs.
    """
    fn = {"sum": F.sum, "max": F.max}
    d = df.withColumn("_blk", block.cast("long")).withColumns(
        {f"_v_{n}": c for n, (_, c) in aggs.items()}
    )
    totals = d.groupBy(*keys, "_blk").agg(*[fn[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in aggs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_blk").alias("_c_blk"),
        *[fn[k](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in aggs.items()],
    )
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    d = d.withColumns({f"_i_{n}": fn[k](f"_v_{n}").over(inside) for n, (k, _) in aggs.items()})
    on = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_blk") == F.col("_c_blk")]
    d = d.join(carry, on, "left")
    for n, (k, _) in aggs.items():
        own, before = F.col(f"_i_{n}"), F.col(f"_c_{n}")
        d = d.withColumn(
            n, F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)) if k == "sum" else F.greatest(own, before)
        )
    return d.drop("_blk", "_c_blk", *[f"_c_{k}" for k in keys],
                  *[f"_{p}_{n}" for n in aggs for p in ("v", "i", "c")])


def with_halo(df: DataFrame, coord: Column, size: float, before: float = 0, after: float = 0) -> DataFrame:
    """Assign rows to chunks of ``size`` along ``coord``; ``_home`` marks the one
    chunk a row belongs to, other copies only serve as context for rows that
    look back ``before`` or ahead ``after``."""
    first = F.floor((coord - F.lit(after)) / F.lit(size))
    last = F.floor((coord + F.lit(before)) / F.lit(size))
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_home", F.col("_chunk") == F.floor(coord / F.lit(size))
    )


def neighbours(df: DataFrame, keys: list[str], pos: str, block_rows: int = 4096):
    """Chunk dense positions so that lag/lead by one or two rows is local.

    Returns the chunked frame and the window to use; keep ``_home`` rows."""
    d = with_halo(df, F.col(pos), block_rows, before=2, after=2)
    return d, Window.partitionBy(*keys, "_chunk").orderBy(pos)
