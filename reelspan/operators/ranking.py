"""Top-k and latest-row selection per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key. The row_number filter becomes a WindowGroupLimit, which
    trims every map task to n rows per key before the shuffle, so a hot key
    costs at most (map tasks x n) rows in its reducer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= n)
    return ranked if rank else ranked.drop("_rank")


def latest_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Newest row per (possibly computed) key."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    d = df.withColumns(named)
    return top_per_key(d, list(named), order, 1).drop(*named)
