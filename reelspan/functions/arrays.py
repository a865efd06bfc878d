"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unfold(df: DataFrame, array: Column | str, name: str, pos: str = "_pos") -> DataFrame:
    """One row per array element (``pos`` from 0), none for empty arrays.

    Same rows as ``posexplode``. The outer form keeps Catalyst from adding a
    ``size(array) > 0`` filter below, which would evaluate a computed array's
    whole expression a second time.
    """
    d = df.select("*", F.posexplode_outer(array).alias(pos, name))
    return d.where(F.col(pos).isNotNull())
