"""Row-offset window operators (previous/next row within a key, ordered)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_lead(df: DataFrame, value: str, keys: Sequence[str], order: str,
             prev: str = "prev", nxt: str = "next") -> DataFrame:
    """Previous and next ``value`` per key along ``order`` (one window spec, one sort)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(prev, F.lag(value).over(w)).withColumn(nxt, F.lead(value).over(w))


def pct_change(df: DataFrame, value: str, keys: Sequence[str], order: str,
               prev: str = "prev_value", pct: str = "pct_change", scale: int = 2) -> DataFrame:
    """Previous row's value and the percent change to it, rounded half-up.

    The change is null unless the previous value is positive. ``value`` must be an
    exact decimal; the previous value is computed once and reused.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn(prev, F.lag(value).over(w))
    v, p = F.col(value).cast("decimal(22,2)"), F.col(prev).cast("decimal(22,2)")
    change = F.when(p > 0, F.round((v - p) * 100 / p, scale))
    return out.withColumn(pct, change)
