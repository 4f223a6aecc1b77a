"""Market regime of each bar: trend or range, and how high volatility stands among recent bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.features import W, adx, atr


def rolling_rank(x: str, n: int, least: int) -> Column:
    """Average rank of x among the last n bars' values as a share of their number; null under ``least`` values or without x.

    The window holds n values at most, whatever the series' length.
    """
    seen = F.collect_list(x).over(W().rowsBetween(-(n - 1), 0))
    place = F.size(F.filter(seen, lambda v: v < F.col(x))) + (F.size(F.filter(seen, lambda v: v == F.col(x))) + 1) / 2
    return F.when(F.col(x).isNotNull() & (F.size(seen) >= least), place / F.size(seen))


def classify_regime(bars: DataFrame, adx_period: int = 14, trend_from: float = 25.0, lookback: int = 252, least: int = 60) -> DataFrame:
    """``bars`` with adx, atr_pct, vol_pct, trend (trend, range), vol (low, normal, high) and label (both); unknown where a figure lacks."""
    d = atr(adx(bars, adx_period), 14, "__atr").withColumn("atr_pct", F.try_divide("__atr", "close")).drop("__atr")
    d = d.withColumn("vol_pct", rolling_rank("atr_pct", lookback, least))
    known = F.col("adx").isNotNull() & F.col("vol_pct").isNotNull()
    trend = F.when(known, F.when(F.col("adx") >= trend_from, "trend").otherwise("range")).otherwise("unknown")
    vol = F.when(known, F.when(F.col("vol_pct") < 0.33, "low").when(F.col("vol_pct") > 0.67, "high").otherwise("normal")).otherwise("unknown")
    return d.withColumns({"trend": trend, "vol": vol}).withColumn("label", F.concat_ws("/", "trend", "vol"))
