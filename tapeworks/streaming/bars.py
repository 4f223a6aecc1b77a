"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", order: str = "seq") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of each window of ``width``, of a stream or a table.

    ``ticks`` has symbol, ts, price, size and ``order``, which tells ticks of one instant apart. On a
    stream in append mode a bar comes out once the watermark has passed its end; of ticks more than
    ``late`` behind the latest one, those whose bar is already out are left out. Ticks without a time or price make no bar; a null
    size adds nothing. The state holds one row for each symbol and open window.
    """
    at = F.struct("ts", order)
    known = ticks.where("ts is not null and price is not null").withWatermark("ts", late)
    got = known.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("volume"),
    )
    return got.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
