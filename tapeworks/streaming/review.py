"""Positions reviewed as bars arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tapeworks.operators.review import ReviewPolicy, review_book

#: What a market snapshot holds besides symbol and time; a stream's missing ones are null.
SNAPSHOT = {"price": "double", "atr": "double", "bar_hours": "double", "cut_time": "timestamp", "cut_cost": "double", "event_time": "timestamp"}


def latest_snapshots(bars: DataFrame) -> DataFrame:
    """(symbol, time, price, ...) of each symbol's last bar by time; a bar is known at its end, and of bars of one time the higher price counts."""
    held = [F.col(c).cast(t).alias(c) if c in bars.columns else F.lit(None).cast(t).alias(c) for c, t in SNAPSHOT.items()]
    return bars.select("symbol", F.struct("time", *held).alias("s")).groupBy("symbol").agg(F.max_by("s", F.struct("s.time", "s.price")).alias("s")).select("symbol", "s.*")


def review_arrivals(bars: DataFrame, positions: DataFrame, policy: ReviewPolicy | None = None) -> DataFrame:
    """Every position with a bar among ``bars`` and its actions; bars held are counted from the entry where ``positions`` does not say."""
    snapshots = latest_snapshots(bars)
    book = positions
    if "bars_held" not in book.columns:
        clock = snapshots.select("symbol", F.col("time").alias("__at"), F.col("bar_hours").alias("__hours"))
        hours = (F.unix_seconds(F.col("__at").cast("timestamp")) - F.unix_seconds(F.col("entry_time").cast("timestamp"))) / 3600
        book = book.join(clock, "symbol").withColumn("bars_held", F.floor(F.try_divide(hours, F.col("__hours")))).drop("__at", "__hours")
    return review_book(book.join(snapshots.select("symbol"), "symbol", "left_semi"), snapshots, policy)


def review_on_arrival(bars: DataFrame, positions: DataFrame, out: str, policy: ReviewPolicy | None = None) -> DataStreamWriter:
    """A writer, to be started, that reviews the static ``positions`` with each micro-batch of the stream ``bars``.

    Each batch writes its reviews to a folder of its own number under ``out`` and replaces what is there, so a batch
    run again after a failure counts once. Nothing is kept between batches.
    """

    def run(batch: DataFrame, number: int) -> None:
        review_arrivals(batch, positions, policy).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return bars.writeStream.foreachBatch(run)
