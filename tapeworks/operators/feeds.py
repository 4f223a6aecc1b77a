"""How well one price feed stands in for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.features import candles, cross_free_signals

# Limits of the comparison
MEDIAN_BPS, P95_BPS, AGREEMENT, VOLUME_CV, LEAST, WARM = 5.0, 20.0, 0.97, 0.30, 30, 60
PRICES = ["open", "high", "low", "close", "volume"]


def joined_feeds(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Reference bars with the other feed's of the same time (``x_`` columns, null where it has none)."""
    return reference.select("symbol", "tf", "ts", *PRICES).join(other.select("symbol", "tf", "ts", *[F.col(c).alias(f"x_{c}") for c in PRICES]), ["symbol", "tf", "ts"], "left")


def feed_gaps(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Per symbol and timeframe: bars compared and missing, price gaps in basis points of the close, volume share.

    Only bars complete in both feeds are compared. Groups of under 30 such bars have null figures
    (``skipped``). A reference volume of 0 has no share.
    """
    both = joined_feeds(reference, other)
    whole = F.lit(True)
    for c in PRICES:
        whole = whole & F.col(c).isNotNull() & F.col(f"x_{c}").isNotNull()
    bps = lambda c: F.abs(F.col(f"x_{c}") - F.col(c)) / F.col("close") * 1e4
    rows = both.select(
        "symbol", "tf", whole.alias("whole"), F.col("x_close").isNull().alias("absent"), bps("close").alias("close_bps"), bps("high").alias("high_bps"),
        bps("low").alias("low_bps"), F.try_divide("x_volume", "volume").alias("share"),
    )
    when = lambda c: F.when(F.col("whole"), F.col(c))
    got = rows.groupBy("symbol", "tf").agg(
        F.sum(F.col("whole").cast("long")).alias("compared"), F.sum(F.col("absent").cast("long")).alias("missing"),
        *[F.percentile(when(f"{c}_bps"), q).alias(f"{c}_{name}") for c, q, name in (("close", 0.5, "median"), ("close", 0.95, "p95"), ("high", 0.95, "p95"), ("low", 0.95, "p95"))],
        F.max(when("close_bps")).alias("close_max"), F.percentile(when("share"), 0.5).alias("share_median"),
        F.try_divide(F.stddev_samp(when("share")), F.avg(when("share"))).alias("share_cv"),
    )
    enough = F.col("compared") >= LEAST
    figures = [c for c in got.columns if c not in ("symbol", "tf", "compared", "missing")]
    return got.withColumns({c: F.when(enough, F.col(c)) for c in figures}).withColumn("skipped", ~enough)


def signal_agreement(reference: DataFrame, other: DataFrame, least: int = WARM) -> DataFrame:
    """(symbol, tf, signal, agreement): share of complete bars after the first sixty on which both feeds give the same signal."""
    both = joined_feeds(reference, other).dropna()
    side = lambda p: both.select("symbol", "tf", "ts", *[F.col(f"{p}{c}").alias(c) for c in PRICES])
    names = None
    out = None
    for p in ("", "x_"):
        d = cross_free_signals(candles(side(p)))
        names = [c for c in d.columns if c.startswith("sig_")]
        d = d.select("symbol", "tf", "ts", *[F.col(n).alias(f"{p}{n}") for n in names])
        out = d if out is None else out.join(d, ["symbol", "tf", "ts"])
    out = out.withColumn("__n", F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("ts"))).where(F.col("__n") > least)
    same: list[Column] = [F.avg((F.col(n) == F.col(f"x_{n}")).cast("double")).alias(n.removeprefix("sig_")) for n in names]
    got = out.groupBy("symbol", "tf").agg(*same)
    return got.unpivot(["symbol", "tf"], [n.removeprefix("sig_") for n in names], "signal", "agreement")


def feed_verdict(gaps: DataFrame, agreement: DataFrame | None = None) -> DataFrame:
    """``price_ok``, ``volume_ok`` and ``notes`` for each compared group; without ``agreement`` signals do not count."""
    g = gaps
    if agreement is not None:
        trend = ~F.col("signal").startswith("cdl_")
        a = agreement.groupBy("symbol", "tf").agg(F.min(F.when(trend, F.col("agreement"))).alias("trend_least"), F.min(F.when(~trend, F.col("agreement"))).alias("candle_least"))
        g = g.join(a, ["symbol", "tf"], "left")
    else:
        g = g.withColumn("trend_least", F.lit(1.0)).withColumn("candle_least", F.lit(1.0))
    price = (F.col("close_median") <= MEDIAN_BPS) & (F.col("close_p95") <= P95_BPS) & (F.col("trend_least") >= AGREEMENT)
    g = g.withColumn("price_ok", F.coalesce(price, F.lit(False))).withColumn("volume_ok", F.coalesce(F.col("share_cv") <= VOLUME_CV, F.lit(False)))
    notes = F.array_compact(F.array(
        F.when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" bars missing"))),
        F.when(F.col("candle_least") < AGREEMENT, F.lit("candles differ")), F.when(~F.col("volume_ok"), F.lit("volume share unstable")),
    ))
    return g.withColumn("notes", F.array_join(notes, "; "))
