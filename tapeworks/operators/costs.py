"""Trading costs as Columns of trades and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.align import asof, ny


# The broker's fees and default spreads below
def stock_fill(mid: Column, side: Column, half_spread_bps=1.0, slippage_bps=2.0, stress=1.0) -> Column:
    """The price filled; ``half_spread_bps`` may be a Column with a symbol's own spread."""
    return mid + side * (half_spread_bps + slippage_bps) / 1e4 * mid * stress


def stock_fees(price: Column, qty: Column, side: Column) -> Column:
    """Platform 0.99, settlement 0.003 a share; a sale pays the regulator's 27.80e-6 and an activity fee up to 8.30."""
    sale = side < 0
    return F.struct(
        F.lit(0.99).alias("platform"), (0.003 * qty).alias("settlement"),
        F.when(sale, 27.80e-6 * price * qty).otherwise(0.0).alias("sec"),
        F.when(sale, F.least(0.000166 * qty, F.lit(8.30))).otherwise(0.0).alias("taf"),
    )


def overnight_days(t0: Column, t1: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(ny(t1), ny(t0)))


def pip_size(pair: Column) -> Column:
    return F.when(F.split(pair, "_")[1] == "JPY", 0.01).otherwise(0.0001)


def fx_fill(mid: Column, side: Column, pair: Column, half_spread_pips=0.6, slippage_pips=0.2, stress=1.0) -> Column:
    return mid + side * (half_spread_pips + slippage_pips) * pip_size(pair) * stress


def _cut_days(day: Column) -> Column:
    """Days that the 17:00 cut of a New York date stands for: 1 Monday to Thursday, 3 Friday, 0 at the weekend."""
    d = F.dayofweek(day)
    return F.when(d == 6, 3).when(d.isin(1, 7), 0).otherwise(1)


def _cut(day: Column) -> Column:
    return F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(" 17:00:00"))), "America/New_York")


def rollover_days(t0: Column, t1: Column) -> Column:
    """Days of financing of the 17:00 New York cuts in (t0, t1]."""
    days = F.sequence(F.to_date(ny(t0)), F.to_date(F.greatest(ny(t1), ny(t0))))
    held = lambda d: (_cut(d) > t0) & (_cut(d) <= t1)
    return F.aggregate(days, F.lit(0), lambda a, d: a + F.when(held(d), _cut_days(d)).otherwise(0))


def next_rollover(t: Column) -> Column:
    """struct<at, days>: the next 17:00 New York cut after t on a weekday."""
    day = F.to_date(ny(t))
    days = F.sequence(day, F.date_add(day, 4))
    coming = F.filter(days, lambda d: (_cut(d) > t) & (_cut_days(d) > 0))
    return F.struct(_cut(coming[0]).alias("at"), _cut_days(coming[0]).alias("days"))


def read_policy_rates(spark: SparkSession, path: str) -> DataFrame:
    """(ccy, d, rate as a fraction) of CSV rows ``date,currency,rate`` in percent; lines that begin with # are passed over."""
    raw = spark.read.schema("date date, currency string, rate double").option("header", True).option("comment", "#").csv(path)
    return policy_rates(raw.select(F.col("currency").alias("ccy"), F.col("date").alias("d"), "rate"))


def policy_rates(rates: DataFrame) -> DataFrame:
    """Percent to fraction."""
    return rates.select("ccy", "d", (F.col("rate") / 100).alias("rate"))


def unknown_currencies(rows: DataFrame, rates: DataFrame, ccy: str) -> DataFrame:
    """The currencies of ``rows`` that have no rate at all."""
    return rows.select(F.col(ccy).alias("ccy")).distinct().join(rates, "ccy", "left_anti")


def rate_at(rows: DataFrame, rates: DataFrame, ccy: str, at: str, out: str) -> DataFrame:
    """``out``: the currency's rate at a date; before its first date the first rate.

    A currency without any rate is an error when its row is reached; see ``unknown_currencies``.
    """
    r = rates.select(F.col("ccy").alias(ccy), "d", "rate")
    first = r.groupBy(ccy).agg(F.min_by("rate", "d").alias("__first"))
    got = asof(rows.withColumn("__at", F.to_date(at)), r, [ccy], "__at", "d", ["rate"], "__r").drop("__at")
    missing = F.raise_error(F.concat(F.lit("no policy rate for "), F.col(ccy))).cast("double")
    found = F.coalesce("__r.rate", "__first")
    return got.join(first, ccy, "left").withColumn(out, F.when(found.isNull(), missing).otherwise(found)).drop("__r", "__first")


# Yearly rates of borrowed shares and margin, the fee on financing, and rough dollars per unit
BORROW, MARGIN, DAY_COUNT, ADMIN = 0.005, 0.068, 360, 0.025
USD_PER_UNIT = {"EUR": 1.10, "GBP": 1.30, "AUD": 0.66, "JPY": 1 / 150, "CHF": 1.15, "CAD": 0.73}


def stock_holding(direction: Column, qty: Column, price: Column, days: Column, borrowed_usd: Column, borrow_rate: Column | float = BORROW) -> Column:
    """struct<borrow, margin_interest> for the nights held; a short pays the borrow, margin is paid on borrowed dollars."""
    rate = borrow_rate if isinstance(borrow_rate, Column) else F.lit(borrow_rate)
    return F.struct(
        F.when((direction < 0) & (days > 0), qty * price * rate * days / DAY_COUNT).otherwise(0.0).alias("borrow"),
        F.when((borrowed_usd > 0) & (days > 0), borrowed_usd * MARGIN * days / DAY_COUNT).otherwise(0.0).alias("margin_interest"),
    )


def fx_fees() -> Column:
    """Currency orders pay no fees."""
    return F.struct(*[F.lit(0.0).alias(c) for c in ("platform", "settlement", "sec", "taf")])


def annual_rates(rows: DataFrame, rates: DataFrame, pair: str, direction: str, at: str, out: str = "annual_rate") -> DataFrame:
    """``out``: the financing rate of a pair, received (+) or paid (-) on the base amount: the rate gap less the fee."""
    d = rows.withColumn("__base", F.split(pair, "_")[0]).withColumn("__quote", F.split(pair, "_")[1])
    d = rate_at(rate_at(d, rates, "__base", at, "__rb"), rates, "__quote", at, "__rq")
    gap = F.col("__rb") - F.col("__rq")
    return d.withColumn(out, F.when(F.col(direction) > 0, gap).otherwise(-gap) - ADMIN).drop("__base", "__quote", "__rb", "__rq")


def usd_per_unit(rows: DataFrame, series: DataFrame, ccy: str, at: str, out: str) -> DataFrame:
    """``out``: dollars per unit: 1 for USD, the last of ``series`` (ccy, ts, usd) at that time, else a constant; null if unknown."""
    r = series.select(F.col("ccy").alias(ccy), "ts", "usd")
    got = asof(rows, r.withColumnRenamed("ts", "__ts"), [ccy], at, "__ts", ["usd"], "__u")
    rough = F.create_map(*[F.lit(x) for kv in USD_PER_UNIT.items() for x in kv])
    value = F.when(F.col(ccy) == "USD", F.lit(1.0)).otherwise(F.coalesce("__u.usd", F.try_element_at(rough, F.col(ccy))))
    return got.withColumn(out, value).drop("__u")


def fx_financing(qty: Column, usd: Column, annual_rate: Column, days: Column) -> Column:
    """Dollars paid (+) for holding over the cuts."""
    return -qty * usd * annual_rate * days / 365.0


def by_class(asset_class: Column, stocks: Column, forex: Column) -> Column:
    """The cost of the row's asset class; another class is an error."""
    other = F.raise_error(F.concat(F.lit("no cost model for "), asset_class))
    return F.when(asset_class == "stocks", stocks).when(asset_class == "forex", forex).otherwise(other)
