"""From signals to trade outcomes, as joins over the bars that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.features import W


@dataclass
class ExitRule:
    stop_atr: float
    target_r: float
    max_bars: int
    cost_bps: float = 3.0
    risk_usd: float = 1000.0


def candidates(signals: DataFrame, rule: ExitRule) -> DataFrame:
    """One row for each signal that is long or short but not both, filled at the next open with costs."""
    d = signals.withColumn("rn", F.row_number().over(W())).withColumn("next_open", F.lead("open").over(W()))
    return priced(d.where(F.col("long_entry") != F.col("short_entry")), rule)


def priced(asked: DataFrame, rule: ExitRule, also: tuple[str, ...] = ()) -> DataFrame:
    """Entries (rn, next_open, atr, long_entry) with fill, stop, target and quantity, and the columns ``also``; fields of the rule may be Columns."""
    d = asked.where("next_open is not null and atr > 0").withColumn("side", F.when(F.col("long_entry"), 1).otherwise(-1))
    d = d.withColumn("entry", F.col("next_open") * (1 + F.col("side") * rule.cost_bps / 1e4))
    d = d.withColumn("stop", F.col("entry") - F.col("side") * rule.stop_atr * F.col("atr"))
    d = d.withColumn("target", F.col("entry") + F.col("side") * rule.target_r * rule.stop_atr * F.col("atr"))
    d = d.withColumn("limit", F.lit(rule.max_bars).cast("int"))
    qty = F.floor(rule.risk_usd / F.abs(F.col("entry") - F.col("stop")))
    return d.withColumn("qty", qty).where("qty >= 1").select(*also, "symbol", "tf", "rn", "side", "entry", "stop", "target", "qty", "limit")


def steps(entries: DataFrame, rule: ExitRule) -> DataFrame:
    """Each entry with the numbers of the bars from its own to the one whose open takes the time limit."""
    return entries.withColumn("j", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + 1 + F.col("limit"))))


def paths(entries: DataFrame, signals: DataFrame, rule: ExitRule) -> DataFrame:
    """Each entry with the bars from its own to the one whose open takes the time limit; an equi-join on the bar number."""
    bars = signals.select("symbol", "tf", F.row_number().over(W()).alias("j"), "ts", "open", "high", "low", "close", "long_exit", "short_exit", F.lead("open").over(W()).isNull().alias("last"))
    return steps(entries, rule).join(bars, ["symbol", "tf", "j"])


def outcomes(path: DataFrame, rule: ExitRule, also: tuple[str, ...] = ()) -> DataFrame:
    """The first exit of each entry: (``also``, symbol, tf, rn, exit_rn, exit_ts, reason, side, entry, exit, qty, net_pnl, r_multiple).

    ``also``: further columns that tell entries apart, such as a parameter set. At one open the time limit is the reason before an exit signal, and both come before stop and target.
    """
    keys = [*also, "symbol", "tf", "rn"]
    w = Window.partitionBy(*keys).orderBy("j")
    later = F.col("j") > F.col("rn") + 1
    asked = F.lag(F.when(F.col("side") > 0, F.col("long_exit")).otherwise(F.col("short_exit"))).over(w)
    s = F.col("side")
    worse = lambda a, b: s * a <= s * b
    adverse = F.when(s > 0, F.col("low")).otherwise(F.col("high"))
    favour = F.when(s > 0, F.col("high")).otherwise(F.col("low"))
    o = F.col("open")
    hit = (
        F.when(F.col("j") == F.col("rn") + 1 + F.col("limit"), F.struct(F.lit("time").alias("reason"), o.alias("exit")))
        .when(later & F.coalesce(asked, F.lit(False)), F.struct(F.lit("signal").alias("reason"), o.alias("exit")))
        .when(later & worse(o, F.col("stop")), F.struct(F.lit("stop_gap").alias("reason"), o.alias("exit")))
        .when(later & worse(F.col("target"), o), F.struct(F.lit("target_gap").alias("reason"), o.alias("exit")))
        .when(worse(adverse, F.col("stop")), F.struct(F.lit("stop").alias("reason"), F.col("stop").alias("exit")))
        .when(worse(F.col("target"), favour), F.struct(F.lit("target").alias("reason"), F.col("target").alias("exit")))
        .when(F.col("last"), F.struct(F.lit("end_of_data").alias("reason"), F.col("close").alias("exit")))
    )
    first = path.withColumn("hit", hit).where("hit is not null").groupBy(*keys).agg(
        F.min_by(F.struct("j", "ts", "hit", "side", "entry", "stop", "qty"), "j").alias("x")
    )
    x = lambda c: F.col(f"x.{c}")
    fill = F.col("x.hit.exit") * (1 - x("side") * rule.cost_bps / 1e4)
    net = x("qty") * x("side") * (fill - x("entry"))
    return first.select(
        *keys, x("j").alias("exit_rn"), x("ts").alias("exit_ts"), F.col("x.hit.reason").alias("reason"),
        x("side").alias("side"), x("entry").alias("entry"), fill.alias("exit"), x("qty").alias("qty"), net.alias("net_pnl"),
        (net / (x("qty") * F.abs(x("entry") - x("stop")))).alias("r_multiple"),
    )


def one_at_a_time(trades: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Of the candidates of each symbol (and ``also``) those taken when no other is open: signal_rn >= the exit of the trade before."""
    keys = [*also, "symbol", "tf"]
    start = F.struct(F.lit(0).cast("int").alias("free"), F.array().cast("array<int>").alias("taken"))
    rows = trades.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "exit_rn"))).alias("c"))
    picked = rows.select(*keys, F.aggregate(
        "c", start, lambda a, x: F.when(x["rn"] >= a["free"], F.struct(x["exit_rn"].alias("free"), F.concat(a["taken"], F.array(x["rn"])).alias("taken"))).otherwise(a), lambda a: a["taken"]
    ).alias("t"))
    return trades.join(picked.select(*keys, F.explode("t").alias("rn")), [*keys, "rn"], "left_semi")


def run(signals: DataFrame, rule: ExitRule) -> DataFrame:
    return one_at_a_time(outcomes(paths(candidates(signals, rule), signals, rule), rule))


def exposure(trades: DataFrame) -> DataFrame:
    """Open positions after each entry or exit over time (a sweep over +1 and -1 events)."""
    e = trades.select(F.col("entry_ts").alias("ts"), F.lit(1).alias("x")).unionByName(trades.select(F.col("exit_ts").alias("ts"), F.lit(-1).alias("x")))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return e.groupBy("ts").agg(F.sum("x").alias("x")).select("ts", F.sum("x").over(w).alias("open"))
