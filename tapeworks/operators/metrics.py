"""Performance and risk statistics of return and trade tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.normal import normal_cdf, normal_inverse
from tapeworks.functions.state import shared_folder

YEAR = 252.0
#: Trades of a strategy that lie together in one row when blocks are drawn from them.
PIECE = 256


def sharpe_of(r: Column, per_year: float = YEAR) -> Column:
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd > 0), F.avg(r) / sd * F.sqrt(F.lit(per_year))).otherwise(0.0)


def sortino_of(r: Column) -> Column:
    low = F.when(r < 0, r)
    sd = F.stddev_samp(low)
    return F.when((F.count(low) >= 2) & (sd > 0), F.avg(r) / sd * F.sqrt(F.lit(YEAR))).otherwise(0.0)


def probabilistic_sharpe(n: Column, mean: Column, sd: Column, g1: Column, g2: Column, benchmark: Column) -> Column:
    """Probability that the true Sharpe (per period) beats the benchmark, from population skewness and excess kurtosis."""
    sr = F.when(sd > 0, mean / sd)
    skew = F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * g1)
    kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6) + 3)
    under = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.coalesce(F.when((n >= 3) & (under > 0), normal_cdf((sr - benchmark) * F.sqrt(n - 1.0) / F.sqrt(F.when(under > 0, under)))), F.lit(0.0))


def expected_max_sharpe(n: Column, variance: Column) -> Column:
    """Expected best Sharpe of n trials without skill."""
    e, g = 2.718281828459045, 0.5772156649015329
    best = (1 - g) * normal_inverse(1 - 1 / n) + g * normal_inverse(1 - 1 / (n * e))
    return F.when((n > 1) & (variance > 0), F.sqrt(variance) * best).otherwise(0.0)


def return_stats(returns: DataFrame, key: str = "strategy", trials: int = 10, variance: float = 0.001) -> DataFrame:
    """Per strategy: n, Sharpe, Sortino, largest drawdown, total return, probabilistic and deflated Sharpe."""
    w = Window.partitionBy(key).orderBy("d")
    curve = returns.withColumn("e", F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    curve = curve.withColumn("dd", F.col("e") / F.greatest(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - 1)
    r = F.col("ret")
    s = curve.groupBy(key).agg(
        F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"),
        sharpe_of(r).alias("sharpe"), sortino_of(r).alias("sortino"), F.min("dd").alias("max_drawdown"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"),
    )
    args = [F.col(c) for c in ("n", "m", "sd", "g1", "g2")]
    psr = probabilistic_sharpe(*args, F.lit(0.0))
    dsr = probabilistic_sharpe(*args, expected_max_sharpe(F.lit(float(trials)), F.lit(variance)))
    return s.select(key, "n", "sharpe", "sortino", "max_drawdown", "total_return", psr.alias("psr"), dsr.alias("dsr"))


def wilson_lower(wins: Column, n: Column, z: float = 1.645) -> Column:
    p = F.try_divide(wins, n)
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)).otherwise(0.0)


def trade_stats(trades: DataFrame, key: str = "strategy") -> DataFrame:
    """Per strategy: trades, win rate and its lower bound, profit factor (infinite without a loss), mean win and loss, expectancy, conservative Kelly."""
    pnl, won = F.col("net_pnl"), F.col("net_pnl") > 0
    gain, loss = F.sum(F.when(won, pnl).otherwise(0.0)), -F.sum(F.when(~won, pnl).otherwise(0.0))
    wins = F.sum(F.when(won, 1).otherwise(0))
    r = F.col("r_multiple")
    s = trades.groupBy(key).agg(
        F.count("*").alias("n_trades"), (wins / F.count("*")).alias("win_rate"), wilson_lower(wins, F.count("*")).alias("win_rate_lower"),
        F.when(loss > 0, gain / F.when(loss > 0, loss)).otherwise(F.when(gain > 0, F.lit(float("inf"))).otherwise(0.0)).alias("profit_factor"),
        F.avg(F.when(won, pnl)).alias("avg_win"), F.avg(F.when(~won, pnl)).alias("avg_loss"), F.avg(r).alias("expectancy_r"),
        F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r <= 0, r))).alias("payoff"),
    )
    p = F.col("win_rate_lower")
    kelly = F.greatest(F.lit(0.0), 0.25 * (p - F.try_divide(1 - p, F.col("payoff"))))
    return s.withColumn("kelly", F.coalesce(kelly, F.lit(0.0)))


# The costs a trade may bear.
COSTS = ("spread_slippage", "fees", "financing", "borrow", "margin_interest")


def cost_stats(trades: DataFrame, key: str = "strategy") -> DataFrame:
    """Per strategy: mean bars held, costs in dollars, each kind of them, their share of gross results, and day-trade violations.

    ``trades``: bars_held, gross_pnl, pdt_violation and the columns of COSTS; one that is missing or null is nothing. Gross is the size of
    results before any cost, so what spread and slippage took counts with it; a share of nothing is 0.
    """
    cost = {c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c in trades.columns else F.lit(0.0) for c in COSTS}
    violations = F.coalesce(F.sum(F.col("pdt_violation").cast("int")), F.lit(0)).cast("long") if "pdt_violation" in trades.columns else F.lit(0).cast("long")
    g = trades.groupBy(key).agg(F.avg("bars_held").alias("avg_bars_held"), F.sum(F.abs("gross_pnl")).alias("__gross"), *[v.alias(c) for c, v in cost.items()], violations.alias("violations"))
    total = sum((F.col(c) for c in COSTS), F.lit(0.0))
    gross = F.coalesce("__gross", F.lit(0.0)) + F.col("spread_slippage")
    return g.withColumn("costs_usd", total).withColumn("costs_share", F.when(gross != 0, total / F.when(gross != 0, gross)).otherwise(0.0)).drop("__gross")


def exit_reasons(trades: DataFrame, key: str = "strategy") -> DataFrame:
    return trades.groupBy(key, F.split("exit_reason", ":")[0].alias("reason")).agg(F.count("*").alias("n"))


def kelly_fraction(p: Column, payoff: Column) -> Column:
    return p - F.try_divide(1 - p, payoff)


def leverage_gate(ruin: Column, evidence: Column, most: Column) -> Column:
    """Leverage allowed for a stressed ruin chance and the evidence: none, positive, validated or arbitrage."""
    proven = evidence.isin("validated", "arbitrage")
    return (
        F.when(ruin > 0.10, 0.0).when(ruin > 0.02, F.when(proven | (evidence == "positive"), 1.0).otherwise(0.0))
        .when(ruin > 0.005, F.when(proven, 0.5 * most).otherwise(1.0))
        .otherwise(F.when(evidence == "arbitrage", 0.7 * most).when(evidence == "validated", 0.5 * most).otherwise(1.0))
    )


def summary(returns: DataFrame, trades: DataFrame, key: str = "strategy") -> DataFrame:
    """Per strategy: first and last day, total return, yearly growth over 365.25 days, ``return_stats`` and ``trade_stats``."""
    s = return_stats(returns, key)
    span = returns.groupBy(key).agg(F.min("d").alias("start"), F.max("d").alias("end"))
    years = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 86400e6 / 365.25
    growth = F.when(F.col("total_return") <= -1, -1.0).when(years > 0, F.pow(1 + F.col("total_return"), 1 / years) - 1).otherwise(0.0)
    return s.join(span, key).withColumn("cagr", growth).join(trade_stats(trades, key), key, "left")


def drawdown_scale(drawdown: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(drawdown) * 0.5 / 0.2)


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, i, other columns): rows counted from 0 within their key in ``order``, whose first column is left out.

    Sorted by range, so a key with many rows is cut over many tasks; each range counts its own rows and
    starts after those of the key in earlier ranges. The rows are written once to the shared folder, for ranges
    are drawn anew at every run.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4()}"
    place = F.monotonically_increasing_id()  # partition * 2^33 + place in it
    at = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).drop(order[0]).withColumn("__at", place)
    at.write.parquet(path)
    at = spark.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    ranges = at.groupBy(key, "__range").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(key, "__range", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("__off"))
    return at.join(ranges, [key, "__range"]).withColumn("i", F.col("__at") - F.col("__off")).drop("__at", "__range", "__off")


def bootstrap_ruin(
    trades: DataFrame, paths: int = 10_000, horizon: int = 200, block: int = 5, limit: float = 0.5, risk: float = 0.02, key: str = "strategy", worse_share: float = 0.15, worse_r: float = 0.1,
) -> DataFrame:
    """Share of resampled paths of each strategy that fall ``limit`` below their peak.

    A path strings together blocks of consecutive trades; where each begins comes from the md5 of
    strategy, path and block number, so any engine draws the same. Losses are stressed by 1.3,
    0.05 R is taken off each trade, and ``worse_r`` off a ``worse_share`` of the drawn trades, told by the
    last bits of the md5 of strategy, path and step. Trades without an R are left out; strategies
    with fewer trades than a block are ruined.
    """
    known = trades.where(F.col("r_multiple").isNotNull() & ~F.isnan("r_multiple"))
    stressed = F.when(F.col("r_multiple") < 0, 1.3 * F.col("r_multiple")).otherwise(F.col("r_multiple")) - 0.05
    t = numbered(known.select(key, "trade_id", stressed.alias("r")), key, ["trade_id", "r"])
    n = t.groupBy(key).agg(F.count("*").alias("n"))
    starts = n.where(F.col("n") >= block).select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("path")).select(
        key, "n", "path", F.explode(F.sequence(F.lit(0), F.lit(-(-horizon // block) - 1))).alias("b")
    )
    drawn = lambda name, at: F.conv(F.substring(F.md5(F.concat_ws(":", key, "path", name.cast("string"))), at, 8), 16, 10).cast("long")
    starts = starts.select(key, "path", "b", F.pmod(drawn(F.col("b"), 1), F.col("n") - block + 1).alias("i"))
    # trades lie in pieces, each with the first trades of the next one, so a block is cut from one piece
    size = max(PIECE, block)
    piece = F.floor(F.col("i") / size)
    shared = (F.col("i") % size < block - 1) & (piece > 0)
    pieces = t.select(key, "i", "r", F.explode(F.when(shared, F.array(piece, piece - 1)).otherwise(F.array(piece))).alias("piece"))
    pieces = pieces.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("rs"))
    # each drawn block is a row: its log growth, and how high, how low and how far under its own peak it goes
    joined = starts.withColumn("piece", piece).join(pieces, [key, "piece"])
    joined = joined.select(key, "path", "b", F.slice("rs.r", (F.col("i") % size + 1).cast("int"), block).alias("rs"))
    at, ends = F.lit(0.0), []
    for j in range(block):
        step = F.col("b") * block + j
        r = F.col("rs")[j] - F.when(drawn(step, 25) < int(worse_share * 2**32), worse_r).otherwise(0.0)
        joined = joined.withColumn(f"e{j}", F.when(step < horizon, at + F.log(F.greatest(1 + risk * r, F.lit(1e-9)))))
        at = F.col(f"e{j}")
        ends.append(at)
    most = lambda xs, f: f(*xs) if len(xs) > 1 else xs[0]
    dips = [most([ends[i] - ends[j] for j in range(i + 1)], F.least) for i in range(block)]
    walked = joined.select(key, "path", F.struct("b", F.coalesce(*ends[::-1]).alias("sum"), most(ends, F.greatest).alias("top"), most(ends, F.least).alias("bottom"), most(dips, F.least).alias("dip")).alias("x"))
    seen = walked.groupBy(key, "path").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # horizon / block rows
    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("low"))

    def on(state, x):
        low = F.least(state["low"], state["e"] + x["bottom"] - state["peak"], x["dip"])
        return F.struct((state["e"] + x["sum"]).alias("e"), F.greatest(state["peak"], state["e"] + x["top"]).alias("peak"), low.alias("low"))

    low = F.aggregate("xs", zero, on, lambda state: state["low"])
    ruined = seen.groupBy(key).agg(F.avg((low <= F.log(F.lit(1 - limit))).cast("int")).alias("ruin"))
    return trades.select(key).distinct().join(ruined, key, "left").select(key, F.coalesce("ruin", F.lit(1.0)).alias("ruin"))


def water_fill(rows: DataFrame, budget: Column | float, group: list[str]) -> DataFrame:
    """``share``: the budget split by score, none above its cap, in closed form.

    Ordered by cap / score, a row is capped if its ratio is under the level that the rest would get.
    """
    w = Window.partitionBy(*group).orderBy("ratio", "id") if group else Window.orderBy("ratio", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    r = rows.where("score > 0 and cap > 0").withColumn("ratio", F.col("cap") / F.col("score"))
    left = (budget if isinstance(budget, Column) else F.lit(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("score").over(whole) - F.coalesce(F.sum("score").over(before), F.lit(0.0))
    r = r.withColumn("level", left / rest)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)
    return r.withColumn("share", F.least("cap", F.coalesce(found["level"], F.lit(float("inf"))) * F.col("score"))).drop("ratio", "level")


def correlations(returns: DataFrame, key: str = "strategy", least: int = 60) -> DataFrame:
    """(a, b, n, corr) of strategies over shared days on which not both are zero; null below ``least`` days."""
    a = returns.select(F.col(key).alias("a"), "d", F.col("ret").alias("x"))
    b = returns.select(F.col(key).alias("b"), "d", F.col("ret").alias("y"))
    both = a.join(b, "d").where("a < b and not (x = 0 and y = 0)")
    g = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("c"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    return g.select("a", "b", "n", F.when(F.col("n") >= least, F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("corr"))
