"""Walk-forward selection of parameters, and the evidence that funds a strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.align import asof
from tapeworks.operators.metrics import expected_max_sharpe, probabilistic_sharpe, sharpe_of, trade_stats, water_fill

YEAR = 252.0


def folds(timeline: DataFrame, n_folds: int = 5, train_share: float = 0.4, embargo: str = "11 days", anchored: bool = True) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end), half-open, over the distinct times of ``timeline`` (ts).

    The first ``train_share`` of the times only trains; the rest is cut in equal parts. Training ends
    ``embargo`` before the test. Folds of fewer than two times, or without a training span, go. The
    timeline is numbered as one list: it holds one row for each distinct bar time.
    """
    t = timeline.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    size = t.agg(F.count("*").alias("n"), F.max("ts").alias("last")).withColumn("first", F.floor(F.col("n") * train_share))
    k = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    edge = lambda x: F.floor(F.col("first") + (F.col("n") - F.col("first")) * x / n_folds)
    cuts = size.withColumn("fold", k).withColumn("a", edge(F.col("fold"))).withColumn("b", edge(F.col("fold") + 1)).where("b - a >= 2")
    cuts = cuts.withColumn("start_i", F.lit(0) if anchored else F.greatest(F.lit(0), F.col("a") - F.col("first")))
    at = lambda i, name: t.select(F.col("i").alias(i), F.col("ts").alias(name))
    got = cuts.join(at("a", "test_start"), "a").join(at("b", "__end"), "b", "left").join(at("start_i", "train_start"), "start_i")
    end = F.coalesce("__end", F.col("last") + F.expr("interval 1 second"))
    got = got.select("fold", "train_start", (F.col("test_start") - F.expr(f"interval {embargo}")).alias("train_end"), "test_start", end.alias("test_end"))
    return got.where("train_end > train_start")


def train_scores(returns: DataFrame, trades: DataFrame, spans: DataFrame) -> DataFrame:
    """(strategy, param, fold, sharpe per period, n_trades) on each fold's training span; all in one job.

    ``returns`` (strategy, param, d, ret) and ``trades`` (strategy, param, d, ...) meet the few folds by a range join.
    """
    few = F.broadcast(spans)  # one row for each fold
    inside = F.expr("d >= train_start and d < train_end")
    s = returns.join(few, inside).groupBy("strategy", "param", "fold").agg(sharpe_of(F.col("ret"), 1.0).alias("sharpe"))
    n = trades.join(few, inside).groupBy("strategy", "param", "fold").agg(F.count("*").alias("n_trades"))
    return s.join(n, ["strategy", "param", "fold"], "left").fillna(0, ["n_trades"])


def best_params(scores: DataFrame, min_trades: int = 10) -> DataFrame:
    """The best parameter set of each strategy and fold: with enough trades first, then by Sharpe, then the smaller id."""
    w = Window.partitionBy("strategy", "fold").orderBy((F.col("n_trades") >= min_trades).desc(), F.col("sharpe").desc(), "param")
    return scores.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _tested(rows: DataFrame, best: DataFrame, spans: DataFrame) -> DataFrame:
    chosen = best.select("strategy", "param", "fold").join(F.broadcast(spans), "fold")
    return rows.join(chosen, ["strategy", "param"]).where("d >= test_start and d < test_end").drop("train_start", "train_end", "test_start", "test_end")


def stitched_returns(returns: DataFrame, best: DataFrame, spans: DataFrame) -> DataFrame:
    """Out-of-sample returns (strategy, fold, d, ret) of the chosen sets; of a repeated day the first fold's stays."""
    w = Window.partitionBy("strategy", "d").orderBy("fold")
    got = _tested(returns, best, spans).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return got.select("strategy", "fold", "d", "ret")


def tested_trades(trades: DataFrame, best: DataFrame, spans: DataFrame) -> DataFrame:
    """Out-of-sample trades of the chosen sets, with their fold."""
    return _tested(trades, best, spans)


def evidence(scores: DataFrame, best: DataFrame, oos: DataFrame, oos_trades: DataFrame) -> DataFrame:
    """Per strategy: out-of-sample Sharpe, drawdown, deflated Sharpe, positive folds, profit factor, parameter stability and choice."""
    per_fold = scores.groupBy("strategy", "fold").agg(F.var_samp("sharpe").alias("v"))
    trials = scores.groupBy("strategy").agg(F.count_distinct("param").cast("double").alias("n_trials"))
    variance = per_fold.groupBy("strategy").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("variance"))
    w = Window.partitionBy("strategy").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    curve = oos.withColumn("e", F.sum(F.log1p("ret")).over(w)).withColumn("dd", F.exp(F.col("e") - F.greatest(F.max("e").over(w), F.lit(0.0))) - 1)
    r = F.col("ret")
    s = curve.groupBy("strategy").agg(
        F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"),
        sharpe_of(r).alias("sharpe"), F.min("dd").alias("max_drawdown"),
    )
    gained = oos.groupBy("strategy", "fold").agg((F.sum(F.log1p("ret")) > 0).cast("double").alias("up")).groupBy("strategy").agg(F.avg("up").alias("positive_folds"))
    picks = best.groupBy("strategy", "param").agg(F.count("*").alias("k"))
    stable = picks.groupBy("strategy").agg((F.max("k") / F.sum("k")).alias("stability"), F.max_by("param", F.struct("k", -F.col("param"))).alias("recommended"))
    t = trade_stats(oos_trades).select("strategy", "n_trades", "profit_factor")
    out = s.join(trials, "strategy").join(variance, "strategy").join(gained, "strategy").join(stable, "strategy").join(t, "strategy", "left")
    args = [F.col(c) for c in ("n", "m", "sd", "g1", "g2")]
    top = expected_max_sharpe(F.col("n_trials"), F.col("variance"))
    return out.select(
        "strategy", "sharpe", "max_drawdown", probabilistic_sharpe(*args, top).alias("dsr"), (top * F.sqrt(F.lit(YEAR))).alias("expected_max"),
        "positive_folds", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), F.coalesce("profit_factor", F.lit(0.0)).alias("profit_factor"), "stability", "recommended",
    )


def promotion_gate(found: DataFrame, trades: int = 100, factor: float = 1.2, dsr: float = 0.95, drawdown: float = -0.5, share: float = 0.5) -> DataFrame:
    """``status`` validated or rejected and the ``reasons``, in the order of the tests."""
    reasons = F.array_compact(F.array(
        F.when(F.col("n_trades") < trades, F.lit("few trades")), F.when(F.col("profit_factor") < factor, F.lit("profit factor")), F.when(F.col("dsr") < dsr, F.lit("deflated Sharpe")),
        F.when(F.col("max_drawdown") < drawdown, F.lit("drawdown")), F.when(F.col("positive_folds") < share, F.lit("few positive folds")),
    ))
    return found.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("status", F.when(F.size(reasons) == 0, "validated").otherwise("rejected"))


def recent_sharpe(returns: DataFrame, halflife: int = 60, least: int = 20) -> DataFrame:
    """(strategy, recent): Sharpe under weights that halve every ``halflife`` days back; 0 below ``least`` days."""
    age = F.row_number().over(Window.partitionBy("strategy").orderBy(F.col("d").desc())) - 1
    x = returns.where("ret is not null").withColumn("w", F.pow(F.lit(0.5), age / halflife))
    mean = x.groupBy("strategy").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("m"))
    y = x.join(mean, "strategy").groupBy("strategy").agg(
        F.first("m").alias("m"), F.count("*").alias("n"), F.sqrt(F.sum(F.col("w") * F.pow(F.col("ret") - F.col("m"), 2)) / F.sum("w")).alias("sd")
    )
    return y.select("strategy", F.when((F.col("n") >= least) & (F.col("sd") > 0), F.col("m") / F.col("sd") * F.sqrt(F.lit(YEAR))).otherwise(0.0).alias("recent"))


def regime_fit(returns: DataFrame, labels: DataFrame, current: str, shrink: int = 120) -> DataFrame:
    """(strategy, fit): Sharpe on days of the current regime, drawn to the overall one when such days are few (under 5: that one)."""
    days = returns.where("ret is not null").join(_spread(labels, returns), "d", "left")
    here = F.when(F.col("label") == current, F.col("ret"))
    g = days.groupBy("strategy").agg(sharpe_of(F.col("ret")).alias("overall"), sharpe_of(here).alias("own"), F.count(here).alias("k"))
    w = F.col("k") / (F.col("k") + F.lit(float(shrink)))
    return g.select("strategy", F.when(F.col("k") < 5, F.col("overall")).otherwise(w * F.col("own") + (1 - w) * F.col("overall")).alias("fit"))


def _spread(labels: DataFrame, returns: DataFrame) -> DataFrame:
    """The label valid on each day of ``returns``: that of the day, else the last one before."""
    days = returns.select("d").distinct().withColumn("__g", F.lit(1))
    got = asof(days, labels.select(F.lit(1).alias("__g"), F.col("d").alias("__d"), "label"), ["__g"], "d", "__d", ["label"], "x")
    return got.select("d", F.col("x.label").alias("label"))


def allocate(book: DataFrame, total: Column | float = 12.0, cluster_cap: float = 6.0, cap: float = 3.0, promoted_cap: float = 5.0) -> DataFrame:
    """``book`` (strategy, status, recent, dsr, fit, kelly_pct, cap_pct, cluster) with score, cap, ``risk_pct`` and why it is left out.

    Score 0.4 recent + 0.3 (4 dsr - 2) + 0.3 fit; the cap is the least of the status cap and the Kelly risk.
    ``total`` is split among clusters by their best score, none over the cluster cap or its members'
    caps together, and then within each cluster by score.
    """
    status = F.when(F.col("status").isin("paper", "live"), promoted_cap).otherwise(F.least(F.lit(cap), F.col("cap_pct")))
    b = book.withColumn("score", 0.4 * F.col("recent") + 0.3 * (4 * F.col("dsr") - 2) + 0.3 * F.col("fit")).withColumn("cap", F.least(status, F.col("kelly_pct")))
    good = (F.col("score") > 0) & (F.col("cap") > 0)
    groups = b.groupBy("cluster").agg(F.max(F.greatest("score", F.lit(0.0))).alias("score"), F.least(F.lit(cluster_cap), F.sum(F.when(F.col("score") > 0, F.col("cap")))).alias("cap"))
    shares = water_fill(groups.withColumn("id", F.col("cluster")).withColumn("__one", F.lit(1)), total, ["__one"]).select("cluster", F.col("share").alias("budget"))
    rows = b.join(shares, "cluster", "left").withColumn("id", F.col("strategy"))
    split = water_fill(rows, F.coalesce("budget", F.lit(0.0)), ["cluster"]).select("strategy", F.col("share").alias("risk_pct"))
    left = F.when(F.col("score") <= 0, "score not positive").when(F.col("cap") <= 0, "no edge to size")
    return b.join(split, "strategy", "left").withColumn("risk_pct", F.coalesce(F.when(good, F.col("risk_pct")), F.lit(0.0))).withColumn("excluded", left)


def blended(returns: DataFrame, risks: DataFrame, reference: float = 1.0) -> DataFrame:
    """(d, ret) of the book: each strategy's returns scaled from the reference to its own risk, summed by day."""
    live = returns.join(risks.where("risk_pct > 0"), "strategy")
    return live.groupBy("d").agg(F.sum(F.col("ret") * F.col("risk_pct") / reference).alias("ret"))


def blend_report(returns: DataFrame, risks: DataFrame, reference: float = 1.0) -> DataFrame:
    """(strategy, sharpe, max_drawdown, total_return) of the blend and of each strategy alone at its risk."""
    alone = returns.join(risks, "strategy").select("strategy", "d", (F.col("ret") * F.col("risk_pct") / reference).alias("ret"))
    both = alone.unionByName(blended(returns, risks, reference).select(F.lit("blend").alias("strategy"), "d", "ret"))
    w = Window.partitionBy("strategy").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    curve = both.withColumn("e", F.sum(F.log1p("ret")).over(w)).withColumn("dd", F.exp(F.col("e") - F.max("e").over(w)) - 1)
    return curve.groupBy("strategy").agg(sharpe_of(F.col("ret")).alias("sharpe"), F.min("dd").alias("max_drawdown"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total_return"))
