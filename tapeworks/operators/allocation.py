"""Risk split over strategies, and the plan of each day that follows from ranking, regime and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.align import asof
from tapeworks.operators.components import connected_components
from tapeworks.operators.metrics import correlations, drawdown_scale, water_fill
from tapeworks.operators.selection import YEAR, _spread

# Statuses that may hold risk in each mode.
ELIGIBLE = {"research": ("validated", "paper", "live"), "paper": ("validated", "paper", "live"), "live": ("live",)}


def cluster_links(returns: DataFrame, records: DataFrame, threshold: float = 0.6, least: int = 60) -> DataFrame:
    """(a, b) of strategies that count as one bet.

    Their returns correlate at the threshold or above; or they share too few days to tell, are of one asset class and
    trade a common symbol. ``records``: strategy, asset_class, symbols (an array). Pairs of the second kind meet on (class, symbol).
    """
    measured = correlations(returns.where("ret is not null"), least=least)
    known = measured.where("n >= %d" % least)
    each = records.select("strategy", "asset_class", F.explode(F.array_distinct("symbols")).alias("symbol"))
    a, b = (each.withColumnRenamed("strategy", c) for c in ("a", "b"))
    alike = a.join(b, ["asset_class", "symbol"]).where("a < b").select("a", "b").distinct().join(known, ["a", "b"], "left_anti")
    return known.where(F.col("corr") >= threshold).select("a", "b").unionByName(alike)


def clusters(returns: DataFrame, records: DataFrame, threshold: float = 0.6, least: int = 60) -> DataFrame:
    """(strategy, cluster): the smallest strategy that links lead to."""
    found = connected_components(cluster_links(returns, records, threshold, least))
    return records.select("strategy").join(found, F.col("strategy") == F.col("node"), "left").select("strategy", F.coalesce("component", "strategy").alias("cluster"))


def allocate(book: DataFrame, keys: tuple[str, ...] = (), total: float = 12.0, mode: str = "paper", cap: float = 3.0, promoted_cap: float = 5.0, cluster_cap: float = 6.0) -> DataFrame:
    """``book`` with score, cap, multiplier, risk_pct, notes (an array) and excluded (why, or null), for each of ``keys`` apart.

    Columns: strategy, status, recent, dsr, fit, kelly_pct, cap_pct, cluster, equity and peak (null: at the peak).
    A status that the mode does not admit is left out before anything is split. Score is 0.4 recent + 0.3 (4 dsr - 2)
    + 0.3 fit; the cap is the status cap (for one not yet promoted at most cap_pct), at most the Kelly risk. The total, less for a
    drawdown, is split among clusters by their best score, none over the cluster cap or its members' caps together, then within each by score.
    """
    at = [*keys] or ["__all"]
    book = book if keys else book.withColumn("__all", F.lit(1))
    down = F.when(F.col("equity").isNotNull() & (F.col("peak") > 0), F.greatest(F.lit(0.0), 1 - F.col("equity") / F.col("peak"))).otherwise(0.0)
    promoted = F.col("status").isin("paper", "live")
    b = book.withColumns({
        "multiplier": drawdown_scale(down), "score": 0.4 * F.col("recent") + 0.3 * (4 * F.col("dsr") - 2) + 0.3 * F.col("fit"),
        "cap": F.least(F.when(promoted, promoted_cap).otherwise(F.least(F.lit(cap), F.col("cap_pct"))), F.col("kelly_pct")),
    })
    admitted = F.col("status").isin(*ELIGIBLE[mode])
    live = b.where(admitted).withColumn("score", F.greatest("score", F.lit(0.0)))
    groups = live.groupBy(*at, "cluster").agg(
        F.max("score").alias("score"), F.least(F.lit(cluster_cap), F.coalesce(F.sum(F.when(F.col("score") > 0, F.col("cap"))), F.lit(0.0))).alias("cap"),
        F.max("multiplier").alias("m"), F.count("*").alias("members"),
    )
    budgets = water_fill(groups.withColumn("id", F.col("cluster")), F.lit(total) * F.col("m"), at).select(*at, "cluster", F.col("share").alias("budget"))
    rows = live.join(budgets, [*at, "cluster"]).withColumn("id", F.col("strategy"))
    risk = water_fill(rows, F.col("budget"), [*at, "cluster"]).select(*at, "strategy", F.round("share", 4).alias("risk_pct"))
    d = b.join(risk, [*at, "strategy"], "left").join(groups.select(*at, "cluster", "members"), [*at, "cluster"], "left").withColumn("risk_pct", F.coalesce("risk_pct", F.lit(0.0)))
    excluded = (
        F.when(~admitted, F.format_string("status %s not eligible in %s mode", "status", F.lit(mode)))
        .when(F.col("score") <= 0, "score not positive").when(F.col("cap") <= 0, "no edge to size")
    )
    notes = F.array_compact(F.array(
        F.when((F.col("risk_pct") > 0) & (F.col("risk_pct") >= F.round("cap", 4) - 1e-9), F.format_string("at cap %.2f%%", "cap")),
        F.when(F.col("members") > 1, F.format_string("shares cluster %s with %d more", F.col("cluster"), F.col("members") - 1)),
        F.when(F.col("multiplier") < 1, F.format_string("budget x%.2f for drawdown", "multiplier")),
    ))
    return d.withColumn("excluded", excluded).withColumn("notes", F.when(admitted, notes).otherwise(F.array().cast("array<string>"))).drop("members", "__all")


def labels_before(labels: DataFrame, days: DataFrame) -> DataFrame:
    """(asof, label): the last label (ts, label) strictly before each day's ``asof``; unknown without one."""
    one = F.lit(1).alias("__g")
    got = asof(days.select("asof", one, (F.col("asof") - F.expr("interval 1 microsecond")).alias("__at")), labels.select(one, "ts", "label"), ["__g"], "__at", "ts", ["label"], "x")
    return got.select("asof", F.coalesce("x.label", F.lit("unknown")).alias("label"))


def fits(returns: DataFrame, labels: DataFrame, days: DataFrame, shrink: int = 120) -> DataFrame:
    """(strategy, asof, fit): Sharpe under the regime of each ``asof`` (asof, label), drawn to the overall one where such days are few (under 5: that one).

    Labels (d, label) after an asof are not known yet: every later day counts under its label. All days are answered from running
    sums, of each strategy and label and of each strategy, so the returns are read once however many days are planned.
    """
    r = returns.where("ret is not null").select("strategy", F.col("d").cast("timestamp").alias("d"), "ret")
    r = r.join(_spread(labels.select(F.col("d").cast("timestamp").alias("d"), "label"), r), "d").withColumn("label", F.coalesce("label", F.lit("")))
    sums = lambda rows, w: [F.sum(x).over(w).alias(c) for c, x in (("n", F.lit(1)), ("s", F.col("ret")), ("q", F.col("ret") * F.col("ret")))]
    run = lambda *by: Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    own, whole = r.select("strategy", "label", "d", *sums(r, run("strategy", "label"))), r.select("strategy", "d", *sums(r, run("strategy")))
    total = r.groupBy("strategy").agg(F.count("*").alias("tn"), F.sum("ret").alias("ts"), F.sum(F.col("ret") * F.col("ret")).alias("tq"))
    rows = total.crossJoin(days.select("asof", "label", (F.col("asof") - F.expr("interval 1 microsecond")).alias("__at")))  # as many rows as the result
    rows = asof(rows, own, ["strategy", "label"], "__at", "d", ["n", "s", "q"], "o")
    rows = asof(rows, whole, ["strategy"], "__at", "d", ["n", "s", "q"], "w")
    z = lambda c: F.coalesce(c, F.lit(0))
    n, s, q = (z(f"o.{c}") + F.col(f"t{c}") - z(f"w.{c}") for c in "nsq")

    def sharpe(n: Column, s: Column, q: Column) -> Column:
        var = F.when(n > 1, (q - s * s / n) / F.when(n > 1, n - 1))
        return F.when(var > 1e-18, s / n / F.sqrt(F.when(var > 1e-18, var)) * F.sqrt(F.lit(YEAR))).otherwise(0.0)

    overall, here, w = sharpe(F.col("tn"), F.col("ts"), F.col("tq")), sharpe(n, s, q), n / (n + F.lit(float(shrink)))
    return rows.select("strategy", "asof", F.when(n < 5, overall).otherwise(w * here + (1 - w) * overall).alias("fit"))


def daily_plan(days: DataFrame, records: DataFrame, evidence: DataFrame, returns: DataFrame, regime: DataFrame, ranking: DataFrame, daily: DataFrame, **limits) -> DataFrame:
    """(asof, regime, strategy, cluster, score, risk_pct, notes, excluded, universe) for every day of ``days`` (asof) and every strategy, in one job.

    ``regime`` (ts, label) and ``daily`` (d, label) are one market's labels, ``ranking`` (ts, symbol, rank) the watchlists: a day
    sees only what is strictly before it. ``records``: strategy, asset_class, status, symbols, uses_watchlist, cap_pct;
    ``evidence``: strategy, recent, dsr, kelly_pct, cluster, equity, peak. A funded strategy trades its own symbols, then those
    of the day's list that it has not; one without risk trades none.
    """
    known = labels_before(regime, days)
    fit = fits(returns, daily, known)
    split = allocate(records.join(evidence, "strategy").join(fit, "strategy"), ("asof",), **limits)
    lists = ranking.groupBy("ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("list"))  # a watchlist is short by its own limit
    one = F.lit(1).alias("__g")
    seen = asof(days.select("asof", one, (F.col("asof") - F.expr("interval 1 microsecond")).alias("__at")), lists.select(one, "ts", "list"), ["__g"], "__at", "ts", ["list"], "x").select("asof", F.coalesce("x.list", F.array().cast("array<string>")).alias("list"))
    d = split.join(known.withColumnRenamed("label", "regime"), "asof").join(seen, "asof")
    universe = F.concat("symbols", F.when(F.col("uses_watchlist"), F.array_except("list", "symbols")).otherwise(F.array().cast("array<string>")))
    return d.select("asof", "regime", "strategy", "cluster", "score", "risk_pct", "notes", "excluded", F.when(F.col("risk_pct") > 0, universe).otherwise(F.array().cast("array<string>")).alias("universe"))
