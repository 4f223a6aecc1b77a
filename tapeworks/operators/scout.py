"""Daily ranking of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.features import W, full, shift, true_range


def technical_scores(bars: DataFrame, min_dollar_volume: float = 20e6, min_price: float = 5.0) -> DataFrame:
    """(symbol, ts, score, direction) of each bar from 60 bars on, all days in one pass; known for the day after."""
    d = bars.withColumn("tr", true_range()).withColumn("dv", F.col("close") * F.col("volume"))
    d = d.withColumns({
        "rv": F.try_divide(F.col("volume"), full(F.avg, "volume", 20, 1)), "gap": F.try_divide(F.col("open"), shift("close")) - 1,
        "mom": F.try_divide(F.col("close"), shift("close", 20)) - 1, "dollar": full(F.avg, "dv", 20), "atr": full(F.avg, "tr", 14),
        "top": F.max("close").over(W().rowsBetween(-251, 0)), "n": F.count("*").over(W().rowsBetween(Window.unboundedPreceding, 0)),
    })
    d = d.where((F.col("n") >= 60) & (F.col("close") >= min_price) & (F.col("dollar") >= min_dollar_volume))
    z = lambda c, x: F.coalesce(F.when(c, x), F.lit(0.0))
    score = (
        z(F.col("rv") > 1.5, F.least(F.lit(2.0), F.log2("rv"))) + z(F.abs("gap") > 0.02, F.least(F.lit(1.5), 25 * F.abs("gap")))
        + z(F.abs("mom") > 0.1, F.least(F.lit(1.5), 5 * F.abs("mom"))) + z(F.col("close") >= 0.97 * F.col("top"), F.lit(0.5))
        + F.coalesce(F.least(F.lit(1.0), 25 * F.col("atr") / F.col("close")), F.lit(0.0))
    )
    bias = F.when((F.abs("mom") > 0.05) | (F.abs("gap") > 0.02), F.signum(F.col("mom") + F.col("gap"))).otherwise(0.0)
    return d.select("symbol", "ts", score.alias("score"), bias.cast("int").alias("direction"))


def watchlist(scores: DataFrame, always: int = 10, most: int = 20, least: float = 1.0) -> DataFrame:
    """The ranked symbols of each day: the first ten, further ones from a score of 1, twenty at most."""
    w = Window.partitionBy("ts").orderBy(F.col("score").desc(), "symbol")
    r = scores.withColumn("rank", F.row_number().over(w))
    return r.where((F.col("rank") <= always) | ((F.col("rank") <= most) & (F.col("score") >= least)))


def news_scores(days: DataFrame, news: DataFrame) -> DataFrame:
    """(symbol, ts, score, n) for each day's scan at ``ts``: min(3, ln(1 + n)) of the n items of the 24 hours up to it."""
    spans = F.explode(F.array(F.to_date("ts"), F.date_sub(F.to_date("ts"), 1)))
    near = days.select("ts", spans.alias("__d")).join(news.withColumn("__d", F.to_date("published")), "__d")
    got = near.where((F.col("published") <= F.col("ts")) & (F.col("published") >= F.col("ts") - F.expr("interval 24 hours")))
    return got.groupBy("symbol", "ts").agg(F.count("*").alias("n")).withColumn("score", F.least(F.lit(3.0), F.log1p("n")))


# Weights of the sources
WEIGHTS = {"technical": 1.0, "news": 1.0, "chatter": 0.5}


def merged_scores(sources: dict[str, DataFrame], always_on: tuple[str, ...] = ("SPY", "QQQ")) -> DataFrame:
    """(symbol, ts, score, direction, sources): weighted sums over the sources, symbols that are always on left out.

    Where a source has a ``reason``, ``reasons`` holds those that are not empty as "source: reason", in the order of the sources.
    """
    explained = any("reason" in d.columns for d in sources.values())
    of = lambda d, c, default: F.col(c) if c in d.columns else default
    parts = [
        d.select("symbol", "ts", (F.lit(WEIGHTS.get(name, 1.0)) * F.col("score")).alias("score"), of(d, "direction", F.lit(0)).alias("direction"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), of(d, "reason", F.lit(None)).cast("string").alias("reason")).alias("s"))
        for i, (name, d) in enumerate(sources.items())
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    said = F.array_sort(F.collect_list("s"))  # a row for each source
    names = F.array_join(F.transform(said, lambda s: s["name"]), ",")
    reasons = F.transform(F.filter(said, lambda s: F.coalesce(s["reason"], F.lit("")) != ""), lambda s: F.concat(s["name"], F.lit(": "), s["reason"]))
    rows = rows.where(~F.col("symbol").isin(*always_on)) if always_on else rows
    return rows.groupBy("symbol", "ts").agg(F.sum("score").alias("score"), F.signum(F.sum("direction")).cast("int").alias("direction"), names.alias("sources"), *([reasons.alias("reasons")] if explained else []))


def scout_mask(picks: DataFrame, days: DataFrame, symbols: DataFrame, hold: int = 1) -> DataFrame:
    """(symbol, ts, tradable) for each scan day and symbol: picked on that day or one of the ``hold`` - 1 scan days before."""
    numbered = days.select("ts").distinct().withColumn("__i", F.row_number().over(Window.orderBy("ts")))
    on = picks.select("symbol", "ts").distinct().join(numbered, "ts").select("symbol", F.explode(F.sequence("__i", F.col("__i") + hold - 1)).alias("__i")).distinct().withColumn("__on", F.lit(True))
    grid = numbered.crossJoin(symbols.select("symbol").distinct())  # the result itself: a row for each scan day and symbol
    return grid.join(on, ["symbol", "__i"], "left").select("symbol", "ts", F.coalesce("__on", F.lit(False)).alias("tradable"))
