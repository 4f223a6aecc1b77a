import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import features, strategy, trades

SCHEMA = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    draw, rows = random.Random(2), []
    t0 = dt.datetime(2024, 1, 1)
    for s in "AB":
        p = 100.0
        for i in range(300):
            o, p = p, p + draw.choice([-1.5, -1, -0.5, 0.5, 1, 1.5])
            rows.append((s, "D1", t0 + dt.timedelta(days=i), o, max(o, p) + 0.5, min(o, p) - 0.5, p, 10.0))
    path = str(tmp_path_factory.mktemp("bars") / "bars")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_features_of_a_timeframe_share_a_sort(bars):
    names = {"a": {"fn": "highest", "period": 5}, "b": {"fn": "zscore", "period": 7}, "c": {"fn": "mom"}, "w": {"fn": "sma", "tf": "W1", "n": 2}, "v": {"fn": "highest", "tf": "W1", "period": 2}}
    d = strategy.compute_features(bars, "D1", names)
    assert d.columns == [*bars.columns, *names]
    assert d._jdf.queryExecution().executedPlan().toString().count("Sort [") == 3  # daily, weekly, alignment


def test_features_use_earlier_ones_and_do_not_look_ahead(bars):
    names = {"top": {"fn": "highest", "period": 5}, "mean": {"fn": "sma", "ref": "top", "n": 3}, "w": {"fn": "ema", "tf": "W1", "timeperiod": 3}, "far": {"fn": "mom", "ref": "w", "n": 1}, "e": {"fn": "ema", "input": "mean", "n": 4}, "up": {"fn": "bbands", "n": 5, "output": "upper"}}
    make = lambda d: {(r["symbol"], r["ts"]): tuple(r[n] for n in names) for r in strategy.compute_features(d, "D1", names).collect()}
    whole, part = make(bars), make(bars.where("ts < '2024-07-03'"))
    assert part and all(whole[k] == v for k, v in part.items()) and all(x is not None for x in whole["A", dt.datetime(2024, 9, 1)])
    sunday, monday = whole["A", dt.datetime(2024, 6, 30)], whole["A", dt.datetime(2024, 6, 29)]
    assert sunday[2] != monday[2]  # the week that ends with Sunday is known when Sunday's bar closes
    with pytest.raises(ValueError, match="takes no parameter"):
        strategy.compute_features(bars, "D1", {"x": {"fn": "ema", "length": 3}})


def test_grid(spark):
    grid = lambda space, **k: [tuple(r) for r in strategy.param_grid(spark, space, **k).orderBy("param_id").collect()]
    assert grid({}) == [(0,)]
    assert grid({"a": [1, 3]}, points=5) == [(0, 1.0), (1, 2.0), (2, 3.0)]  # 1, 1.5, 2, 2.5, 3 to even whole numbers
    assert grid({"a": [0.0, 1.0]}, points=1) == [(0, 0.0)]
    assert grid({"a": [1, 2, 7], "b": ["x", "y"]}) == [(0, 1.0, "x"), (1, 1.0, "y"), (2, 2.0, "x"), (3, 2.0, "y"), (4, 7.0, "x"), (5, 7.0, "y")]
    drawn = grid({"a": [0.0, 1.0], "b": [0.0, 1.0]}, points=10, max_trials=30, seed=4)
    assert len(drawn) == 30 == len(set(drawn)) and drawn == grid({"a": [0.0, 1.0], "b": [0.0, 1.0]}, points=10, max_trials=30, seed=4)
    assert drawn != grid({"a": [0.0, 1.0], "b": [0.0, 1.0]}, points=10, max_trials=30, seed=5)


def test_parameters_override_copies():
    spec = {"exit": {"stop_atr": 2.0}, "features": {"e": {"fn": "ema", "n": 5}}}
    got = strategy.with_params(spec, {"stop_atr": 3.0, "max_bars": 4, "features.e.n": 9, "sizing.risk": 1})
    assert got == {"exit": {"stop_atr": 3.0, "max_bars": 4}, "features": {"e": {"fn": "ema", "n": 9}}, "sizing": {"risk": 1}}
    assert spec["exit"] == {"stop_atr": 2.0} and spec["features"]["e"]["n"] == 5


def test_filters_and_warnings(spark, bars):
    strategy.register_filter("mondays")(lambda d, context: d.where(F.dayofweek("ts") == 2))
    calendar = spark.createDataFrame([("A", dt.date(2024, 3, 10))], "symbol string, d date")
    d, warnings = strategy.signals(bars, F.lit(True), None, F.col("close") > F.lit(None).cast("double"), filters=("mondays", "no_earnings_3d", "no_high_impact_news_30m", "no_high_impact_news_30m"), context={"earnings": calendar})
    assert len(warnings) == 1 and d.where("short_entry or long_exit or short_exit").count() == 0 and d.count() == 600
    days = {r["ts"].date() for r in d.where("long_entry and symbol = 'A'").collect()}
    assert all(x.weekday() == 0 for x in days) and dt.date(2024, 3, 11) in days
    assert not days & {dt.date(2024, 3, 7) + dt.timedelta(days=i) for i in range(4)}
    del strategy.FILTERS["mondays"]


def test_one_window_over_all_equals_the_plain_run(spark, bars):
    d = features.atr(bars).withColumns({"top": features.highest("high", 10), "long_exit": F.lit(False), "short_exit": F.lit(False)})
    grid = strategy.param_grid(spark, {"stop_atr": [1.0, 2.0], "max_bars": [4, 8]}, points=2)
    span = spark.sql("select 0 fold, timestamp '2024-01-01' train_start, timestamp '2026-01-01' train_end, timestamp '2026-01-01' test_start, timestamp '2026-01-02' test_end")
    long = features.gt("close", "top")
    made = strategy.trades_on_windows(d, grid, span, long, F.lit(False), trades.ExitRule(F.col("stop_atr"), 2.0, F.col("max_bars")))
    got = {}
    for r in made.collect():
        got.setdefault(r["param_id"], set()).add((r["symbol"], r["rn"], r["exit_rn"], r["reason"], round(r["net_pnl"], 6)))
    for r in grid.collect():
        s = d.withColumns({"long_entry": long, "short_entry": F.lit(False)})
        want = {(t["symbol"], t["rn"], t["exit_rn"], t["reason"], round(t["net_pnl"], 6)) for t in trades.run(s, trades.ExitRule(r["stop_atr"], 2.0, int(r["max_bars"]))).collect()}
        assert got[r["param_id"]] == want and want


def test_averages_of_one_bar(bars):
    rows = features.atr(features.ema(features.wilder(bars, F.col("close"), 1, "w"), 1, "e"), 1, "a").orderBy("symbol", "ts").limit(4).collect()
    assert [r["e"] for r in rows] == [r["w"] for r in rows] == [r["close"] for r in rows]
    assert rows[0]["a"] is None and math.isclose(rows[1]["a"], max(rows[1]["high"] - rows[1]["low"], abs(rows[1]["high"] - rows[0]["close"]), abs(rows[1]["low"] - rows[0]["close"])))
