import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tapeworks.operators import features, pivots
from tapeworks.operators.regime import classify_regime, rolling_rank

SCHEMA = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="A", width=0.5):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(symbol, "D1", t0 + dt.timedelta(days=i), c, c + width, c - width, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def line(*points):
    """Closes that run from point to point in steps of one."""
    out = [points[0]]
    for p in points[1:]:
        while out[-1] != p:
            out.append(out[-1] + (1 if p > out[-1] else -1))
    return [float(x) for x in out]


def test_blocks_do_not_change_pivots(spark, monkeypatch):
    draw = random.Random(7)
    closes = [100.0]
    for _ in range(300):
        closes.append(closes[-1] + draw.choice([-2, -1, -0.5, 0.5, 1, 2]))
    df = bars(spark, closes).unionByName(bars(spark, closes[::-1], "B")).unionByName(bars(spark, closes[:10], "C"))
    whole = sorted(map(tuple, pivots.zigzag_pivots(df).collect()))
    kinds = [r[5] for r in whole if r[0] == "A"]
    assert len(kinds) > 10 and all(a != b for a, b in zip(kinds, kinds[1:])) and not any(r[0] == "C" for r in whole)
    for size in (1, 7, 50):
        monkeypatch.setattr(pivots, "BLOCK", size)
        assert sorted(map(tuple, pivots.zigzag_pivots(df).collect())) == whole


def fired(spark, closes, **kw):
    rows = pivots.double_top_bottom(bars(spark, closes), **kw).where("double <> 0").orderBy("rn").collect()
    return [(r["rn"] - 1, r["double"]) for r in rows]


def test_planted_double_bottom_and_top(spark):
    start = [120.0] * 20
    bottom = start + line(120, 100, 110, 100, 116)[1:]
    (at, side), = fired(spark, bottom)
    assert side == 1 and bottom[at] > 110.5 >= bottom[at - 1]  # the neckline is the high of the bar at 110
    top = [240 - x for x in bottom]
    assert fired(spark, top) == [(at, -1)]
    broken = start + line(120, 100, 110, 100, 104, 98, 116)[1:]  # closes below the bottoms before it crosses the neckline
    assert all(broken[i] > 116 or side != 1 for i, side in fired(spark, broken))
    apart = start + line(120, 100, 110, 95, 116)[1:]  # bottoms too far from each other
    assert fired(spark, apart) == []
    assert fired(spark, bottom, max_bars=5) == []  # pivots too many bars apart


def test_levels_are_known_from_their_confirmation(spark):
    df = bars(spark, [120.0] * 20 + line(120, 100, 110, 100, 116)[1:])
    numbered = df.withColumn("rn", F.row_number().over(features.W()).cast("long"))
    found = pivots.zigzag_pivots(df)
    got = {r["rn"]: (r["level"], r["older"]) for r in pivots.pivot_levels(pivots.pivot_levels(numbered, found, -1), found, -1, 1, "older").collect()}
    lows = sorted((r["confirmed_rn"], r["price"]) for r in found.where("kind = -1").collect())
    for rn, levels in got.items():
        known = [None, None] + [p for c, p in lows if c <= rn]
        assert levels == (known[-1], known[-2])
    assert pivots.zigzag_pivots(df.where("false")).count() == 0


def test_rank_equals_pandas_and_short_series_are_unknown(spark):
    draw = random.Random(3)
    values = [None if draw.random() < 0.1 else float(draw.randint(1, 9)) for _ in range(200)]
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", "D1", t0 + dt.timedelta(days=i), v) for i, v in enumerate(values)], "symbol string, tf string, ts timestamp, x double")
    got = [r["p"] for r in df.select("ts", rolling_rank("x", 30, 10).alias("p")).orderBy("ts").collect()]
    want = pd.Series(values, dtype=float).rolling(30, min_periods=10).rank(pct=True)
    assert all((g is None and w != w) or abs(g - w) < 1e-12 for g, w in zip(got, want))
    labels = {r["label"] for r in classify_regime(bars(spark, [100.0 + i for i in range(50)])).collect()}
    assert labels == {"unknown/unknown"}
