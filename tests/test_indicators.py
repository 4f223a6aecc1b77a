import datetime as dt
import math
import random

import numpy as np

from tapeworks.operators import strategy

SCHEMA = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"


def frame(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("A", "D1", t0 + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def test_flat_and_short_series_give_zeros_and_nulls(spark):
    names = {"correl": {"fn": "correl", "n": 5}, "beta": {"fn": "beta"}, "cci": {"fn": "cci", "n": 5}, "mfi": {"fn": "mfi", "n": 5}, "slowd": {"fn": "stoch", "output": "slowd"}, "cmo": {"fn": "cmo", "n": 5}, "u": {"fn": "ultosc", "a": 2, "b": 3, "c": 4}, "s": {"fn": "linearreg_slope", "n": 5}, "t3": {"fn": "t3", "n": 2}}
    flat = strategy.compute_features(frame(spark, [(5, 5, 5, 5, 0)] * 20), "D1", names).orderBy("ts").collect()
    assert [flat[-1][n] for n in names] == [0.0] * 8 + [flat[-1]["t3"]] and math.isclose(flat[-1]["t3"], 5.0)
    short = strategy.compute_features(frame(spark, [(5, 6, 4, 5, 1)] * 2), "D1", names).collect()
    assert all(r[n] is None for r in short for n in names)


def test_aroon_takes_the_latest_of_equal_extremes(spark):
    highs, lows = [9, 7, 9, 6, 5], [2, 3, 1, 1, 4]
    rows = [(5, h, low, 5, 1) for h, low in zip(highs, lows)]
    got = strategy.compute_features(frame(spark, rows), "D1", {"up": {"fn": "aroon", "n": 4, "output": "up"}, "down": {"fn": "aroon", "n": 4, "output": "down"}}).orderBy("ts").collect()
    assert (got[-1]["up"], got[-1]["down"]) == (50.0, 75.0) and got[-2]["up"] is None


def test_against_numpy(spark):
    draw = random.Random(1)
    rows = []
    for _ in range(90):
        c = 100 + draw.gauss(0, 3)
        rows.append((c, c + draw.random(), c - draw.random(), c + draw.gauss(0, 0.3), draw.randint(1, 50)))
    names = {"reg": {"fn": "linearreg", "n": 9}, "ahead": {"fn": "tsf", "n": 9}, "cci": {"fn": "cci", "n": 7}, "obv": {"fn": "obv"}, "e3": {"fn": "tema", "n": 4}}
    got = strategy.compute_features(frame(spark, rows), "D1", names).orderBy("ts").collect()
    close, volume = np.array([r[3] for r in rows]), np.array([float(r[4]) for r in rows])
    tp = np.array([(r[1] + r[2] + r[3]) / 3 for r in rows])

    def ema(x, n):
        out, first = [None] * len(x), next(i for i, v in enumerate(x) if v is not None)
        out[first + n - 1] = sum(x[first : first + n]) / n
        for i in range(first + n, len(x)):
            out[i] = out[i - 1] + (x[i] - out[i - 1]) * 2 / (n + 1)
        return out

    e1 = ema(list(close), 4)
    e2 = ema(e1, 4)
    e3 = ema(e2, 4)
    for i in range(20, 90):
        m, b = np.polyfit(np.arange(9), close[i - 8 : i + 1], 1)
        assert math.isclose(got[i]["reg"], b + 8 * m, rel_tol=1e-9) and math.isclose(got[i]["ahead"], b + 9 * m, rel_tol=1e-9)
        w = tp[i - 6 : i + 1]
        assert math.isclose(got[i]["cci"], (w[-1] - w.mean()) / (0.015 * np.abs(w - w.mean()).mean()), rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(got[i]["obv"], volume[0] + (np.sign(np.diff(close[: i + 1])) * volume[1 : i + 1]).sum(), abs_tol=1e-6)
        assert math.isclose(got[i]["e3"], 3 * e1[i] - 3 * e2[i] + e3[i], rel_tol=1e-9)
