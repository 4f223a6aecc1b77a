import datetime as dt
import hashlib
import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tapeworks.functions import state
from tapeworks.functions.normal import normal_cdf, normal_inverse
from tapeworks.operators import components, costs, features, metrics, trades
from tapeworks.operators.components import connected_components


def test_rollover_days(spark):
    cases = [  # New York times; winter, so five hours behind UTC
        ("2026-01-05 12:00", "2026-01-05 16:59", 0), ("2026-01-05 12:00", "2026-01-05 17:00", 1), ("2026-01-05 17:00", "2026-01-06 16:00", 0),
        ("2026-01-09 12:00", "2026-01-12 12:00", 3), ("2026-01-05 12:00", "2026-01-09 18:00", 7), ("2026-01-10 12:00", "2026-01-11 20:00", 0),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    utc = lambda c: F.to_utc_timestamp(F.to_timestamp(c), "America/New_York")
    assert all(r["got"] == r["want"] for r in df.select("want", costs.rollover_days(utc("a"), utc("b")).alias("got")).collect())


def test_normal(spark):
    xs = [x / 4 for x in range(-30, 31)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p"))
    for r in df.withColumn("back", normal_inverse(F.col("p"))).collect():
        assert math.isclose(r["p"], NormalDist().cdf(r["x"]), rel_tol=1e-9, abs_tol=1e-15)
        if abs(r["x"]) < 5:
            assert math.isclose(r["back"], r["x"], abs_tol=1e-8)


def test_normal_tails(spark):
    from tapeworks.functions.normal import normal_inverse_log, normal_log_cdf, normal_round_trip

    xs = [s * x for x in (0.0, 0.003, 0.5, 1.97, 1.98, 5.5, 7.07, 7.08, 8.3, 10.02, 36.9, 37.1, 39.0, 120.0, 1000.0) for s in (1, -1)] + [float("nan")]
    d = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = d.select("x", normal_log_cdf(F.col("x")).alias("p"), normal_round_trip(F.col("x")).alias("back"), normal_inverse_log(F.col("x")).alias("q")).collect()
    for r in got[:-2]:
        assert math.isclose(r["back"], r["x"], rel_tol=1e-11, abs_tol=1e-12)
        if abs(r["x"]) < 37:
            assert math.isclose(r["p"], math.log(math.erfc(-r["x"] / math.sqrt(2)) / 2), rel_tol=1e-7, abs_tol=1e-15)
        assert (r["q"] is None) == (r["x"] >= 0)
    assert got[-1]["back"] is None and got[-1]["q"] is None


def test_features_do_not_look_ahead(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", "D1", t0 + dt.timedelta(days=i), p, p + 1, p - 1, p + math.sin(i), 10.0 + i) for i in range(90) for p in [100 + 5 * math.sin(i / 7)]]
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double")
    make = lambda d: features.rsi(features.atr(features.ema(d, 10, "ema")), 5, "rsi").withColumn("hi", features.highest())
    whole = {r["ts"]: r for r in make(df).collect()}
    for r in make(df.where(F.col("ts") < t0 + dt.timedelta(days=60))).collect():
        assert all(r[c] == whole[r["ts"]][c] for c in ("ema", "atr", "rsi", "hi"))
    closes = [r[6] for r in rows]
    y = sum(closes[:10]) / 10
    for i in range(10, 90):
        y = y * 9 / 11 + closes[i] * 2 / 11
        assert math.isclose(whole[rows[i][2]]["ema"], y, rel_tol=1e-12)


def test_stop_before_target_and_gap(spark):
    t0 = dt.datetime(2024, 1, 1)
    flat = [("A", "D1", t0 + dt.timedelta(days=i), 100.0, 101.0, 99.0, 100.0, 2.0, i == 2, False, False, False) for i in range(12)]
    both = list(flat)
    both[5] = (*flat[5][:3], 100.0, 140.0, 60.0, 100.0, *flat[5][7:])
    gap = list(flat)
    gap[5] = (*flat[5][:3], 80.0, 81.0, 79.0, 80.0, *flat[5][7:])
    schema = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, atr double, long_entry boolean, short_entry boolean, long_exit boolean, short_exit boolean"
    rule = trades.ExitRule(2.0, 2.0, 6, cost_bps=0.0)
    got = [trades.run(spark.createDataFrame(x, schema), rule).first() for x in (both, gap, flat)]
    assert [(r["reason"], r["exit"], r["exit_rn"]) for r in got] == [("stop", 96.0, 6), ("stop_gap", 80.0, 6), ("time", 100.0, 10)]
    asked = [(*r[:10], i == 8, False) for i, r in enumerate(flat)]  # an exit signal for the open that also takes the time limit
    assert trades.run(spark.createDataFrame(asked, schema), rule).first()["reason"] == "time"


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100


def test_settled_components_run_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "checkpoint", lambda df: written.append(1) or state.checkpoint(df))
    e = spark.createDataFrame([(9, i) for i in range(10, 60)] + [(3, 4), (4, 3)], "a long, b long")
    found = connected_components(e)
    assert {tuple(r) for r in found.collect()} == {(i, 9) for i in range(9, 60)} | {(3, 3), (4, 3)}
    assert len(written) == 1  # the edges alone; each round costs stages of all shuffle partitions
    more = spark.createDataFrame([(60, 4), (3, 70)], "a long, b long").union(found)  # what was found, fed again with further edges
    assert {tuple(r) for r in connected_components(more).collect()} == {(i, 9) for i in range(9, 60)} | {(3, 3), (4, 3), (60, 3), (70, 3)}


def test_ruin_takes_worse_fills(spark):
    rs = [(-1.0 if k % 3 else 1.6) for k in range(30)]
    df = spark.createDataFrame([("s", k, r) for k, r in enumerate(rs)] + [("t", 0, 1.0)], "strategy string, trade_id int, r_multiple double")
    bits = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    paths, horizon, ruined, worse = 60, 63, 0, 0
    for p in range(paths):
        level = peak = 1.0
        low = False
        for step in range(horizon):
            b, j = divmod(step, 5)
            r = rs[int(bits("s", p, b)[:8], 16) % (len(rs) - 4) + j]
            bad = int(bits("s", p, step)[24:], 16) < int(0.15 * 2**32)
            level *= 1 + 0.02 * ((1.3 * r if r < 0 else r) - 0.05 - (0.1 if bad else 0.0))
            peak, worse = max(peak, level), worse + bad
            low = low or level <= 0.75 * peak
        ruined += low
    got = {r["strategy"]: r["ruin"] for r in metrics.bootstrap_ruin(df, paths=paths, horizon=horizon, limit=0.25).collect()}
    assert 0.1 < worse / (paths * horizon) < 0.2
    assert math.isclose(got["s"], ruined / paths) and got["t"] == 1.0


def test_ruin_over_pieces_and_ranges(spark):
    """One strategy's trades lie in several tasks and pieces, and every block is drawn as from one list."""
    size, paths = 3 * metrics.PIECE + 3, 40
    rs = [round(math.sin(k * k) * 2, 3) for k in range(size)]
    rows = [("s", f"{k:05d}", r) for k, r in enumerate(rs)]
    df = spark.createDataFrame(rows[::7] + [x for i, x in enumerate(rows) if i % 7], "strategy string, trade_id string, r_multiple double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be put together
    try:
        got = metrics.numbered(df.withColumn("same", F.col("trade_id")), "strategy", ["trade_id", "r_multiple"]).select("i", "same", F.spark_partition_id().alias("p")).collect()
        assert sorted((r["i"], int(r["same"])) for r in got) == [(k, k) for k in range(size)]
        assert len({r["p"] for r in got}) > 1
        ruin = metrics.bootstrap_ruin(df, paths=paths, horizon=100, limit=0.3, worse_share=0.0).first()["ruin"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    ruined = 0
    for p in range(paths):
        level = peak = 1.0
        low = False
        for step in range(100):
            b, j = divmod(step, 5)
            r = rs[int(hashlib.md5(f"s:{p}:{b}".encode()).hexdigest()[:8], 16) % (size - 4) + j]
            level *= 1 + 0.02 * ((1.3 * r if r < 0 else r) - 0.05)
            peak = max(peak, level)
            low = low or level <= 0.7 * peak
        ruined += low
    assert 0 < ruined < paths and math.isclose(ruin, ruined / paths)


def test_ruin_is_registered_whole(spark, monkeypatch):
    from tapeworks.plans import queries

    seen = {}
    monkeypatch.setattr(queries, "_trades", lambda *_: None)
    monkeypatch.setattr(queries.m, "bootstrap_ruin", lambda _, **k: seen.update(k) or spark.createDataFrame([("s", 0.5)], "strategy string, ruin double"))
    queries.ruin_bootstrap(spark, "")
    assert seen == {"paths": 10_000, "horizon": 200}
