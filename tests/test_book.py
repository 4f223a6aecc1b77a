import time
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tapeworks.operators import metrics
from tapeworks.operators.exposure import business_seconds, exposure, round_trips
from tapeworks.streaming.review import review_arrivals, review_on_arrival

TRADES = "book string, account string, entry_ts timestamp, exit_ts timestamp, risk_usd double, gross_usd double"


def at(day, hour=15, minute=0):
    return datetime(2024, 1, day, hour, minute)  # 1 January 2024 is a Monday


def test_exposure_over_days_and_breaches(spark):
    rows = [("a", "x", at(1), at(3), 50.0, 900.0), ("a", "x", at(2), at(3), 60.0, 900.0), ("a", "x", at(3), at(4), 70.0, 300.0), ("b", "x", at(2), at(2, 16), 10.0, 10.0), ("b", "x", None, at(2, 17), 0.0, 0.0)]
    got = {(r["book"], r["ts"].day, r["ts"].hour): (r["open"], round(r["heat_pct"], 9), r["gross_usd"], r["breaches"]) for r in exposure(spark.createDataFrame(rows, TRADES), 1000.0, 1, 10.0, 1.0).collect()}
    assert got["a", 1, 15] == (1, 5.0, 900.0, "")
    assert got["a", 2, 15] == (2, 11.0, 1800.0, "positions,heat,leverage")
    assert got["a", 3, 15] == (1, 7.0, 300.0, "")  # two end and one begins at one time
    assert got["a", 4, 15] == (0, 0.0, 0.0, "") and got["b", 2, 16][0] == 0


def test_business_clock_matches_numpy(spark):
    days = [at(1) + timedelta(days=i, hours=i % 7) for i in range(40)]
    rows = spark.createDataFrame([(d,) for d in days], "ts timestamp").select("ts", business_seconds(F.col("ts")).alias("k")).collect()
    for r in rows:
        d = r["ts"]
        n = int(np.busday_count("1970-01-05", d.date()))
        second = (d.hour * 60 + d.minute) * 60 + d.second if d.weekday() < 5 else 0
        assert r["k"] == n * 86400 + second


def test_round_trips_over_a_weekend(spark):
    trip = lambda day, hour=16: ("a", "x", at(day, hour - 1), at(day, hour), 1.0, 1.0)
    held = ("a", "x", at(2), at(4), 1.0, 1.0)  # not on one date
    late = ("a", "x", datetime(2024, 1, 9, 2), datetime(2024, 1, 9, 4, 30), 1.0, 1.0)  # evening of the 8th in New York
    rows = [trip(4, 15), trip(5), trip(5), trip(8), trip(11, 15), trip(12), held, late]
    got = {(r["exit_ts"].day, r["exit_ts"].hour): (r["n"], r["n_recent"], r["over"]) for r in round_trips(spark.createDataFrame(rows, TRADES), most=4).collect()}
    assert got == {(4, 15): (1, 1, False), (5, 16): (2, 3, False), (8, 16): (1, 4, False), (9, 4): (1, 5, True), (11, 15): (1, 5, True), (12, 16): (1, 4, False)}


def test_round_trips_grow_with_their_rows(spark):
    """Exits of every other second of nine days, counted in plain Python; a frame of five days a row does not end in time."""
    n = 9 * 43_200
    t = spark.range(n).select(F.lit("b").alias("book"), F.when(F.col("id") % 2 == 0, "x").alias("account"), F.timestamp_seconds(1704121200 + F.col("id") * 2).alias("exit_ts"))
    began = time.monotonic()
    got = round_trips(t.withColumn("entry_ts", F.col("exit_ts")), most=9).agg(F.count("*"), F.sum("n_recent"), F.min("n_recent"), F.max("n_recent")).first()
    took = time.monotonic() - began
    ks = []
    for i in range(n):
        d = 1704121200 - 345600 + i * 2  # the clock begins on Monday 5 January 1970
        week, at_ = divmod(d // 86400, 7)
        ks.append((week * 5 + min(at_, 5)) * 86400 + (d % 86400 if at_ < 5 else 0))
    want = []
    for own in (ks[::2], ks[1::2]):
        k = np.array(own)
        want.append(np.searchsorted(k, k, "right") - np.searchsorted(k, k - 5 * 86400, "right"))
    w = np.concatenate(want)
    assert tuple(got) == (n, w.sum(), w.min(), w.max())
    assert took < 60


def test_cost_stats(spark):
    rows = [("s", 2, 30.0, 5.0, 1.0, None, True), ("s", 4, -10.0, 5.0, 2.0, 2.0, None), ("t", None, 0.0, None, None, None, False)]
    d = spark.createDataFrame(rows, "strategy string, bars_held int, gross_pnl double, spread_slippage double, fees double, financing double, pdt_violation boolean")
    got = {r["strategy"]: r.asDict() for r in metrics.cost_stats(d).collect()}
    assert got["s"] == {"strategy": "s", "avg_bars_held": 3.0, "spread_slippage": 10.0, "fees": 3.0, "financing": 2.0, "borrow": 0.0, "margin_interest": 0.0, "violations": 1, "costs_usd": 15.0, "costs_share": 0.3}
    assert got["t"]["costs_share"] == 0.0 and got["t"]["avg_bars_held"] is None and got["t"]["violations"] == 0


BOOK = "symbol string, asset_class string, direction int, qty double, usd double, entry_time timestamp, entry double, stop double, target double, risk double, max_bars int, best double, reduced boolean"
BARS = "symbol string, time timestamp, price double, atr double, bar_hours double"


def test_review_on_arrival_equals_review_of_each_batch(spark, tmp_path):
    book = spark.createDataFrame([(s, "stocks", 1, 10.0, 1.0, at(1), 100.0, 98.0, 104.0, 2.0, 10, None, False) for s in ("A", "B", "C")], BOOK)
    first = [("A", at(2), 100.2, 1.0, 24.0), ("A", at(3), 102.5, 1.0, 24.0), ("B", at(2), 99.9, 1.0, 24.0), ("Z", at(2), 5.0, 1.0, 24.0)]
    second = [("B", at(8), 100.1, 1.0, 24.0), ("A", at(12), 103.0, 1.0, 24.0), ("C", at(9), None, 1.0, 24.0)]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, BARS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    for k in range(2):  # the second start finds nothing new and changes nothing
        review_on_arrival(stream, book, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    line = lambda d: sorted((r["symbol"], r["time"], r["bars_held"], [tuple(a) for a in r["actions"]]) for r in d.collect())
    for k, rows in enumerate((first, second)):
        got = line(spark.read.parquet(f"{tmp_path}/out/batch={k}"))
        assert got == line(review_arrivals(spark.createDataFrame(rows, BARS), book))
        kinds = {s: (a[0][0], a[0][1]) for s, _, _, a in got}
        assert kinds == [{"A": ("move_stop", "protect"), "B": ("hold", "within plan")}, {"A": ("close", "time limit"), "B": ("close", "stale"), "C": ("hold", "no fresh price")}][k]
