import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tapeworks.operators import allocation as a

BOOK = "strategy string, status string, recent double, dsr double, fit double, kelly_pct double, cap_pct double, cluster string, equity double, peak double"


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i)


def test_links_by_correlation_or_by_class_and_symbol(spark):
    draw = random.Random(1)
    base = [draw.gauss(0, 1) for _ in range(80)]
    rows = [("a", day(i), x) for i, x in enumerate(base)] + [("b", day(i), x + draw.gauss(0, 0.1)) for i, x in enumerate(base)] + [("c", day(i), -x) for i, x in enumerate(base)]
    rows += [(s, day(i), draw.gauss(0, 1)) for s in "de" for i in range(10)] + [("f", day(i), 0.5) for i in range(80)]
    records = [("a", "stocks", ["X"]), ("b", "stocks", ["Y"]), ("c", "stocks", ["X"]), ("d", "stocks", ["X", "Z"]), ("e", "forex", ["X"]), ("f", "forex", ["Z"]), ("g", "stocks", ["Z"])]
    returns = spark.createDataFrame(rows, "strategy string, d timestamp, ret double")
    recs = spark.createDataFrame(records, "strategy string, asset_class string, symbols array<string>")
    links = {tuple(r) for r in a.cluster_links(returns, recs).collect()}
    assert links == {("a", "b"), ("a", "d"), ("c", "d"), ("d", "g")}  # a and c share 80 days and do not move together; f never moves
    assert {r["strategy"]: r["cluster"] for r in a.clusters(returns, recs).collect()} == {**dict.fromkeys("abcdg", "a"), "e": "e", "f": "f"}


def test_split_by_mode_caps_and_drawdown(spark):
    rows = [("a", "live", 2.0, 0.9, 2.0, 9.0, 9.0, "1"), ("b", "validated", 2.0, 0.9, 2.0, 9.0, 2.5, "1"), ("c", "paper", 1.0, 0.6, 1.0, 0.5, 9.0, "2"), ("d", "live", -3.0, 0.1, -3.0, 9.0, 9.0, "3"), ("e", "live", 2.0, 0.9, 2.0, 0.0, 9.0, "4"), ("f", "rejected", 9.0, 1.0, 9.0, 9.0, 9.0, "1")]
    get = lambda eq, **k: {r["strategy"]: r for r in a.allocate(spark.createDataFrame([(*r, eq, 100.0) for r in rows], BOOK), **k).collect()}
    top = get(None)
    assert math.isclose(top["a"]["risk_pct"] + top["b"]["risk_pct"], 6.0) and top["b"]["risk_pct"] == 2.5 and top["c"]["risk_pct"] == 0.5
    assert top["b"]["notes"] == ["at cap 2.50%", "shares cluster 1 with 1 more"] and top["c"]["notes"] == ["at cap 0.50%"]
    assert [top[s]["excluded"] for s in "def"] == ["score not positive", "no edge to size", "status rejected not eligible in paper mode"]
    live = get(None, mode="live")
    assert live["b"]["risk_pct"] == live["c"]["risk_pct"] == 0 and live["a"]["risk_pct"] == 5.0
    low = get(80.0, total=4.0)
    assert math.isclose(sum(r["risk_pct"] for r in low.values()), 2.0, abs_tol=1e-3) and "budget x0.50 for drawdown" in low["a"]["notes"]
    assert all(r["risk_pct"] == 0 for r in get(10.0).values())


def test_days_see_only_what_is_before(spark):
    labels = spark.createDataFrame([(day(i), x) for i, x in ((0, "p"), (5, "q"), (9, "p"))], "ts timestamp, label string")
    days = spark.createDataFrame([(day(0),), (day(5),), (day(6),), (day(20),)], "asof timestamp")
    known = a.labels_before(labels, days)
    assert {r["asof"]: r["label"] for r in known.collect()} == {day(0): "unknown", day(5): "p", day(6): "q", day(20): "p"}
    draw = random.Random(2)
    rets = [(s, day(i), draw.gauss(0.1, 1)) for s in "st" for i in range(15)]
    got = {(r["strategy"], r["asof"]): r["fit"] for r in a.fits(spark.createDataFrame(rets, "strategy string, d timestamp, ret double"), labels.withColumnRenamed("ts", "d"), known, shrink=10).collect()}

    def sharpe(x):
        mean = sum(x) / len(x)
        return mean / math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)) * math.sqrt(252)

    of = lambda i: "q" if 5 <= i < 9 else "p"
    for (s, at), fit in got.items():
        cur = {0: "unknown", 5: "p", 6: "q", 20: "p"}[(at - day(0)).days]
        mine = [(d, r) for n, d, r in rets if n == s]
        own = [r for d, r in mine if d >= at or of((d - day(0)).days) == cur]
        whole = sharpe([r for _, r in mine])
        w = len(own) / (len(own) + 10)
        assert math.isclose(fit, whole if len(own) < 5 else w * sharpe(own) + (1 - w) * whole, rel_tol=1e-9)
    assert len(got) == 8


def test_universe_of_funded_strategies(spark):
    days = spark.createDataFrame([(day(3),)], "asof timestamp")
    records = spark.createDataFrame([("s", "stocks", "live", ["A", "B"], True, 3.0), ("t", "stocks", "live", ["A"], False, 3.0), ("u", "stocks", "rejected", ["A"], True, 3.0)], "strategy string, asset_class string, status string, symbols array<string>, uses_watchlist boolean, cap_pct double")
    evidence = spark.createDataFrame([(s, 2.0, 0.9, 4.0, s, None, None) for s in "stu"], "strategy string, recent double, dsr double, kelly_pct double, cluster string, equity double, peak double")
    returns = spark.createDataFrame([(s, day(i), 0.1 * (i % 3)) for s in "stu" for i in range(6)], "strategy string, d timestamp, ret double")
    ranking = spark.createDataFrame([(day(1), "Z", 1), (day(2), "C", 1), (day(2), "A", 2), (day(3), "Y", 1)], "ts timestamp, symbol string, rank int")
    labels = spark.createDataFrame([(day(0), "x")], "ts timestamp, label string")
    plan = {r["strategy"]: r for r in a.daily_plan(days, records, evidence, returns, labels, ranking, labels.withColumnRenamed("ts", "d")).collect()}
    assert plan["s"]["universe"] == ["A", "B", "C"] and plan["t"]["universe"] == ["A"] and plan["u"]["universe"] == []
    assert {r["regime"] for r in plan.values()} == {"x"} and plan["u"]["risk_pct"] == 0
