from datetime import datetime, timedelta

from tapeworks.operators.align import next_event
from tapeworks.sources.bars import read_bars, read_csv_bars, write_bars


def test_next_event_on_the_day_and_later(spark):
    t = lambda d, h=0: datetime(2024, 1, d, h)
    events = spark.createDataFrame([(t(2, 9),), (t(2, 15),), (t(2, 15),), (t(6, 1),), (None,)], "event_ts timestamp")
    asked = [t(1, 5), t(2, 9), t(2, 10), t(2, 16), t(4), t(6, 1), t(6, 2)]
    got = {r["at"]: r["n"] for r in next_event(spark.createDataFrame([(x,) for x in asked], "at timestamp"), events, "at", "event_ts", "n").collect()}
    assert [got[x] for x in asked] == [t(2, 9), t(2, 9), t(2, 15), t(6, 1), t(6, 1), t(6, 1), None]
    assert next_event(spark.createDataFrame([(t(1),)], "at timestamp"), events.where("false"), "at", "event_ts", "n").first()["n"] is None


def test_bars_through_files(spark, tmp_path):
    rows = [(s, "D1", datetime(2024, 1, 1) + timedelta(days=i), 1.0 + i, 2.0 + i, 0.5, 1.5, 10.0) for s in ("A_B", "C") for i in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double")
    write_bars(bars, f"{tmp_path}/p")
    back = read_bars(spark, f"{tmp_path}/p", "2024-01-02", "2024-01-04").select(*bars.columns)
    assert sorted(map(tuple, back.collect())) == sorted(r for r in rows if 2 <= r[2].day < 4)
    (tmp_path / "c").mkdir()
    for s in ("A_B", "C"):
        lines = [f"{r[2]:%Y-%m-%d %H:%M:%S},{r[3]},{r[4]},{r[5]},{r[6]},{r[7]}" for r in rows if r[0] == s]
        (tmp_path / "c" / f"{s}_D1.csv").write_text("\n".join(["ts,open,high,low,close,volume", *lines, lines[-1]]))
    assert sorted(map(tuple, read_csv_bars(spark, f"{tmp_path}/c").select(*bars.columns).collect())) == sorted(rows)
