"""Price bars: one long table (symbol, tf, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
# Seconds a bar of each timeframe covers.
SECONDS = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800}


def read_csv_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of ``{symbol}_{tf}.csv`` files under ``path``, cleaned, from ``start`` up to before ``end``."""
    schema = "ts timestamp, open double, high double, low double, close double, volume double"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_([A-Z]+\d+)\.csv$", 1)
    tf = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_([A-Z]+\d+)\.csv$", 2)
    return time_range(normalize(raw.select(name.alias("symbol"), tf.alias("tf"), "*", F.monotonically_increasing_id().alias("seq")), "seq"), start, end)


def write_bars(bars: DataFrame, path: str, kind: str = "parquet") -> None:
    """Bars as files in folders of timeframe and symbol."""
    bars.repartition("tf", "symbol").write.mode("overwrite").partitionBy("tf", "symbol").format(kind).save(path)


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return time_range(spark.read.parquet(path), start, end)


def time_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` up to before ``end``."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    return bars if end is None else bars.where(F.col("ts") < F.to_timestamp(F.lit(end)))


def normalize(raw: DataFrame, seq: str) -> DataFrame:
    """Lower-case names, short price names spelled out, doubles, volume 0 where it lacks, last row of each key kept."""
    short = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
    df = raw.select(*[F.col(c).alias(short.get(c.lower(), c.lower())) for c in raw.columns])
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    last = Window.partitionBy("symbol", "tf", "ts").orderBy(F.col(seq.lower()).desc())
    df = df.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return df.select("symbol", "tf", "ts", *[F.col(c).cast("double").alias(c) for c in [*PRICES, "volume"]])


def problems(bars: DataFrame, jump: float = 0.5) -> DataFrame:
    """(symbol, check, n) for each quality check that finds something."""
    w = Window.partitionBy("symbol", "tf").orderBy("ts")
    move = F.abs(F.log(F.when(F.col("close") > 0, F.col("close"))) - F.log(F.lag(F.when(F.col("close") > 0, F.col("close"))).over(w)))
    tested = bars.select("symbol", *PRICES, "volume", move.alias("move"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in [*PRICES, "volume"]), F.lit(0))
    found = tested.groupBy("symbol").agg(
        F.sum(missing).cast("long").alias("missing"),
        n((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("bracket"),
        n(F.least(*PRICES) <= 0).alias("not_positive"), n(F.col("move") > jump).alias("jump"),
    )
    return found.unpivot("symbol", ["missing", "bracket", "not_positive", "jump"], "check", "n").where("n > 0")


def coverage_gaps(requests: DataFrame, bars: DataFrame, days: int = 5) -> DataFrame:
    """Requests (symbol, tf, start, end) that the stored bars miss by more than ``days`` on either side."""
    held = bars.groupBy("symbol", "tf").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    slack = F.expr(f"interval {days} days")
    ok = (F.col("first") <= F.col("start") + slack) & (F.col("last") >= F.col("end") - slack)
    return requests.join(held, ["symbol", "tf"], "left").where(~F.coalesce(ok, F.lit(False))).select("symbol", "tf", "start", "end")


def candles_from_json(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Complete candles of landed JSON {time, complete, volume, mid: {o, h, l, c}}."""
    j = F.from_json(payload, "time timestamp, complete boolean, volume double, mid struct<o:string,h:string,l:string,c:string>")
    rows = landed.withColumn("j", j).where("j.complete")
    mid = [F.col(f"j.mid.{k}").cast("double").alias(n) for k, n in zip("ohlc", PRICES)]
    return rows.select("symbol", "tf", F.col("j.time").alias("ts"), *mid, F.coalesce("j.volume", F.lit(0.0)).alias("volume"))


def bars_from_epochs(landed: DataFrame) -> DataFrame:
    """Bars of aggregate rows (symbol, tf, t in epoch milliseconds, o, h, l, c, v)."""
    return landed.select("symbol", "tf", F.timestamp_millis("t").alias("ts"), *[F.col(k).cast("double").alias(n) for k, n in zip("ohlcv", [*PRICES, "volume"])])


def _start(tf: str) -> Column:
    if tf in ("D1", "W1"):
        return F.date_trunc({"D1": "day", "W1": "week"}[tf], "ts")
    return F.window("ts", f"{SECONDS[tf]} seconds").start


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Bars of a higher timeframe, stamped with their open time; bins without bars give none."""
    return bars.groupBy("symbol", _start(tf).alias("ts_")).agg(
        F.lit(tf).alias("tf"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).select("symbol", "tf", F.col("ts_").alias("ts"), *PRICES, "volume")


def session_daily(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Daily bars of the regular session (09:30 up to before 16:00 local time), keyed by local date."""
    local = F.from_utc_timestamp("ts", zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return bars.where((minute >= 570) & (minute < 960)).groupBy("symbol", F.to_date(local).alias("d")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )


def session_dates(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Daily bars re-keyed by local date; the last of a date stays."""
    d = F.to_date(F.from_utc_timestamp("ts", zone))
    last = Window.partitionBy("symbol", "d").orderBy(F.col("ts").desc())
    return bars.withColumn("d", d).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "ts")


def _walk(steps: DataFrame, bin_: str, order: list[str], start: int) -> DataFrame:
    """``tick``: the running sum of ``st`` over a symbol's steps, from ``start``.

    Sums of whole bins are added up first (they combine before the shuffle and are few), so only
    the steps of one (symbol, bin) are ever sorted together.
    """
    sums = steps.groupBy("symbol", bin_).agg(F.sum("st").alias("__sum"))
    past = Window.partitionBy("symbol").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("symbol", bin_, F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__base"))
    own = Window.partitionBy("symbol", bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(base, ["symbol", bin_]).withColumn("tick", start + F.col("__base") + F.sum("st").over(own)).drop("__base")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars walked from line items: one symbol for each flag and status, prices in integer ticks."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").cast("long").alias("q"),
        (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("st"), *order,
    )
    p = _walk(t, "ts", order, 10000).withColumn("k", F.struct(*order))
    return p.groupBy("symbol", "ts").agg(
        F.lit("D1").alias("tf"), (F.min_by("tick", "k") / F.lit(100.0)).alias("open"), (F.max("tick") / F.lit(100.0)).alias("high"),
        (F.min("tick") / F.lit(100.0)).alias("low"), (F.max_by("tick", "k") / F.lit(100.0)).alias("close"), F.sum("q").cast("double").alias("volume"),
    ).select("symbol", "tf", "ts", *PRICES, "volume")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars walked from events: one currency pair for each event type."""
    pair = F.create_map(*[F.lit(x) for x in ("click", "EUR_USD", "view", "GBP_USD", "purchase", "AUD_USD", "error", "USD_JPY", "signup", "EUR_JPY")])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        pair[F.col("event_type")].alias("symbol"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("q"),
        (2 * F.get_json_object("props", "$.k").cast("long") - 99).alias("st"), F.date_trunc("hour", "ts").alias("h"),
    )
    p = _walk(e, "h", ["ts", "event_id"], 110000).withColumn("k", F.struct("ts", "event_id"))
    scale = F.when(F.col("symbol").endswith("JPY"), 1000.0).otherwise(100000.0)
    return p.groupBy("symbol", "h").agg(
        F.min_by("tick", "k").alias("o"), F.max("tick").alias("hi"), F.min("tick").alias("lo"), F.max_by("tick", "k").alias("c"), F.sum("q").alias("q")
    ).select("symbol", F.lit("H1").alias("tf"), F.col("h").alias("ts"), *[(F.col(a) / scale).alias(b) for a, b in zip(("o", "hi", "lo", "c"), PRICES)], (F.col("q") / 100.0).alias("volume"))


def universe_bars(spark: SparkSession, sf_dir: str, symbols: int = 25) -> DataFrame:
    """Daily bars of ``symbols`` symbols walked from line items by part, reflected to stay between 50 and 150."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("U"), F.lpad((F.col("l_partkey") % symbols).cast("string"), 2, "0")).alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").cast("long").alias("q"), (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("st"), *order,
    )
    m = F.pmod(F.col("tick"), F.lit(400))
    p = _walk(t, "ts", order, 0).withColumn("price", 50 + F.abs(m - 200) * 0.5).withColumn("k", F.struct(*order))
    return p.groupBy("symbol", "ts").agg(
        F.lit("D1").alias("tf"), F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"), F.sum("q").cast("double").alias("volume"),
    ).select("symbol", "tf", "ts", *PRICES, "volume")


def timeline(bars: DataFrame) -> DataFrame:
    """The distinct bar times of all symbols."""
    return bars.select("ts").distinct()
