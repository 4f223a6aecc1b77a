"""Causal features of bars as Columns over the window of a symbol and timeframe."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def W():
    """The time order of one symbol and timeframe."""
    return Window.partitionBy("symbol", "tf").orderBy("ts")


REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str):
    """Add a feature: a function of columns and parameters that looks only back."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def full(agg, x, n: int, skip: int = 0) -> Column:
    """Aggregate of n rows ending ``skip`` rows back; null unless all n are there and not null."""
    w = W().rowsBetween(-(n - 1) - skip, -skip)
    return F.when(F.count(_c(x)).over(w) == n, agg(_c(x)).over(w))


def shift(x, n: int = 1) -> Column:
    return F.lag(_c(x), n).over(W())


# ---- rules: comparisons with a missing value are false, != is true
def gt(a, b) -> Column:
    return F.coalesce(_c(a) > _c(b), F.lit(False))


def lt(a, b) -> Column:
    return F.coalesce(_c(a) < _c(b), F.lit(False))


def ge(a, b) -> Column:
    return F.coalesce(_c(a) >= _c(b), F.lit(False))


def eq(a, b) -> Column:
    return F.coalesce(_c(a) == _c(b), F.lit(False))


def ne(a, b) -> Column:
    return F.coalesce(_c(a) != _c(b), F.lit(True))


def le(a, b) -> Column:
    return F.coalesce(_c(a) <= _c(b), F.lit(False))


def divided(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def both(*rules) -> Column:
    """All rules; a number counts as true if it is there and not 0."""
    return F.array_min(F.array(*[truthy(r) for r in rules]))


def either(*rules) -> Column:
    return F.array_max(F.array(*[truthy(r) for r in rules]))


def negated(rule) -> Column:
    """True where the rule is not, also where it has no value."""
    return ~truthy(rule)


def truthy(x) -> Column:
    return F.coalesce(_c(x).cast("double"), F.lit(0.0)) != 0


def cross_above(a, b) -> Column:
    prev = shift(b) if not isinstance(b, (int, float)) else F.lit(b)
    return gt(a, b) & le(shift(a), prev)


def cross_below(a, b) -> Column:
    prev = shift(b) if not isinstance(b, (int, float)) else F.lit(b)
    return lt(a, b) & ge(shift(a), prev)


def rising(x, n: int = 1) -> Column:
    return gt(x, shift(x, n))


def falling(x, n: int = 1) -> Column:
    return lt(x, shift(x, n))


def rolling_max(x, n: int) -> Column:
    return full(F.max, x, n)


def rolling_min(x, n: int) -> Column:
    return full(F.min, x, n)


def rolling_mean(x, n: int) -> Column:
    return full(F.avg, x, n)


# ---- window features
@register("highest")
def highest(x="high", period: int = 20) -> Column:
    return full(F.max, x, period, 1)


@register("lowest")
def lowest(x="low", period: int = 20) -> Column:
    return full(F.min, x, period, 1)


@register("zscore")
def zscore(x="close", period: int = 20) -> Column:
    sd = full(F.stddev_samp, x, period)
    return (_c(x) - full(F.avg, x, period)) / F.when(sd > 0, sd)


@register("rel_volume")
def rel_volume(period: int = 20) -> Column:
    return F.try_divide(F.col("volume"), full(F.avg, "volume", period, 1))


@register("efficiency_ratio")
def efficiency_ratio(step: str = "close_step", period: int = 20) -> Column:
    """``step`` names a column with the absolute change of the close."""
    return F.try_divide(F.abs(F.col("close") - shift("close", period)), full(F.sum, step, period))


@register("gap_pct")
def gap_pct() -> Column:
    return F.try_divide(F.col("open"), shift("close")) - 1


@register("bbands")
def bbands(x="close", n: int = 20, up: float = 2.0, down: float = 2.0) -> Column:
    mid, sd = full(F.avg, x, n), full(F.stddev_pop, x, n)
    return F.struct((mid + up * sd).alias("upper"), mid.alias("middle"), (mid - down * sd).alias("lower"))


@register("zone_touch")
def zone_touch(level, atr, tolerance: float = 0.3) -> Column:
    return le("low", _c(level) + tolerance * _c(atr)) & ge("high", _c(level) - tolerance * _c(atr))


@register("true_range")
def true_range() -> Column:
    pc = shift("close")
    return F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


# further window-native indicators
REGISTRY |= {
    "sma": lambda x="close", n=30: full(F.avg, x, n),
    "wma": lambda x="close", n=30: sum((shift(x, k) * (n - k) for k in range(n)), F.lit(0.0)) / (n * (n + 1) / 2),
    "midpoint": lambda x="close", n=14: (full(F.max, x, n) + full(F.min, x, n)) / 2,
    "midprice": lambda n=14: (full(F.max, "high", n) + full(F.min, "low", n)) / 2,
    "mom": lambda x="close", n=10: _c(x) - shift(x, n),
    "roc": lambda x="close", n=10: (F.try_divide(_c(x), shift(x, n)) - 1) * 100,
    "rocp": lambda x="close", n=10: F.try_divide(_c(x), shift(x, n)) - 1,
    "rocr": lambda x="close", n=10: F.try_divide(_c(x), shift(x, n)),
    "bop": lambda: F.coalesce(F.try_divide(F.col("close") - F.col("open"), F.col("high") - F.col("low")), F.lit(0.0)),
    "willr": lambda n=14: -100 * F.try_divide(full(F.max, "high", n) - F.col("close"), full(F.max, "high", n) - full(F.min, "low", n)),
    "stochf": lambda n=5: 100 * F.try_divide(F.col("close") - full(F.min, "low", n), full(F.max, "high", n) - full(F.min, "low", n)),
    "avgprice": lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4,
    "medprice": lambda: (F.col("high") + F.col("low")) / 2,
    "typprice": lambda: (F.col("high") + F.col("low") + F.col("close")) / 3,
    "wclprice": lambda: (F.col("high") + F.col("low") + 2 * F.col("close")) / 4,
    "stddev": lambda x="close", n=5: full(F.stddev_pop, x, n),
    "var": lambda x="close", n=5: full(F.var_pop, x, n),
    "max": lambda x="close", n=30: full(F.max, x, n),
    "min": lambda x="close", n=30: full(F.min, x, n),
    "sum": lambda x="close", n=30: full(F.sum, x, n),
}


# ---- linear recurrences
def recurrence(df: DataFrame, x: Column, decay: float, gain: float, seed: int, name: str, keys=("symbol", "tf"), order: str = "ts", seed_sum: bool = False) -> DataFrame:
    """Add ``name``: y = decay * y_before + gain * x, started with the mean of the first ``seed`` values.

    ``seed_sum``: started with their sum. Rows before the seed give null; a null x gives null and
    is passed over. The recurrence is affine, so it is a scan: rows are cut in blocks so long that
    decay ** length is about 1e-6, each block is a weighted running sum, and the ends of the
    three blocks before carry over (older ones weigh less than a double shows).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    size = max(1, math.ceil(6 * math.log(10) / -math.log(decay))) if decay > 0 else 1
    p = lambda s: f"__{name}_{s}"
    first = F.sum if seed_sum else F.avg
    df = df.withColumn(p("x"), x).withColumn(p("at"), F.when(F.col(p("x")).isNotNull(), F.count(p("x")).over(run) - seed))
    head = first(F.when(F.col(p("at")) <= 0, F.col(p("x")))).over(run)
    u = F.when(F.col(p("at")) == 0, head).when(F.col(p("at")) > 0, gain * F.col(p("x")))
    if decay == 0:  # nothing is carried on
        return df.withColumn(name, u).drop(p("x"), p("at"))
    df = df.withColumn(p("u"), u).withColumn(p("b"), F.floor(F.col(p("at")) / size)).withColumn(p("k"), F.pmod(p("at"), F.lit(size)))
    inner = Window.partitionBy(*keys, p("b")).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(p("l"), F.pow(F.lit(decay), F.col(p("k"))) * F.sum(F.col(p("u")) * F.pow(F.lit(decay), -F.col(p("k")))).over(inner))
    end = (F.col(p("k")) == size - 1) & (F.col(p("at")) >= 0)
    carry = F.lit(0.0)
    for r in range(3):
        df = df.withColumn(p(f"c{r}"), F.coalesce(F.last(F.when(end, F.col(p("l")) + (0.0 if r == 0 else decay**size * F.col(p(f"c{r - 1}")))), ignorenulls=True).over(past), F.lit(0.0)))
        carry = F.col(p(f"c{r}"))
    y = F.when(F.col(p("at")) >= 0, F.col(p("l")) + F.pow(F.lit(decay), F.col(p("k")) + 1) * carry)
    return df.withColumn(name, y).drop(*[p(s) for s in ("x", "at", "u", "b", "k", "l", "c0", "c1", "c2")])


def ema(df: DataFrame, n: int, name: str, x="close") -> DataFrame:
    a = 2 / (n + 1)
    return recurrence(df, _c(x), 1 - a, a, n, name)


def wilder(df: DataFrame, x: Column, n: int, name: str) -> DataFrame:
    return recurrence(df, x, (n - 1) / n, 1 / n, n, name)


def atr(df: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return wilder(df.withColumn("__tr", true_range()), F.col("__tr"), n, name).drop("__tr")


def rsi(df: DataFrame, n: int, name: str, x="close") -> DataFrame:
    d = df.withColumn("__d", _c(x) - shift(x))
    d = wilder(d, F.when(F.col("__d").isNotNull(), F.greatest("__d", F.lit(0.0))), n, "__up")
    d = wilder(d, F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), F.lit(0.0))), n, "__down")
    total = F.col("__up") + F.col("__down")
    y = F.when(total.isNotNull(), F.coalesce(100 * F.try_divide(F.col("__up"), total), F.lit(0.0)))
    return d.withColumn(name, y).drop("__d", "__up", "__down")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macdsignal, macdhist; the fast average is started so that both begin at the same bar."""
    w = W().rowsBetween(Window.unboundedPreceding, 0)
    late = df.withColumn("__late", F.when(F.count("close").over(w) > slow - fast, F.col("close")))
    d = ema(ema(late, slow, "__slow"), fast, "__fast", "__late")
    d = d.withColumn("__macd", F.col("__fast") - F.col("__slow"))
    d = ema(d, signal, "macdsignal", "__macd")
    both = F.col("macdsignal").isNotNull()
    return d.withColumn("macd", F.when(both, F.col("__macd"))).withColumn("macdhist", F.col("macd") - F.col("macdsignal")).drop("__late", "__slow", "__fast", "__macd")


def adx(df: DataFrame, n: int = 14, name: str = "adx") -> DataFrame:
    """Average directional index: Wilder sums of movements and range, then a Wilder mean of DX."""
    up, down = F.col("high") - shift("high"), shift("low") - F.col("low")
    d = df.withColumn("__u", up).withColumn("__d", down).withColumn("__tr", true_range())
    pdm = F.when(F.col("__u").isNotNull(), F.when((F.col("__u") > F.col("__d")) & (F.col("__u") > 0), F.col("__u")).otherwise(0.0))
    mdm = F.when(F.col("__u").isNotNull(), F.when((F.col("__d") > F.col("__u")) & (F.col("__d") > 0), F.col("__d")).otherwise(0.0))
    # the sums start with n - 1 movements; the n-th is added by the first step, which gives no output
    for x, s in ((pdm, "__p"), (mdm, "__m"), (F.col("__tr"), "__t")):
        d = recurrence(d, x, (n - 1) / n, 1.0, n - 1, s, seed_sum=True)
    plus, minus = F.try_divide(F.col("__p"), F.col("__t")), F.try_divide(F.col("__m"), F.col("__t"))
    seen = F.count("__tr").over(W().rowsBetween(Window.unboundedPreceding, 0)) >= n
    dx = F.when(seen & F.col("__t").isNotNull(), F.coalesce(100 * F.try_divide(F.abs(plus - minus), plus + minus), F.lit(0.0)))
    d = d.withColumn("__dx", dx)
    return wilder(d, F.col("__dx"), n, name).drop("__u", "__d", "__tr", "__p", "__m", "__t", "__dx")


# ---- candlesticks (+100, -100 or 0), averages over the ten bars before the candle
def _body(k: int = 0) -> Column:
    return F.abs(shift("close", k) - shift("open", k)) if k else F.abs(F.col("close") - F.col("open"))


def candles(df: DataFrame) -> DataFrame:
    """Engulfing, doji, hammer, shooting star, piercing, dark cloud cover, morning and evening star."""
    d = df.withColumn("__body", F.abs(F.col("close") - F.col("open"))).withColumn("__range", F.col("high") - F.col("low"))
    d = d.withColumn("__ab", full(F.avg, "__body", 10, 1)).withColumn("__ar", full(F.avg, "__range", 10, 1))
    o, h, low, c, b = (F.col(x) for x in ("open", "high", "low", "close", "__body"))
    top, bottom = F.greatest(o, c), F.least(o, c)
    o1, c1, o2, c2 = shift("open", 1), shift("close", 1), shift("open", 2), shift("close", 2)
    long1, long2 = shift("__body", 1) > shift("__ab", 1), shift("__body", 2) > shift("__ab", 2)
    short1 = shift("__body", 1) <= shift("__ab", 1)
    white, white1, white2 = c >= o, c1 >= o1, c2 >= o2
    sign = lambda up, down: F.coalesce(F.when(up, 100).when(down, -100), F.lit(0))
    inside = (top >= F.greatest(o1, c1)) & (bottom <= F.least(o1, c1)) & ((top > F.greatest(o1, c1)) | (bottom < F.least(o1, c1)))
    never = F.lit(False)
    return d.withColumns({
        "engulfing": sign(white & ~white1 & inside, ~white & white1 & inside),
        "doji": sign(b <= 0.1 * F.col("__ar"), never),
        "hammer": sign((b < F.col("__ab")) & (bottom - low > b) & (h - top < 0.1 * F.col("__ar")) & (bottom <= shift("low", 1) + 0.2 * shift("__ar", 1)), never),
        "shootingstar": sign(never, (b < F.col("__ab")) & (h - top > b) & (bottom - low < 0.1 * F.col("__ar")) & (bottom > F.greatest(o1, c1))),
        "piercing": sign(~white1 & long1 & white & (b > F.col("__ab")) & (o < shift("low", 1)) & (c < o1) & (c > c1 + 0.5 * (o1 - c1)), never),
        "darkcloudcover": sign(never, white1 & long1 & ~white & (o > shift("high", 1)) & (c > o1) & (c < c1 - 0.5 * (c1 - o1))),
        "morningstar": sign(~white2 & long2 & short1 & (F.greatest(o1, c1) < F.least(o2, c2)) & white & (b > F.col("__ab")) & (c > c2 + 0.3 * (o2 - c2)), never),
        "eveningstar": sign(never, white2 & long2 & short1 & (F.least(o1, c1) > F.greatest(o2, c2)) & ~white & (b > F.col("__ab")) & (c < c2 - 0.3 * (c2 - o2))),
    }).drop("__body", "__range", "__ab", "__ar")


def candle_score(names: list[str], near: Column | None = None) -> Column:
    """Sum of detectors over 100, nothing away from the level."""
    total = sum((F.col(n) / 100 for n in names), F.lit(0.0))
    return total if near is None else F.when(near, total).otherwise(0.0)


def cross_free_signals(d: DataFrame) -> DataFrame:
    """Eight yes-or-no signals (``sig_`` columns) of bars that bear their candles; a missing value is a no."""
    d = macd(rsi(ema(ema(d, 20, "__e20"), 50, "__e50"), 14, "__rsi"))
    found = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    return d.withColumns({
        "sig_ema20_above_ema50": gt("__e20", "__e50"), "sig_rsi14_below_30": lt("__rsi", 30), "sig_rsi14_above_70": gt("__rsi", 70),
        "sig_macd_above_signal": gt("macd", "macdsignal"), "sig_donchian20_breakout": gt("close", highest("high", 20)),
        "sig_cdl_engulfing": found("engulfing"), "sig_cdl_hammer": found("hammer"), "sig_cdl_doji": found("doji"),
    })
