"""Further indicators: regressions and places of extremes over windows, and recurrences over recurrences.

Each takes bars and the name of the column that it adds; a value is null until its whole
window or start is there. The definitions are the common public ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators import features as f
from tapeworks.operators.features import W, _c, ema, full, shift, wilder

FRAMES: dict[str, Callable[..., DataFrame]] = {}


def indicator(make):
    FRAMES[make.__name__] = make
    return make


def _with(df: DataFrame, name: str, value: Column, *drop: str) -> DataFrame:
    return df.withColumn(name, value).drop(*drop)


# ---- regression on time: weights of a window's values around their middle sum to nothing, so only differences count
def _slope(x, n: int) -> Column:
    middle = (n - 1) / 2
    return sum((shift(x, k) * (middle - k) for k in range(n)), F.lit(0.0)) / (n * (n * n - 1) / 12)


def linear_value(x="close", n: int = 14, ahead: float = 0.0) -> Column:
    """The fitted line of the last n values, ``ahead`` bars after the last."""
    return full(F.avg, x, n) + _slope(x, n) * ((n - 1) / 2 + ahead)


@f.register("linearreg")
def linearreg(x="close", n: int = 14) -> Column:
    return linear_value(x, n)


@f.register("linearreg_slope")
def linearreg_slope(x="close", n: int = 14) -> Column:
    return _slope(x, n)


@f.register("linearreg_intercept")
def linearreg_intercept(x="close", n: int = 14) -> Column:
    return linear_value(x, n, -(n - 1))


@f.register("tsf")
def tsf(x="close", n: int = 14) -> Column:
    return linear_value(x, n, 1)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is nothing but rounding or less, null where one is missing."""
    return F.when(b > 1e-12, a / b).when(a.isNotNull() & b.isNotNull(), 0.0)


@f.register("correl")
def correl(x="high", y="low", n: int = 30) -> Column:
    w = W().rowsBetween(-(n - 1), 0)
    both = F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), 1)).over(w) == n
    return F.when(both, _ratio(F.covar_pop(_c(x), _c(y)).over(w), F.stddev_pop(_c(x)).over(w) * F.stddev_pop(_c(y)).over(w)))


@indicator
def beta(df: DataFrame, name: str, x="high", y="low", n: int = 5) -> DataFrame:
    """Slope of the returns of y on those of x."""
    d = df.withColumns({f"__{name}_{c}": F.try_divide(_c(v), shift(v)) - 1 for c, v in (("x", x), ("y", y))})
    a, b = F.col(f"__{name}_x"), F.col(f"__{name}_y")
    w = W().rowsBetween(-(n - 1), 0)
    var = F.var_pop(a).over(w)
    slope = F.when(var > 1e-18, F.covar_pop(a, b).over(w) / F.when(var > 1e-18, var)).otherwise(0.0)
    return _with(d, name, F.when(F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(w) == n, slope), f"__{name}_x", f"__{name}_y")


@indicator
def aroon(df: DataFrame, name: str, n: int = 14) -> DataFrame:
    """struct<up, down, osc>: how recent the extreme of the last n + 1 bars is; of equal extremes the latest."""
    d = df.withColumn("__rn", F.row_number().over(W()))
    w = W().rowsBetween(-n, 0)
    top, bottom = F.max(F.struct("high", "__rn")).over(w)["__rn"], -F.min(F.struct(F.col("low"), (-F.col("__rn")).alias("r"))).over(w)["r"]
    since = lambda at: 100.0 * (n - (F.col("__rn") - at)) / n
    value = F.struct(since(top).alias("up"), since(bottom).alias("down"), (since(top) - since(bottom)).alias("osc"))
    return _with(d, name, F.when(F.count("high").over(w) == n + 1, value), "__rn")


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


@indicator
def cci(df: DataFrame, name: str, n: int = 14) -> DataFrame:
    """Distance of the typical price from its mean in units of 0.015 mean deviations; the window holds n values."""
    d = df.withColumn("__tp", _typical())
    d = d.withColumn("__seen", full(F.collect_list, "__tp", n)).withColumn("__mean", full(F.avg, "__tp", n))
    spread = F.aggregate("__seen", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("__mean"))) / n
    return _with(d, name, _ratio(F.col("__tp") - F.col("__mean"), 0.015 * spread), "__tp", "__seen", "__mean")


@indicator
def mfi(df: DataFrame, name: str, n: int = 14) -> DataFrame:
    """Share of money flow on rising typical prices, 0 where the flow is under 1."""
    d = df.withColumn("__tp", _typical())
    d = d.withColumn("__step", F.col("__tp") - shift("__tp")).withColumn("__flow", F.col("__tp") * F.col("volume"))
    part = lambda up: full(F.sum, F.when(F.col("__step").isNotNull(), F.when(up, F.col("__flow")).otherwise(0.0)), n)
    up, down = part(F.col("__step") > 0), part(F.col("__step") < 0)
    return _with(d, name, F.when(up + down >= 1, 100 * up / F.when(up + down >= 1, up + down)).when(up.isNotNull(), 0.0), "__tp", "__step", "__flow")


def _running(df: DataFrame, name: str, step: Column) -> DataFrame:
    """Running sum of ``step`` over each series, by whole months first so that only a month is summed in order."""
    d = df.withColumn("__step", step).withColumn("__month", F.date_trunc("month", "ts"))
    past = Window.partitionBy("symbol", "tf").orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    months = d.groupBy("symbol", "tf", "__month").agg(F.sum("__step").alias("s")).select("symbol", "tf", "__month", F.coalesce(F.sum("s").over(past), F.lit(0.0)).alias("__base"))
    own = Window.partitionBy("symbol", "tf", "__month").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return _with(d.join(months, ["symbol", "tf", "__month"]), name, F.col("__base") + F.sum("__step").over(own), "__step", "__month", "__base")


@indicator
def obv(df: DataFrame, name: str) -> DataFrame:
    """Volume summed with the sign of the close's change; the first bar counts whole."""
    return _running(df, name, F.coalesce(F.signum(F.col("close") - shift("close")), F.lit(1.0)) * F.col("volume"))


@indicator
def ad(df: DataFrame, name: str) -> DataFrame:
    """Volume summed by where the close lies in the bar's range."""
    width = F.col("high") - F.col("low")
    place = F.when(width > 0, (2 * F.col("close") - F.col("low") - F.col("high")) / F.when(width > 0, width)).otherwise(0.0)
    return _running(df, name, place * F.col("volume"))


@indicator
def ultosc(df: DataFrame, name: str, a: int = 7, b: int = 14, c: int = 28) -> DataFrame:
    """Buying pressure over true range of three lengths, weighted 4, 2 and 1."""
    pc = shift("close")
    d = df.withColumn("__bp", F.when(pc.isNotNull(), F.col("close") - F.least("low", pc))).withColumn("__tr", F.when(pc.isNotNull(), F.greatest("high", pc) - F.least("low", pc)))
    part = lambda n: _ratio(full(F.sum, "__bp", n), full(F.sum, "__tr", n))
    return _with(d, name, 100 * (4 * part(a) + 2 * part(b) + part(c)) / 7, "__bp", "__tr")


@indicator
def stoch(df: DataFrame, name: str, fast: int = 5, slow: int = 3, signal: int = 3) -> DataFrame:
    """struct<slowk, slowd>: place of the close in the range of bars, smoothed once and twice."""
    low, high = full(F.min, "low", fast), full(F.max, "high", fast)
    d = df.withColumn("__k", _ratio(100 * (F.col("close") - low), high - low))
    d = d.withColumn("__sk", full(F.avg, "__k", slow)).withColumn("__sd", full(F.avg, "__sk", signal))
    return _with(d, name, F.when(F.col("__sd").isNotNull(), F.struct(F.col("__sk").alias("slowk"), F.col("__sd").alias("slowd"))), "__k", "__sk", "__sd")


# ---- recurrences over recurrences; each starts with the mean of the first n values of the one before
def _cascade(df: DataFrame, x, n: int, depth: int, stem: str) -> DataFrame:
    for k in range(depth):
        df = ema(df, n, f"{stem}{k + 1}", x if k == 0 else f"{stem}{k}")
    return df


def _combined(df: DataFrame, name: str, x, n: int, weights: dict[int, float]) -> DataFrame:
    stem, depth = f"__{name}_", max(weights)
    d = _cascade(df, x, n, depth, stem)
    return _with(d, name, sum((w * F.col(f"{stem}{k}") for k, w in weights.items()), F.lit(0.0)), *[f"{stem}{k + 1}" for k in range(depth)])


@indicator
def dema(df: DataFrame, name: str, n: int = 30, x="close") -> DataFrame:
    return _combined(df, name, x, n, {1: 2.0, 2: -1.0})


@indicator
def tema(df: DataFrame, name: str, n: int = 30, x="close") -> DataFrame:
    return _combined(df, name, x, n, {1: 3.0, 2: -3.0, 3: 1.0})


@indicator
def t3(df: DataFrame, name: str, n: int = 5, v: float = 0.7, x="close") -> DataFrame:
    """Three generalised double averages (1 + v) e - v e(e) over one another, written out in the six single ones."""
    return _combined(df, name, x, n, {3: (1 + v) ** 3, 4: -3 * v * (1 + v) ** 2, 5: 3 * v * v * (1 + v), 6: -(v**3)})


@indicator
def trix(df: DataFrame, name: str, n: int = 30, x="close") -> DataFrame:
    """Percent change of the threefold average."""
    d = _combined(df, f"__{name}", x, n, {3: 1.0})
    e = F.col(f"__{name}")
    return _with(d, name, 100 * (F.try_divide(e, shift(e)) - 1), f"__{name}")


@indicator
def adosc(df: DataFrame, name: str, fast: int = 3, slow: int = 10) -> DataFrame:
    """Fast less slow average of the distribution line; both start with its first value, the result with bar ``slow``."""
    d = ad(df, "__ad")
    for n, c in ((fast, "__f"), (slow, "__s")):
        d = f.recurrence(d, F.col("__ad"), 1 - 2 / (n + 1), 2 / (n + 1), 1, c)
    late = F.count("__ad").over(W().rowsBetween(Window.unboundedPreceding, 0)) >= slow
    return _with(d, name, F.when(late, F.col("__f") - F.col("__s")), "__ad", "__f", "__s")


@indicator
def cmo(df: DataFrame, name: str, n: int = 14, x="close") -> DataFrame:
    """Gains less losses over both, as Wilder averages."""
    d = df.withColumn("__d", _c(x) - shift(x))
    d = wilder(d, F.greatest("__d", F.col("__d") * 0), n, "__up")
    d = wilder(d, F.greatest(-F.col("__d"), F.col("__d") * 0), n, "__down")
    return _with(d, name, _ratio(100 * (F.col("__up") - F.col("__down")), F.col("__up") + F.col("__down")), "__d", "__up", "__down")


@indicator
def stochrsi(df: DataFrame, name: str, n: int = 14, fast: int = 5, signal: int = 3, x="close") -> DataFrame:
    """struct<fastk, fastd>: place of the RSI in its own range, and its mean."""
    d = f.rsi(df, n, "__rsi", x)
    low, high = full(F.min, "__rsi", fast), full(F.max, "__rsi", fast)
    d = d.withColumn("__k", _ratio(100 * (F.col("__rsi") - low), high - low))
    d = d.withColumn("__fd", full(F.avg, "__k", signal))
    return _with(d, name, F.when(F.col("__fd").isNotNull(), F.struct(F.col("__k").alias("fastk"), F.col("__fd").alias("fastd"))), "__rsi", "__k", "__fd")


@indicator
def natr(df: DataFrame, name: str, n: int = 14) -> DataFrame:
    return _with(f.atr(df, n, f"__{name}"), name, 100 * F.try_divide(f"__{name}", "close"), f"__{name}")


@indicator
def adxr(df: DataFrame, name: str, n: int = 14) -> DataFrame:
    """Mean of the directional index and its value n - 1 bars before."""
    return _with(f.adx(df, n, f"__{name}"), name, (F.col(f"__{name}") + shift(f"__{name}", n - 1)) / 2, f"__{name}")


f.REGISTRY |= {
    "trima": lambda x="close", n=30: sum((shift(x, k) * min(k + 1, n - k) for k in range(n)), F.lit(0.0)) / sum(min(k + 1, n - k) for k in range(n)),
    "apo": lambda x="close", fast=12, slow=26: full(F.avg, x, fast) - full(F.avg, x, slow),
    "ppo": lambda x="close", fast=12, slow=26: 100 * (F.try_divide(full(F.avg, x, fast), full(F.avg, x, slow)) - 1),
    "minmax": lambda x="close", n=30: F.struct(full(F.min, x, n).alias("min"), full(F.max, x, n).alias("max")),
    "trange": f.true_range,
}
