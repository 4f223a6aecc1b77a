"""Strategies as tables: feature sets over timeframes, rules with filters, parameter grids, and all their trades on all folds at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators import features as f
from tapeworks.operators import indicators, trades
from tapeworks.operators.align import align_higher, clear_of_earnings, outside_events
from tapeworks.sources.bars import SECONDS, resample

BARS = ["open", "high", "low", "close", "volume"]
#: Features that add a column to a frame; the others of features.REGISTRY are Columns.
FRAMES: dict[str, Callable[..., DataFrame]] = {
    "ema": lambda d, name, n=30, x="close": f.ema(d, n, name, x),
    "atr": lambda d, name, n=14: f.atr(d, n, name),
    "atr_pct": lambda d, name, n=14: f.atr(d, n, "__atr_pct").withColumn(name, F.try_divide("__atr_pct", "close")).drop("__atr_pct"),
    "rsi": lambda d, name, n=14, x="close": f.rsi(d, n, name, x),
    "adx": lambda d, name, n=14: f.adx(d, n, name),
    **indicators.FRAMES,
}
# Other names of parameters.
ALIASES = {"period": "n", "timeperiod": "n", "input": "x", "ref": "x"}


def _arguments(name: str, given: dict) -> dict:
    """Parameters under the names that the feature takes."""
    code = (FRAMES.get(name) or f.REGISTRY[name]).__code__
    takes = code.co_varnames[: code.co_argcount]
    out = {}
    for k, v in given.items():
        key = k if k in takes else ALIASES.get(k, k)
        if key not in takes:
            raise ValueError(f"{name} takes no parameter {k}")
        out[key] = v
    return out


def compute_features(bars: DataFrame, base: str, features: dict[str, dict]) -> DataFrame:
    """``bars`` of timeframe ``base`` with a column for each feature {name: {fn, tf, output, parameters}}, in declared order.

    Features of one timeframe share one pass: Columns that need no other feature go into one
    projection, so their windows share one sort. Higher timeframes are resampled once each and come back by
    one as-of join each, known when their bar has closed. A feature may use earlier ones of its timeframe, and one of
    the base timeframe also those aligned before it. ``output`` picks a field of a feature that gives several.
    """
    frames = {base: bars}
    pending: dict[str, dict[str, Column]] = {}
    aligned: dict[str, list[str]] = {}

    def flush(tf: str) -> None:
        if pending.get(tf):
            frames[tf] = frames[tf].withColumns(pending.pop(tf))

    def bring(tf: str) -> None:
        flush(tf)
        names = aligned.pop(tf, [])
        if names:
            flush(base)
            got = align_higher(frames[base], SECONDS[base], frames[tf], SECONDS[tf], names, "__higher")
            frames[base] = got.withColumns({n: F.col(f"__higher.{n}") for n in names}).drop("__higher")

    for name, spec in features.items():
        tf, fn = spec.get("tf", base), spec["fn"]
        given = _arguments(fn, {k: v for k, v in spec.items() if k not in ("fn", "tf", "output")})
        if tf not in frames:
            frames[tf] = resample(bars, tf)
        uses = [v for v in given.values() if isinstance(v, str)]
        for other in [t for t, names in aligned.items() if tf == base and set(names) & set(uses)]:
            bring(other)
        if set(pending.get(tf, {})) & set(uses) or fn in FRAMES:
            flush(tf)
        if fn in FRAMES:
            frames[tf] = FRAMES[fn](frames[tf], name, **given)
            if "output" in spec:
                frames[tf] = frames[tf].withColumn(name, F.col(name)[spec["output"]])
        else:
            found = f.REGISTRY[fn](**given)
            pending.setdefault(tf, {})[name] = found[spec["output"]] if "output" in spec else found
        if tf != base:
            aligned.setdefault(tf, []).append(name)
    for tf in list(aligned):
        bring(tf)
    flush(base)
    return frames[base].select(*bars.columns, *features)


# ---- rules and filters
FILTERS: dict[str, Callable[[DataFrame, dict], DataFrame | None]] = {}


def register_filter(name: str):
    """Add an entry filter: a function of bars and a context that returns the bars on which entries are allowed, or None if it has nothing to go by."""

    def add(fn):
        FILTERS[name] = fn
        return fn

    return add


@register_filter("no_high_impact_news_30m")
def _no_news(bars: DataFrame, context: dict) -> DataFrame | None:
    events = context.get("events")
    return None if events is None else outside_events(bars, events, "30 minutes", "30 minutes")


@register_filter("no_earnings_3d")
def _no_earnings(bars: DataFrame, context: dict) -> DataFrame | None:
    earnings = context.get("earnings")
    return None if earnings is None else clear_of_earnings(bars, earnings, 3, 0)


def signals(features: DataFrame, long: Column | None = None, short: Column | None = None, long_exit: Column | None = None, short_exit: Column | None = None, filters: tuple[str, ...] = (), context: dict | None = None, atr_period: int = 14) -> tuple[DataFrame, list[str]]:
    """(bars with long_entry, short_entry, long_exit, short_exit and atr; warnings): entries are rules that all filters allow.

    A missing rule is never true, a missing value in one is false. A filter without its calendar lets everything
    through and gives a warning, once.
    """
    never = F.lit(False)
    d = f.atr(features, atr_period, "atr")
    yes = lambda rule: never if rule is None else F.coalesce(rule, never)
    d = d.withColumns({"long_entry": yes(long), "short_entry": yes(short), "long_exit": yes(long_exit), "short_exit": yes(short_exit)})
    warnings: list[str] = []
    for name in filters:
        allowed = FILTERS[name](features, context or {})
        if allowed is None:
            warnings.append(f"{name}: no calendar, filter inactive")
            continue
        keys = allowed.select("symbol", "tf", "ts", F.lit(True).alias("__allowed")).distinct()
        d = d.join(keys, ["symbol", "tf", "ts"], "left").withColumn("__allowed", F.coalesce("__allowed", never))
        d = d.withColumns({c: F.col(c) & F.col("__allowed") for c in ("long_entry", "short_entry")}).drop("__allowed")
    return d, list(dict.fromkeys(warnings))


# ---- parameters
def axis(values: list, points: int = 4) -> Column:
    """The values of a search axis: two numbers are the ends of ``points`` even steps (whole numbers stay whole, without repeats), a longer list is itself."""
    if len(values) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        lo, hi = values
        steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + (F.lit(float(hi)) - lo) * i / max(points - 1, 1))
        if all(isinstance(v, int) for v in values):
            return F.array_sort(F.array_distinct(F.transform(steps, lambda v: F.bround(v).cast("double"))))
        return F.transform(steps, lambda v: F.bround(v, 4))
    return F.array(*[F.lit(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in values])


def param_grid(spark: SparkSession, space: dict[str, list], points: int = 4, max_trials: int = 64, seed: int = 0) -> DataFrame:
    """(param_id, a column for each axis): all combinations, or ``max_trials`` of them drawn by md5 of ``seed:param_id``.

    Ids count the combinations with the last axis fastest. An empty space is one set without columns.
    """
    rows = spark.range(1).select(F.lit(0).cast("long").alias("param_id"))
    for name, values in space.items():
        rows = rows.select("*", F.posexplode(axis(values, points)).alias("__at", name), F.size(axis(values, points)).alias("__n"))
        rows = rows.withColumn("param_id", F.col("param_id") * F.col("__n") + F.col("__at")).drop("__at", "__n")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("param_id").cast("string")).cast("binary"))
    return rows.orderBy(draw, "param_id").limit(max_trials)


def with_params(spec: dict, params: dict) -> dict:
    """A copy of ``spec`` in which a bare key sets an exit rule and a dotted key a nested value."""
    paths = [(tuple(k.split(".")) if "." in k else ("exit", k), v) for k, v in params.items()]

    def placed(node, path, value):
        return {**(node or {}), path[0]: value if len(path) == 1 else placed((node or {}).get(path[0]), path[1:], value)}

    return reduce(lambda s, x: placed(s, *x), paths, spec)


def chosen(axis_name: str, by_value: dict[float, str]) -> Column:
    """The feature column that belongs to a row's value of an axis; one column is computed for each distinct value, not for each set."""
    return F.coalesce(*[F.when(F.col(f"`{axis_name}`") == v, F.col(c)) for v, c in by_value.items()])


# ---- all parameter sets on all folds
def windows(spans: DataFrame) -> DataFrame:
    """(fold, phase, start, end) of folds: their training and their test span."""
    both = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end")) for p in ("train", "test")])
    return spans.select("fold", F.explode(both).alias("w")).select("fold", "w.*")


def trades_on_windows(signals: DataFrame, grid: DataFrame, spans: DataFrame, long: Column, short: Column, rule: trades.ExitRule) -> DataFrame:
    """Trades of every parameter set within every window, in one job: (param_id, fold, phase) and the columns of trades.run.

    ``long`` and ``short`` are rules over bar columns and the grid's; the fields of ``rule`` may be Columns of the grid. Only
    bars on which a set enters are kept for it. A window's trades enter after a signal in it, on a bar in it, and
    end with its last bar. The grid (at most its max_trials rows) and the windows (two a fold) are broadcast.
    """
    keys = ("param_id", "fold", "phase")
    span = F.broadcast(windows(spans))
    bars = signals.withColumn("next_ts", F.lead("ts").over(f.W())).withColumn("next_open", F.lead("open").over(f.W())).withColumn("rn", F.row_number().over(f.W()))
    never = F.lit(False)
    asked = bars.crossJoin(F.broadcast(grid)).withColumn("long_entry", F.coalesce(long, never)).withColumn("short_entry", F.coalesce(short, never))
    asked = asked.where(F.col("long_entry") != F.col("short_entry"))
    placed = asked.join(span, (F.col("ts") >= F.col("start")) & (F.col("next_ts") < F.col("end")))
    entries = trades.priced(placed, rule, (*keys, "end"))
    walked = bars.withColumnRenamed("rn", "j").select("symbol", "tf", "j", "ts", "open", "high", "low", "close", "long_exit", "short_exit", "next_ts")
    steps = trades.steps(entries, rule).join(walked, ["symbol", "tf", "j"])
    path = steps.where("ts < end").withColumn("last", F.col("next_ts").isNull() | (F.col("next_ts") >= F.col("end")))
    return trades.one_at_a_time(trades.outcomes(path, rule, keys), keys)


def window_scores(made: DataFrame, timeline: DataFrame, grid: DataFrame, spans: DataFrame, equity: float = 100_000.0) -> DataFrame:
    """(param_id, fold, phase, n_days, n_trades, net_pnl, sharpe): per-period Sharpe of a window's daily results over equity.

    Days are the distinct dates of the timeline in the window; those without an exit count as zero, through the count alone.
    """
    span = windows(spans)
    days = timeline.select(F.to_date("ts").alias("d"), "ts").join(F.broadcast(span), (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    days = days.groupBy("fold", "phase").agg(F.count_distinct("d").alias("n_days"))
    daily = made.groupBy("param_id", "fold", "phase", F.to_date("exit_ts").alias("d")).agg((F.sum("net_pnl") / equity).alias("ret"), F.count("*").alias("k"))
    sums = daily.groupBy("param_id", "fold", "phase").agg(F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"), F.sum("k").alias("n_trades"))
    every = grid.select("param_id").crossJoin(F.broadcast(days))
    got = every.join(sums, ["param_id", "fold", "phase"], "left").fillna(0, ["s", "q", "n_trades"])
    n, s, q = F.col("n_days"), F.col("s"), F.col("q")
    sd = F.sqrt(F.greatest(F.try_divide(q - s * s / n, n - 1), F.lit(0.0)))
    sharpe = F.when((n > 1) & (sd > 1e-12), s / n / sd).otherwise(0.0)
    return got.select("param_id", "fold", "phase", "n_days", "n_trades", (s * equity).alias("net_pnl"), sharpe.alias("sharpe"))


def choose(scores: DataFrame, min_trades: int = 10) -> DataFrame:
    """Each fold's set with the best training Sharpe (sets with enough trades first, then the smaller id) and what it did in the test."""
    order = Window.partitionBy("fold").orderBy((F.col("n_trades") >= min_trades).desc(), F.col("sharpe").desc(), "param_id")
    best = scores.where("phase = 'train'").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    test = scores.where("phase = 'test'").select("param_id", "fold", F.col("n_trades").alias("test_trades"), F.col("sharpe").alias("test_sharpe"), F.col("net_pnl").alias("test_pnl"))
    return best.select("fold", "param_id", F.col("n_trades").alias("train_trades"), F.col("sharpe").alias("train_sharpe")).join(test, ["fold", "param_id"])
