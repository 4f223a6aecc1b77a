"""Swing pivots of prices and the patterns they form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint
from tapeworks.operators.align import asof
from tapeworks.operators.features import W, atr

KEYS = ["symbol", "tf"]
#: Bars that one call of the scan walks; a longer series is cut in blocks of so many.
BLOCK = 20_000
_STATE = "struct<side:int,at:bigint,high:double,low:double>"
_PIVOT = "struct<at_rn:bigint,confirmed_rn:bigint,price:double,kind:int>"


def swing_scan(bars: list[dict], state: dict, k: float) -> tuple[list[dict], dict]:
    """Pivots confirmed in ``bars`` (rn, high, low, atr in order) from the state before them, and the state after.

    The state is the direction of the swing (0 before the first) and its extreme bar. On an
    upward swing the extreme is the highest high; a low that lies k ATR under it confirms a pivot and turns
    the swing. A downward swing is the same with prices negated. Bars without ATR restart the extreme.
    """
    found: list[dict] = []
    side, at, high, low = state["side"], state["at"], state["high"], state["low"]
    for bar in bars:
        reach = None if bar["atr"] is None or math.isnan(bar["atr"]) else k * bar["atr"]
        up, down = bar["high"], bar["low"]
        if reach is None or at is None:
            turn = side
        elif side == 0:
            turn = 1 if up - low > reach else -1 if high - down > reach else 0
            if turn == 0:
                continue
        else:
            edge, front, back = (high, up, down) if side > 0 else (-low, -down, -up)
            if front >= edge:
                turn = side
            elif edge - back >= reach:
                found.append({"at_rn": at, "confirmed_rn": bar["rn"], "price": side * edge, "kind": side})
                turn = -side
            else:
                continue
        side, at, high, low = turn, bar["rn"], up, down
    return found, {"side": side, "at": at, "high": high, "low": low}


def zigzag_pivots(bars: DataFrame, k_atr: float = 2.0, atr_period: int = 14) -> DataFrame:
    """(symbol, tf, at_rn, confirmed_rn, price, kind): swing highs (1) and lows (-1) and the bar that confirmed each.

    Rows are numbered from 1 by time. Each symbol's bars lie in blocks. A block is walked from a
    guessed state; where the block before it ends in another state, it is walked again from that one,
    until all agree. States forget their past within a few swings, so two or three rounds do
    at any length, and no series is walked by one task as a whole.
    """
    numbered = atr(bars, atr_period, "__atr").withColumn("rn", F.row_number().over(W()).cast("long"))
    block = F.floor((F.col("rn") - 1) / BLOCK)
    bar = F.struct("rn", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"), F.col("__atr").alias("atr"))
    blocks = checkpoint(numbered.groupBy(*KEYS, block.alias("block")).agg(F.array_sort(F.collect_list(bar)).alias("bars")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                symbol, tf, number, some, before = (c[0].as_py() for c in row.columns)
                found, after = swing_scan(some, before, k_atr)
                kinds = [row.schema.field(c).type for c in range(3)]
                out = [[symbol], [tf], [number], [before], [after], [found]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [*kinds, state, state, pivots])], names=[*KEYS, "block", "before", "after", "pivots"])

    state = pa.struct([("side", pa.int32()), ("at", pa.int64()), ("high", pa.float64()), ("low", pa.float64())])
    pivots = pa.list_(pa.struct([("at_rn", pa.int64()), ("confirmed_rn", pa.int64()), ("price", pa.float64()), ("kind", pa.int32())]))
    schema = f"symbol string, tf string, block bigint, before {_STATE}, after {_STATE}, pivots array<{_PIVOT}>"
    start = F.struct(F.lit(0).alias("side"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"))
    done = checkpoint(blocks.select(*KEYS, "block", "bars", start.cast(_STATE).alias("before")).mapInArrow(walk, schema))
    order = Window.partitionBy(*KEYS).orderBy("block")
    while True:
        linked = done.withColumn("want", F.coalesce(F.lag("after").over(order), start.cast(_STATE)))
        stale = linked.where(~F.col("want").eqNullSafe(F.col("before"))).select(*KEYS, "block", F.col("want").alias("before"))
        if stale.isEmpty():
            break
        again = blocks.join(stale, [*KEYS, "block"]).select(*KEYS, "block", "bars", "before").mapInArrow(walk, schema)
        done = checkpoint(done.join(stale.select(*KEYS, "block"), [*KEYS, "block"], "left_anti").unionByName(again))
    return done.select(*KEYS, F.explode("pivots").alias("p")).select(*KEYS, "p.*")


def pivot_levels(bars: DataFrame, pivots: DataFrame, kind: int, nth: int = 0, name: str = "level") -> DataFrame:
    """``bars`` (with rn) and the price of the nth last pivot of a kind that is confirmed at each bar; null without one."""
    order = Window.partitionBy(*KEYS).orderBy("confirmed_rn")
    known = pivots.where(F.col("kind") == kind).withColumn("price", F.lag("price", nth).over(order) if nth else F.col("price"))
    return asof(bars, known, KEYS, "rn", "confirmed_rn", ["price"], "__level").withColumn(name, F.col("__level.price")).drop("__level")


def double_patterns(bars: DataFrame, pivots: DataFrame, tolerance_atr: float = 0.5, max_bars: int = 60) -> DataFrame:
    """(symbol, tf, rn, direction): bars whose close leaves a double bottom upwards (1) or a double top downwards (-1).

    ``bars`` have rn and atr. Two pivots of a kind at most ``max_bars`` apart and within ``tolerance_atr``
    ATR of each other arm the price of the pivot between them, for ``max_bars`` bars from the confirmation
    on; a close past the outer one of the two ends it, also on the bar that would fire. Of
    patterns that fire on one bar the one armed last counts. Each pattern meets its bars by an equi-join on their numbers.
    """
    order = Window.partitionBy(*KEYS).orderBy("confirmed_rn")
    past = lambda c, n: F.lag(c, n).over(order)
    three = pivots.select(*KEYS, "confirmed_rn", "kind", "price", "at_rn", past("price", 2).alias("first"), past("at_rn", 2).alias("first_at"), past("price", 1).alias("neck"), past("kind", 2).alias("kind2"), past("kind", 1).alias("kind1"))
    size = bars.select(*KEYS, F.col("rn").alias("confirmed_rn"), F.col("atr").alias("__atr"))
    armed = three.join(size, [*KEYS, "confirmed_rn"]).where(
        (F.col("kind") == F.col("kind2")) & (F.col("kind") != F.col("kind1")) & (F.col("at_rn") - F.col("first_at") <= max_bars) & (F.abs(F.col("price") - F.col("first")) <= tolerance_atr * F.col("__atr"))
    )
    side = -F.col("kind")
    outer = side * F.least(side * F.col("first"), side * F.col("price"))
    armed = armed.select(*KEYS, "confirmed_rn", side.alias("side"), "neck", outer.alias("outer"))
    steps = armed.withColumn("rn", F.explode(F.sequence("confirmed_rn", F.col("confirmed_rn") + max_bars - 1)))
    met = steps.join(bars.select(*KEYS, "rn", "close"), [*KEYS, "rn"])
    s = F.col("side")
    event = F.when(s * F.col("close") < s * F.col("outer"), 0).when(s * F.col("close") > s * F.col("neck"), s)
    first = met.withColumn("event", event).where("event is not null").groupBy(*KEYS, "confirmed_rn").agg(F.min("rn").alias("rn"), F.min_by("event", "rn").alias("event"))
    return first.where("event <> 0").groupBy(*KEYS, "rn").agg(F.max_by("event", "confirmed_rn").alias("direction"))


def double_top_bottom(bars: DataFrame, k_atr: float = 2.0, tolerance_atr: float = 0.5, max_bars: int = 60) -> DataFrame:
    """``bars`` with ``rn`` and ``double``: 1 or -1 where a double bottom or top completes, else 0."""
    numbered = atr(bars, 14, "atr").withColumn("rn", F.row_number().over(W()).cast("long"))
    fired = double_patterns(numbered, zigzag_pivots(bars, k_atr), tolerance_atr, max_bars)
    return numbered.join(fired, [*KEYS, "rn"], "left").withColumn("double", F.coalesce("direction", F.lit(0))).drop("direction", "atr")
