"""Review of open positions against the market: which to close, reduce, protect or hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.normal import normal_cdf


@dataclass
class ReviewPolicy:
    """The usual limits of a review."""

    stock_hours: float = 720.0
    forex_hours: float = 240.0
    stale_after: float = 0.5
    stale_r: float = 0.25
    least_target_chance: float = 0.10
    chance_in_last: float = 0.3
    breakeven_r: float | None = 1.0
    trail_atr: float | None = None
    rollover_bars: float | None = 1.0
    event_action: str = "close"
    event_hours: float = 24.0
    reduce_fraction: float = 0.5


def policy_of(asset_class: Column) -> Column:
    """struct<rollover, event_action> usual for an asset class: stocks close before events, pairs watch the rollover."""
    return F.struct((asset_class == "forex").alias("rollover"), F.lit("close").alias("event_action"))


def touch_probability(distance: Column, sigma: Column, bars: Column) -> Column:
    """Chance that a driftless walk touches a level ``distance`` away within ``bars`` bars."""
    live = (sigma > 0) & (bars > 0)
    reach = F.when(live, sigma) * F.sqrt(F.when(live, bars))
    chance = F.least(F.lit(1.0), 2.0 * (1.0 - normal_cdf(distance / reach)))
    return F.when(distance <= 0, 1.0).when(live, chance).otherwise(0.0)


def r_multiple(direction: Column, price: Column, entry: Column, risk: Column) -> Column:
    return F.coalesce(F.try_divide(direction * (price - entry), risk), F.lit(0.0))


def tighter(direction: Column, stop: Column, other: Column) -> Column:
    return F.when(direction > 0, F.greatest(stop, other)).otherwise(F.least(stop, other))


def review(book: DataFrame, policy: ReviewPolicy | None = None) -> DataFrame:
    """``book`` with ``actions``, array<struct<kind, why, price, fraction>>: what to do with each position.

    Columns: asset_class, direction, qty, usd (dollars per unit of price), entry_time, entry, stop, target, risk (price
    distance), max_bars, bars_held, best, reduced; and of the market time, price, atr, bar_hours, cut_time,
    cut_cost, event_time. The first rule that closes wins; a reduction and a moved stop can come
    together. A position without a price is held for want of a fresh price. Null events, cuts and
    ``best`` are absent ones.
    """
    p = policy or ReviewPolicy()
    c = F.col
    hours = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9
    remaining = c("max_bars") - c("bars_held")
    now = r_multiple(c("direction"), c("price"), c("entry"), c("risk"))
    sigma = F.when(c("atr") > 0, c("atr") / 1.25).otherwise(0.0)
    up, down = c("direction") * (c("target") - c("price")), c("direction") * (c("price") - c("stop"))
    reach, fall = touch_probability(up, sigma, remaining), touch_probability(down, sigma, remaining)
    gain = F.coalesce(F.try_divide(reach * up - fall * down, reach + fall), F.lit(0.0)) * c("qty") * c("usd")
    hard = F.when(c("asset_class") == "stocks", p.stock_hours).when(c("asset_class") == "forex", p.forex_hours)
    to_event = hours(c("event_time"), c("time"))
    due = F.coalesce((to_event >= 0) & (to_event <= p.event_hours), F.lit(False))
    act = lambda kind, why, price=None, fraction=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(why).alias("why"), (F.lit(None) if price is None else price).cast("double").alias("price"), F.lit(fraction).cast("double").alias("fraction")
    )
    close = lambda why: F.array(act("close", why))
    at_cut = F.lit(False)
    if p.rollover_bars is not None:
        at_cut = F.coalesce((c("cut_cost") > 0) & (hours(c("cut_time"), c("time")) / c("bar_hours") <= p.rollover_bars) & (gain < c("cut_cost")), F.lit(False))
    stop = c("stop")
    if p.breakeven_r is not None:
        stop = F.when(now >= p.breakeven_r, tighter(c("direction"), stop, c("entry"))).otherwise(stop)
    if p.trail_atr is not None:
        trail = F.coalesce("best", "price") - c("direction") * p.trail_atr * c("atr")
        stop = F.when((c("atr") > 0) & (now > 0), tighter(c("direction"), stop, trail)).otherwise(stop)
    soft = F.array_compact(F.array(
        F.when(due & F.lit(p.event_action == "reduce") & ~F.coalesce("reduced", F.lit(False)), act("reduce", "event", fraction=p.reduce_fraction)),
        F.when(stop != c("stop"), act("move_stop", "protect", price=stop)),
    ))
    actions = (
        F.when(c("price").isNull(), F.array(act("hold", "no fresh price")))
        .when(remaining <= 0, close("time limit")).when(hours(c("time"), c("entry_time")) >= hard, close("hard ceiling"))
        .when((c("bars_held") >= p.stale_after * c("max_bars")) & (F.abs(now) < p.stale_r), close("stale"))
        .when((remaining <= p.chance_in_last * c("max_bars")) & (reach < p.least_target_chance), close("target unlikely"))
        .when(at_cut, close("rollover")).when(due & F.lit(p.event_action == "close"), close("event"))
        .when(F.size(soft) > 0, soft).otherwise(F.array(act("hold", "within plan")))
    )
    return book.withColumn("actions", actions)


def review_book(positions: DataFrame, snapshots: DataFrame, policy: ReviewPolicy | None = None) -> DataFrame:
    """Every open position with the actions for its symbol's market snapshot; one without a snapshot is held."""
    return review(positions.join(snapshots, "symbol", "left"), policy)
