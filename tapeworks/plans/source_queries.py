"""Queries of landed feeds, session dates and rules at levels, and their SQL; also that of the older risk split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import features as f
from tapeworks.plans.plan_queries import _split
from tapeworks.plans.queries import D1, H1, RET, W, _full, _phi, _r
from tapeworks.plans.strategy_queries import BARS
from tapeworks.sources import bars as b


def candle_json(spark, sf):
    """Hourly candles landed as JSON, some of them not complete."""
    h = b.hourly_bars(spark, sf)
    mid = F.struct(*[F.col(c).cast("string").alias(c[0]) for c in b.PRICES])
    body = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), (F.hour("ts") % 7 != 0).alias("complete"), "volume", mid.alias("mid"))
    return _r(b.candles_from_json(h.select("symbol", "tf", F.to_json(body).alias("payload"))), "volume")


def epoch_bars(spark, sf):
    """Hourly aggregates landed with epoch milliseconds and short names."""
    h = b.hourly_bars(spark, sf)
    return _r(b.bars_from_epochs(h.select("symbol", "tf", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), *[F.col(c).alias(c[0]) for c in (*b.PRICES, "volume")])), "volume")


def session_dates(spark, sf):
    """Twelve-hourly closes keyed by New York date, the last of each date."""
    h = b.hourly_bars(spark, sf).where(F.hour("ts") % 12 == 3)
    return b.session_dates(h).select("symbol", F.col("d").cast("string").alias("d"), "open", "close")


def rules_at_levels(spark, sf):
    d = f.atr(b.daily_bars(spark, sf)).withColumns({"low20": f.lowest("low", 20), "mean5": f.rolling_mean("close", 5), "top3": f.rolling_max("high", 3), "bottom3": f.rolling_min("low", 3)})
    return d.select(
        "symbol", "ts", f.cross_below("close", "mean5").alias("under"), f.cross_below("close", 100.0).alias("under100"), f.falling("close", 2).alias("falls"), f.eq("high", "top3").alias("at_top"),
        f.ne("low", "bottom3").alias("off_bottom"), f.ge("close", "mean5").alias("above"), f.zone_touch("low20", "atr", 0.4).alias("touch"), f.truthy(F.col("close") - F.col("open")).alias("moved"),
    )


QUERIES = {q.__name__: q for q in (candle_json, epoch_bars, session_dates, rules_at_levels)}

_NO = "coalesce({}, false)"
ORACLES = {
    "candle_json": f"with {H1} select symbol, tf, ts, open, high, low, close, round(volume, 6) volume from hours where hour(ts) % 7 <> 0",
    "epoch_bars": f"with {H1} select symbol, tf, ts, open, high, low, close, round(volume, 6) volume from hours",
    "session_dates": f"""with {H1}, n as (select *, cast(timezone('America/New_York', timezone('UTC', ts)) as date) d from hours where hour(ts) % 12 = 3)
select symbol, cast(d as varchar) d, max_by(open, ts) as open, max_by(close, ts) as close from n group by 1, 2""",
    "rules_at_levels": f"""with recursive {BARS}, lv as (select *, {_full('min', 20, 1, 'low')} low20, {_full('avg', 5, 0, 'close')} mean5, {_full('max', 3, 0, 'high')} top3, {_full('min', 3, 0, 'low')} bottom3, lag(close, 2) over ({W}) c2 from y),
pr as (select *, lag(mean5) over ({W}) pm from lv)
select symbol, ts, {_NO.format('close < mean5')} and {_NO.format('pc >= pm')} under, close < 100 and {_NO.format('pc >= 100')} under100, {_NO.format('close < c2')} falls, {_NO.format('high = top3')} at_top, coalesce(low <> bottom3, true) off_bottom,
{_NO.format('close >= mean5')} above, {_NO.format('low <= low20 + 0.4e0*atr and high >= low20 - 0.4e0*atr')} touch, close <> open moved from pr""",
    "risk_allocation": f"""with {D1}, {RET}, rw as (select *, pow(0.5, (row_number() over (partition by strategy order by d desc) - 1)/60e0) w from ret), rm as (select strategy, sum(w*ret)/sum(w) m from rw group by 1),
re as (select strategy, any_value(m)/sqrt(sum(w*(ret - m)*(ret - m))/sum(w))*sqrt(252) + 2 recent from rw join rm using (strategy) group by 1),
g as (select strategy, count(*) n, avg(ret) m, stddev_samp(ret) sd, skewness(ret) sk, kurtosis(ret) ku from ret group by 1), q as (select *, m/sd sr, sqrt(1 - sk*m/sd + (ku + 2)/4*(m/sd)*(m/sd)) den from g), z as (select strategy, (sr - sqrt(0.001)*1.5745982)*sqrt(n - 1)/den x1 from q),
lb as (select ts, case when close >= open then 'up' else 'down' end as label from bars where symbol = 'NO'), xl as (select ret.*, lb.label from ret asof left join lb on ret.d >= lb.ts),
gf as (select strategy, avg(ret)/stddev_samp(ret)*sqrt(252) o, avg(ret) filter (where label = 'up')/stddev_samp(ret) filter (where label = 'up')*sqrt(252) w, count(*) filter (where label = 'up') k from xl group by 1),
bo as (select re.strategy, cast(re.strategy[2] as int) x, case when cast(re.strategy[2] as int) % 3 = 0 then 'live' else 'validated' end status, recent, {_phi('x1')} dsr, case when k < 5 then o else k/(k + 120e0)*w + (1 - k/(k + 120e0))*o end fit,
  cast(re.strategy[2] as int)*0.7 kelly_pct, 2.5 cap_pct, cast(cast(re.strategy[2] as int) % 4 as varchar) as cluster, 1 as one from re join z using (strategy) join gf using (strategy)),
{_split('bo', 'one').replace('9*0.9 budget', '9e0 budget')}
select strategy, round(score0, 4) score, round(cap0, 4) as cap, risk_pct, excluded from al""",
}
