"""Queries of pivots, patterns and regimes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import pivots as p
from tapeworks.operators import selection as s
from tapeworks.operators.align import daily_labels
from tapeworks.operators.features import W as by_time
from tapeworks.operators.regime import classify_regime
from tapeworks.plans.queries import D1, MACD_ADX, RET, W, _r, _returns
from tapeworks.sources import bars as b


def _numbered(bars):
    return bars.withColumn("rn", F.row_number().over(by_time()).cast("long"))


def pivots(spark, sf):
    return p.zigzag_pivots(b.daily_bars(spark, sf)).drop("tf")


def pivot_levels(spark, sf):
    d = b.daily_bars(spark, sf)
    found, out = p.zigzag_pivots(d), _numbered(d)
    for name, kind, nth in (("high", 1, 0), ("high_before", 1, 1), ("low", -1, 0), ("low_third", -1, 2)):
        out = p.pivot_levels(out, found, kind, nth, f"pivot_{name}")
    return out.select("symbol", "ts", "pivot_high", "pivot_high_before", "pivot_low", "pivot_low_third")


def double_top_bottom(spark, sf):
    return p.double_top_bottom(b.daily_bars(spark, sf), tolerance_atr=1.5).select("symbol", "ts", "double")


def regime_labels(spark, sf):
    return _r(classify_regime(b.daily_bars(spark, sf)).select("symbol", "ts", "trend", "vol", "label", "adx", "atr_pct", "vol_pct"), "adx", "atr_pct", "vol_pct")


def regime_fit_by_label(spark, sf):
    """How the strategies did under the labels of one market, shrunk to their overall Sharpe."""
    daily = daily_labels(classify_regime(b.daily_bars(spark, sf)).where("symbol = 'NO'")).select(F.col("d").cast("timestamp").alias("d"), "label")
    return _r(s.regime_fit(_returns(spark, sf), daily, "range/normal"), "fit")


QUERIES = {q.__name__: q for q in (pivots, pivot_levels, double_top_bottom, regime_labels, regime_fit_by_label)}

#: Average range and swing walked together, one bar at a time; px is the price of a pivot confirmed at the bar.
ZIGZAG = f"""{D1}, a as (select *, row_number() over ({W}) rn, lag(close) over ({W}) pc from bars),
x as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end tr from a),
av as (select symbol, rn, 0e0 st, null::double atr from x where rn = 1
  union all select x.symbol, x.rn, r.st + x.tr, case when x.rn = 15 then (r.st + x.tr)/14 when x.rn > 15 then (r.atr*13 + x.tr)/14 end from av r join x on x.symbol = r.symbol and x.rn = r.rn + 1),
y as materialized (select x.*, atr from x join av using (symbol, rn)),
z as (select symbol, rn, 0 dir, rn ext, high eh, low el, null::bigint pat, null::double px, null::int pk from y where rn = 1
  union all
  select symbol, rn, case act when 'keep' then dir when 'grow' then dir when 'reset' then dir when 'up' then 1 when 'down' then -1 else -dir end,
    case act when 'keep' then ext else rn end, case act when 'keep' then eh else high end, case act when 'keep' then el else low end,
    case act when 'turn' then ext end, case act when 'turn' then case dir when 1 then eh else el end end, case act when 'turn' then dir end
  from (select y.symbol, y.rn, y.high, y.low, z.dir, z.ext, z.eh, z.el, case when y.atr is null then 'reset'
      when z.dir = 0 then case when y.high - z.el > 2*y.atr then 'up' when z.eh - y.low > 2*y.atr then 'down' else 'keep' end
      when z.dir = 1 then case when y.high >= z.eh then 'grow' when z.eh - y.low >= 2*y.atr then 'turn' else 'keep' end
      else case when y.low <= z.el then 'grow' when y.high - z.el >= 2*y.atr then 'turn' else 'keep' end end act
    from z join y on y.symbol = z.symbol and y.rn = z.rn + 1)),
pv as materialized (select symbol, pat at_rn, rn confirmed_rn, px price, pk kind from z where px is not null)"""
LEVEL = "(select max_by(price, confirmed_rn) from (select price, confirmed_rn from pn where pn.symbol = y.symbol and kind = {kind} and pn.back = (select count(*) from pv where pv.symbol = y.symbol and pv.kind = {kind} and pv.confirmed_rn <= y.rn) - {nth}))"
DOUBLE = f"""with recursive {ZIGZAG},
th as (select *, lag(price, 2) over w f, lag(at_rn, 2) over w fa, lag(price) over w neck, lag(kind, 2) over w k2 from pv window w as (partition by symbol order by confirmed_rn)),
ar as (select th.*, -kind side, case when kind = -1 then least(f, price) else greatest(f, price) end outer_ from th join y on y.symbol = th.symbol and y.rn = th.confirmed_rn
  where kind = k2 and at_rn - fa <= 60 and abs(price - f) <= 1.5*atr),
ev as (select ar.symbol, confirmed_rn, y.rn, side, case when (side = 1 and close < outer_) or (side = -1 and close > outer_) then 0 when (side = 1 and close > neck) or (side = -1 and close < neck) then side end e
  from ar join y on y.symbol = ar.symbol and y.rn >= confirmed_rn and y.rn < confirmed_rn + 60),
fi as (select symbol, confirmed_rn, min(rn) rn, min_by(e, rn) e from ev where e is not null group by 1, 2),
hit as (select symbol, rn, max_by(e, confirmed_rn) e from fi where e <> 0 group by 1, 2)
select y.symbol, ts, coalesce(e, 0) as double from y left join hit on hit.symbol = y.symbol and hit.rn = y.rn"""
REGIME = f"""{MACD_ADX.split('select x.symbol, x.ts, round')[0]},
av as (select symbol, rn, 0e0 st, null::double atr from x where rn = 1
  union all select x.symbol, x.rn, r.st + x.tr, case when x.rn = 15 then (r.st + x.tr)/14 when x.rn > 15 then (r.atr*13 + x.tr)/14 end from av r join x on x.symbol = r.symbol and x.rn = r.rn + 1),
g as materialized (select x.symbol, x.ts, x.rn, r2.adx, av.atr/x.close atr_pct from x join r2 using (symbol, rn) join av using (symbol, rn)),
k1 as (select g.symbol, g.rn, count(*) n, count(*) filter (where o.atr_pct < g.atr_pct) less, count(*) filter (where o.atr_pct = g.atr_pct) same
  from g join g o on o.symbol = g.symbol and o.rn between g.rn - 251 and g.rn and o.atr_pct is not null where g.atr_pct is not null group by 1, 2),
v as (select g.*, case when n >= 60 then (less + (same + 1)/2e0)/n end vol_pct from g left join k1 using (symbol, rn)),
l as (select *, case when adx is null or vol_pct is null then 'unknown' when adx >= 25 then 'trend' else 'range' end trend,
  case when adx is null or vol_pct is null then 'unknown' when vol_pct < 0.33 then 'low' when vol_pct > 0.67 then 'high' else 'normal' end vol from v)"""

ORACLES = {
    "pivots": f"with recursive {ZIGZAG} select * from pv",
    "pivot_levels": f"with recursive {ZIGZAG}, pn as materialized (select *, row_number() over (partition by symbol, kind order by confirmed_rn) back from pv) select y.symbol, y.ts, {LEVEL.format(kind=1, nth=0)} pivot_high, {LEVEL.format(kind=1, nth=1)} pivot_high_before, {LEVEL.format(kind=-1, nth=0)} pivot_low, {LEVEL.format(kind=-1, nth=2)} pivot_low_third from y",
    "double_top_bottom": DOUBLE,
    "regime_fit_by_label": f"""{REGIME}, {RET}, lb as (select ts, trend || '/' || vol as label from l where symbol = 'NO'),
j as (select ret.*, lb.label from ret asof left join lb on ret.d >= lb.ts),
sh as (select strategy, avg(ret)/stddev_samp(ret)*sqrt(252) o, avg(ret) filter (where label = 'range/normal')/nullif(stddev_samp(ret) filter (where label = 'range/normal'), 0)*sqrt(252) w, count(*) filter (where label = 'range/normal') k from j group by 1)
select strategy, round(case when k < 5 then o else k/(k + 120e0)*w + (1 - k/(k + 120e0))*o end, 6) fit from sh""",
    "regime_labels": f"{REGIME} select symbol, ts, trend, vol, trend || '/' || vol as label, round(adx, 6) adx, round(atr_pct, 6) atr_pct, round(vol_pct, 6) vol_pct from l",
}
