"""Queries of the trading desk: costs, position review, feed comparison, gates; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import costs as k
from tapeworks.operators import features as f
from tapeworks.operators import feeds, review
from tapeworks.operators import metrics as m
from tapeworks.operators.align import asof_filled, clear_of_earnings, next_event
from tapeworks.plans.queries import D1, H1, RET, TRD, W, _phi, _r, _returns, _trades
from tapeworks.sources import bars as b

UNI = """
ut as (select 'U' || lpad(cast(l_partkey % 25 as varchar), 2, '0') symbol, l_shipdate ts, cast(l_quantity as bigint) q,
    cast(round(l_discount*100) as bigint) - 5 st, row_number() over (partition by l_partkey % 25
      order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) rn from lineitem),
up as (select *, ((sum(st) over (partition by symbol order by rn rows between unbounded preceding and current row)) % 400 + 400) % 400 mm from ut),
uq as (select *, 50 + abs(mm - 200)*0.5e0 price from up),
uni as (select symbol, 'D1' tf, ts, min_by(price, rn) open, max(price) high, min(price) low, max_by(price, rn) as close, cast(sum(q) as double) volume
    from uq group by symbol, ts)
"""
RATES = """
rates as (select case event_type when 'click' then 'EUR' when 'view' then 'GBP' when 'purchase' then 'AUD' when 'error' then 'USD' else 'JPY' end ccy,
    cast(date_trunc('week', ts) as date) d, (count(*) % 50)/10e0/100 rate from events group by 1, 2)
"""


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    ccy = F.create_map(*[F.lit(x) for x in ("click", "EUR", "view", "GBP", "purchase", "AUD", "error", "USD", "signup", "JPY")])
    e = spark.read.parquet(f"{sf}/events.parquet")
    weeks = e.groupBy(ccy[F.col("event_type")].alias("ccy"), F.to_date(F.date_trunc("week", "ts")).alias("d"))
    return k.policy_rates(weeks.agg((F.count("*") % 50 / F.lit(10.0)).alias("rate")))


def bars_universe(spark, sf):
    return b.universe_bars(spark, sf)


def bar_timeline(spark, sf):
    return b.timeline(b.daily_bars(spark, sf).unionByName(b.universe_bars(spark, sf)))


def financing_costs(spark, sf):
    h = b.hourly_bars(spark, sf).select("symbol", "ts", "close", (F.col("ts") + F.expr("interval 53 hours")).alias("t1"), F.when(F.hour("ts") % 2 == 0, 1).otherwise(-1).alias("side"))
    d = k.annual_rates(h, _rates(spark, sf), "symbol", "side", "t1")
    quotes = b.hourly_bars(spark, sf).where(F.col("symbol").endswith("_USD")).select(F.split("symbol", "_")[0].alias("ccy"), "ts", F.col("close").alias("usd"))
    d = k.usd_per_unit(d.withColumn("base", F.split("symbol", "_")[0]), quotes, "base", "t1", "base_usd")
    days = k.rollover_days(F.col("ts"), F.col("t1"))
    cost = k.fx_financing(F.lit(10000), F.col("base_usd"), F.col("annual_rate"), days)
    return _r(d.select("symbol", "ts", "annual_rate", "base_usd", days.alias("days"), cost.alias("financing"), k.fx_fees()["platform"].alias("fees")), "annual_rate", "financing")


def unknown_currency_report(spark, sf):
    h = b.hourly_bars(spark, sf).select(F.explode(F.split("symbol", "_")).alias("ccy"))
    return k.unknown_currencies(h, _rates(spark, sf).where("ccy <> 'JPY'"), "ccy")


def stock_holding_costs(spark, sf):
    d = b.daily_bars(spark, sf).withColumn("t1", F.col("ts") + F.expr("interval 3 days")).withColumn("side", F.when(F.day("ts") % 2 == 0, -1).otherwise(1))
    nights = k.overnight_days(F.col("ts"), F.col("t1"))
    own_rate = F.when(F.col("symbol").startswith("A"), 0.02).otherwise(k.BORROW)
    borrowed = F.when(F.day("ts") % 3 == 0, 5000.0).otherwise(0.0)
    paid = k.stock_holding(F.col("side"), F.lit(200), F.col("close"), nights, borrowed, own_rate)
    both = k.by_class(F.when(F.day("ts") % 5 == 0, "forex").otherwise("stocks"), k.stock_fill(F.col("close"), F.col("side"), F.when(F.col("symbol") == "NO", 4.0).otherwise(1.0)), F.col("close"))
    return _r(d.select("symbol", "ts", nights.alias("nights"), paid["borrow"].alias("borrow"), paid["margin_interest"].alias("margin_interest"), both.alias("fill")), "borrow", "margin_interest", "fill")


def _book(spark, sf):
    """Each seventh daily bar as a market snapshot with three positions entered 5, 20 and 40 bars before."""
    d = b.daily_bars(spark, sf).withColumn("rn", F.row_number().over(f.W())).withColumn("range", F.col("high") - F.col("low"))
    d = d.withColumn("mean_range", F.avg("range").over(f.W().rowsBetween(-13, 0)))
    ages = F.explode(F.array(F.lit(5), F.lit(20), F.lit(40))).alias("age")
    now = d.where("rn % 7 = 0 and rn > 40").select("symbol", "rn", F.col("ts").alias("time"), F.col("close").alias("price"), F.col("mean_range").alias("atr"), ages)
    start = d.select("symbol", F.col("rn").alias("rn0"), F.col("ts").alias("entry_time"), F.col("close").alias("entry"))
    p = now.withColumn("rn0", F.col("rn") - F.col("age")).join(start, ["symbol", "rn0"])
    side = F.when(F.col("rn") % 2 == 0, 1).otherwise(-1)
    return p.select(
        "symbol", "rn", "age", "time", F.when(F.col("rn") % 91 != 0, F.col("price")).alias("price"), "atr", F.lit(24.0).alias("bar_hours"), "entry_time", "entry",
        F.when(F.col("symbol").startswith("R"), "forex").otherwise("stocks").alias("asset_class"), side.alias("direction"), F.lit(100).alias("qty"), F.lit(1.0).alias("usd"),
        (F.col("entry") - side * 2).alias("stop"), (F.col("entry") + side * 4).alias("target"), F.lit(2.0).alias("risk"), F.lit(30).alias("max_bars"),
        (F.col("age") - 3).alias("bars_held"), F.lit(None).cast("double").alias("best"), (F.col("rn") % 3 == 0).alias("reduced"),
        (F.col("time") + F.expr("interval 21 hours")).alias("cut_time"), F.when(F.col("symbol").startswith("R"), 40.0).otherwise(0.0).alias("cut_cost"),
        F.when(F.col("rn") % 5 == 0, F.col("time") + F.expr("interval 10 hours")).alias("event_time"),
    )


def _actions(df):
    a = df.select("symbol", "rn", "age", F.explode("actions").alias("a"))
    return _r(a.select("symbol", "rn", "age", F.col("a.kind").alias("kind"), F.col("a.why").alias("why"), F.col("a.price").alias("price"), F.col("a.fraction").alias("fraction")), "price")


def position_review(spark, sf):
    return _actions(review.review(_book(spark, sf)))


def position_review_reducing(spark, sf):
    return _actions(review.review(_book(spark, sf), review.ReviewPolicy(event_action="reduce", trail_atr=2.0, rollover_bars=None)))


def touch_chances(spark, sf):
    d = b.daily_bars(spark, sf).withColumn("n", F.dayofyear("ts") % 9)
    return _r(d.select("symbol", "ts", review.touch_probability(F.col("high") - F.col("close"), (F.col("high") - F.col("low")) / 1.25, F.col("n")).alias("p"), review.r_multiple(F.lit(-1), F.col("close"), F.col("open"), F.col("high") - F.col("low")).alias("r")), "p", "r").withColumn("r", F.col("r") + 0.0)


def next_errors(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error' and value > 250").select(F.col("ts").alias("event_ts"))
    h = b.hourly_bars(spark, sf).select("symbol", "ts", (F.col("ts") + F.expr("interval 1 hour")).alias("end"))
    return next_event(h, e, "end", "event_ts", "next_event").select("symbol", "ts", "next_event")


def earnings_clear(spark, sf):
    d = b.daily_bars(spark, sf)
    first = d.groupBy("symbol", F.date_trunc("quarter", "ts").alias("q")).agg(F.to_date(F.min("ts")).alias("d"))
    return clear_of_earnings(d, first, 5, 1).select("symbol", "ts")


def masked_bars(spark, sf):
    h = b.hourly_bars(spark, sf)
    mask = b.resample(h, "D1").select("symbol", F.col("ts").alias("known"), (F.col("close") > F.col("open")).alias("tradable"))
    return asof_filled(h.select("symbol", "ts"), mask, ["symbol"], "ts", "known", "tradable", False)


def _feed_b(d):
    scale = 1 + ((F.day("ts") * 7 + F.month("ts") * 3) % 11 - 5) * 1e-4
    return d.where(F.day("ts") % 17 != 0).withColumns({c: F.col(c) * scale for c in ("open", "high", "low", "close")}).withColumn("volume", F.col("volume") * 0.03)


def feed_gaps(spark, sf):
    d = b.daily_bars(spark, sf)
    got = feeds.feed_verdict(feeds.feed_gaps(d, _feed_b(d)))
    figures = [c for c in got.columns if c.endswith(("_median", "_p95", "_max", "_cv"))]
    return _r(got.drop("trend_least", "candle_least"), *figures)


def feed_agreement(spark, sf):
    d = b.daily_bars(spark, sf)
    return feeds.signal_agreement(d, _feed_b(d))


def leverage_gates(spark, sf):
    t = m.trade_stats(_trades(spark, sf)).withColumn("x", F.substring("strategy", 2, 1).cast("int"))
    kinds = F.array(*[F.lit(x) for x in ("none", "positive", "validated", "arbitrage")])
    gate = m.leverage_gate(F.col("x") * F.col("x") / 500.0, F.get(kinds, F.col("x") % 4), F.lit(4.0))
    return _r(t.select("strategy", m.kelly_fraction(F.col("win_rate"), F.col("payoff")).alias("kelly_fraction"), m.drawdown_scale(F.col("x") / 20.0).alias("scale"), gate.alias("leverage")), "kelly_fraction", "scale")


def strategy_summary(spark, sf):
    s = m.summary(_returns(spark, sf), _trades(spark, sf))
    return _r(s.select("strategy", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "cagr", "total_return", "n_trades", "win_rate"), "cagr", "total_return", "win_rate")


QUERIES = {q.__name__: q for q in (
    bars_universe, bar_timeline, financing_costs, unknown_currency_report, stock_holding_costs, position_review, position_review_reducing, touch_chances,
    next_errors, earnings_clear, masked_bars, feed_gaps, feed_agreement, leverage_gates, strategy_summary,
)}

NY = "timezone('America/New_York', timezone('UTC', {}))"
BOOK = f"""
b0 as (select *, row_number() over ({W}) rn, avg(high - low) over ({W} rows between 13 preceding and current row) mr from bars),
b1 as (select n.symbol, n.rn, g.age, n.ts as "time", case when n.rn % 91 <> 0 then n.close end price, n.mr atr, e.ts entry_time, e.close entry,
    case when n.symbol like 'R%' then 'forex' else 'stocks' end asset_class, case when n.rn % 2 = 0 then 1 else -1 end direction, n.rn % 3 = 0 reduced,
    case when n.symbol like 'R%' then 40e0 else 0e0 end cut_cost, n.rn % 5 = 0 has_event
  from b0 n cross join (values (5), (20), (40)) g(age) join b0 e on e.symbol = n.symbol and e.rn = n.rn - g.age where n.rn % 7 = 0 and n.rn > 40),
b2 as (select *, entry - direction*2 stop, entry + direction*4 target, 30 - (age - 3) remaining, direction*(price - entry)/2 r, atr/1.25 sigma,
    (epoch("time") - epoch(entry_time))/3600 held from b1),
b3 as (select *, direction*(target - price) up, direction*(price - stop) down from b2),
b4 as (select *, up/(sigma*sqrt(greatest(remaining, 1))) zu, down/(sigma*sqrt(greatest(remaining, 1))) zd from b3),
b5 as (select *, case when up <= 0 then 1 when sigma > 0 and remaining > 0 then least(1, 2*(1 - {_phi('zu')})) else 0 end reach,
    case when down <= 0 then 1 when sigma > 0 and remaining > 0 then least(1, 2*(1 - {_phi('zd')})) else 0 end fall from b4),
b6 as (select *, case when reach + fall > 0 then (reach*up - fall*down)/(reach + fall)*100 else 0 end gain from b5)
"""
CLOSES = """case when price is null then 'no fresh price' when remaining <= 0 then 'time limit'
    when held >= case when asset_class = 'stocks' then 720 else 240 end then 'hard ceiling' when age - 3 >= 15 and abs(r) < 0.25 then 'stale'
    when remaining <= 9 and reach < 0.1 then 'target unlikely'"""
TIGHT = "case when direction > 0 then greatest({a}, {b}) else least({a}, {b}) end"

ORACLES = {
    "bars_universe": f"with {UNI} select * from uni",
    "bar_timeline": f"with {D1}, {UNI} select ts from bars union select ts from uni",
    "financing_costs": f"""with {H1}, {RATES}, x as (select symbol, ts, ts + interval 53 hours t1, case when hour(ts) % 2 = 0 then 1 else -1 end side,
    split_part(symbol, '_', 1) base, split_part(symbol, '_', 2) quote from hours),
fst as (select ccy, min_by(rate, d) first from rates group by ccy),
y as (select x.*, cast(t1 as date) td from x), rb as (select y.*, rates.rate br from y asof left join rates on rates.ccy = y.base and y.td >= rates.d),
rq as (select rb.*, rates.rate qr from rb asof left join rates on rates.ccy = rb.quote and rb.td >= rates.d),
qs as (select split_part(symbol, '_', 1) ccy, ts, close from hours where symbol like '%_USD'),
z as (select rq.*, coalesce(br, fb.first) - coalesce(qr, fq.first) gap from rq join fst fb on fb.ccy = base join fst fq on fq.ccy = quote),
u as (select z.*, qs.close cl from z asof left join qs on qs.ccy = z.base and z.t1 >= qs.ts),
v as (select *, side*gap - 0.025 ar, case when base = 'USD' then 1 else coalesce(cl, case base when 'EUR' then 1.10 when 'GBP' then 1.30 when 'AUD' then 0.66 end) end bu,
    (select coalesce(sum(case when dayofweek(c) = 5 then 3 when dayofweek(c) in (0, 6) then 0 else 1 end), 0)
      from (select unnest(generate_series(date_trunc('day', ts) - interval 1 day, date_trunc('day', t1) + interval 1 day, interval 1 day)) + interval 17 hours c)
      where timezone('UTC', timezone('America/New_York', c)) > ts and timezone('UTC', timezone('America/New_York', c)) <= t1) as days from u)
select symbol, ts, round(ar, 6) annual_rate, cast(bu as double) base_usd, cast(days as int) as days, round(-10000*bu*ar*days/365, 6) financing, 0e0 fees from v""",
    "unknown_currency_report": f"""with {H1}, {RATES}, c as (select unnest(string_split(symbol, '_')) ccy from hours)
select distinct ccy from c where ccy not in (select ccy from rates where ccy <> 'JPY')""",
    "stock_holding_costs": f"""with {D1}, x as (select *, cast({NY.format("ts + interval 3 days")} as date) - cast({NY.format("ts")} as date) nights from bars)
select symbol, ts, cast(nights as int) nights, round(case when day(ts) % 2 = 0 then 200*close*case when symbol like 'A%' then 0.02 else 0.005 end*nights/360 else 0 end, 6) borrow,
  round(case when day(ts) % 3 = 0 then 5000*0.068*nights/360 else 0 end, 6) margin_interest,
  round(case when day(ts) % 5 = 0 then close else close + case when day(ts) % 2 = 0 then -1 else 1 end*(case when symbol = 'NO' then 4 else 1 end + 2)/1e4*close end, 6) fill from x""",
    "position_review": f"""with {D1}, {BOOK}, c as (select *, {CLOSES} when cut_cost > 0 and gain < cut_cost and 21/24e0 <= 1 then 'rollover'
    when has_event then 'event' when r >= 1 and {TIGHT.format(a='stop', b='entry')} <> stop then 'protect' else 'within plan' end why from b6)
select symbol, rn, age, case why when 'no fresh price' then 'hold' when 'within plan' then 'hold' when 'protect' then 'move_stop' else 'close' end kind, why,
  round(case when why = 'protect' then entry end, 6) price, null::double fraction from c""",
    "position_review_reducing": f"""with {D1}, {BOOK}, s1 as (select *, case when r >= 1 then {TIGHT.format(a='stop', b='entry')} else stop end m1 from b6),
s2 as (select *, case when r > 0 and atr > 0 then {TIGHT.format(a='m1', b='(price - direction*2*atr)')} else m1 end m2 from s1), c as (select *, {CLOSES} end first from s2),
d as (select symbol, rn, age, case when first = 'no fresh price' then 'hold' else 'close' end kind, first why, null::double price, null::double fraction from c where first is not null
  union all select symbol, rn, age, 'reduce', 'event', null, 0.5 from c where first is null and has_event and not reduced
  union all select symbol, rn, age, 'move_stop', 'protect', m2, null from c where first is null and m2 <> stop
  union all select symbol, rn, age, 'hold', 'within plan', null, null from c where first is null and not (has_event and not reduced) and m2 = stop)
select symbol, rn, age, kind, why, round(price, 6) price, fraction from d""",
    "touch_chances": f"""with {D1}, x as (select *, high - close d, (high - low)/1.25 s, dayofyear(ts) % 9 n from bars), y as (select *, case when s > 0 and n > 0 then d/(s*sqrt(n)) end z from x)
select symbol, ts, round(case when d <= 0 then 1 when s > 0 and n > 0 then least(1, 2*(1 - {_phi('z')})) else 0 end, 6) p,
  round(case when high > low then -(close - open)/(high - low) else 0 end, 6) + 0e0 r from y""",
    "next_errors": f"""with {H1}, er as (select distinct ts from events where event_type = 'error' and value > 250)
select symbol, ts, (select min(er.ts) from er where er.ts >= h.ts + interval 1 hour) next_event from hours h""",
    "earnings_clear": f"""with {D1}, e as (select symbol, date_trunc('quarter', ts) q, cast(min(ts) as date) d from bars group by 1, 2)
select symbol, ts from bars b where not exists (select 1 from e where e.symbol = b.symbol and cast(b.ts as date) between e.d - 5 and e.d + 1)""",
    "masked_bars": f"""with {H1}, d as (select symbol, date_trunc('day', ts)::timestamp known, max_by(close, ts) > min_by(open, ts) up from hours group by 1, 2)
select h.symbol, h.ts, coalesce(d.up, false) tradable from hours h asof left join d on h.symbol = d.symbol and h.ts >= d.known""",
    "feed_gaps": f"""with {D1}, x as (select *, 1 + ((day(ts)*7 + month(ts)*3) % 11 - 5)*1e-4 sc, day(ts) % 17 <> 0 there from bars),
y as (select symbol, tf, there, case when there then abs(close*sc - close)/close*1e4 end cb, case when there then abs(high*sc - high)/close*1e4 end hb,
    case when there then abs(low*sc - low)/close*1e4 end lb, case when there then volume*0.03/nullif(volume, 0) end sh from x),
g as (select symbol, tf, count(*) filter (where there) compared, count(*) filter (where not there) missing, quantile_cont(cb, 0.5) close_median, quantile_cont(cb, 0.95) close_p95,
    quantile_cont(hb, 0.95) high_p95, quantile_cont(lb, 0.95) low_p95, max(cb) close_max, quantile_cont(sh, 0.5) share_median, stddev_samp(sh)/avg(sh) share_cv from y group by 1, 2)
select symbol, tf, compared, missing, round(close_median, 6) close_median, round(close_p95, 6) close_p95, round(high_p95, 6) high_p95, round(low_p95, 6) low_p95,
  round(close_max, 6) close_max, round(share_median, 6) share_median, round(share_cv, 6) share_cv, false skipped, close_median <= 5 and close_p95 <= 20 price_ok, share_cv <= 0.3 volume_ok,
  case when missing > 0 then missing || ' bars missing' else '' end notes from g""",
    "leverage_gates": f"""with {TRD}, g as (select strategy, avg(case when r > 0 then 1e0 else 0 end) p, cast(strategy[2] as int) x from tra group by strategy), y as (select *, x*x/500e0 ruin from g)
select strategy, round(p - (1 - p)/1.5, 6) kelly_fraction, round(greatest(0, 1 - x/20e0*0.5/0.2), 6) as scale,
  case when ruin > 0.1 then 0e0 when ruin > 0.02 then case when x % 4 = 0 then 0e0 else 1e0 end when ruin > 0.005 then case when x % 4 >= 2 then 2e0 else 1e0 end
    else case x % 4 when 3 then 2.8e0 when 2 then 2e0 else 1e0 end end leverage from y""",
    "strategy_summary": f"""with {RET}, {TRD}, a as (select strategy, min(d) s, max(d) e, exp(sum(ln(1 + ret))) - 1 tr from ret group by 1),
t as (select strategy, count(*) n, avg(case when r > 0 then 1e0 else 0 end) p from tra group by 1)
select strategy, strftime(s, '%Y-%m-%d %H:%M:%S') as start, strftime(e, '%Y-%m-%d %H:%M:%S') as "end", round(case when tr <= -1 then -1 else pow(1 + tr, 365.25/(epoch(e) - epoch(s))*86400) - 1 end, 6) cagr,
  round(tr, 6) total_return, n n_trades, round(p, 6) win_rate from a join t using (strategy)""",
}
