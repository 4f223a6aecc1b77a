"""Queries of feature sets, signals, parameter grids and trades over folds, and their SQL (also that of the older trade queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import features as f
from tapeworks.operators import selection as s
from tapeworks.operators import strategy as st
from tapeworks.operators import trades
from tapeworks.plans.pattern_queries import ZIGZAG
from tapeworks.plans.queries import D1, W, _full, _r
from tapeworks.plans.selection_queries import _fold_sql
from tapeworks.sources import bars as b

FEATURES = {
    "high20": {"fn": "highest", "period": 20}, "weekly_high": {"fn": "highest", "tf": "W1", "period": 3}, "z": {"fn": "zscore", "period": 10},
    "weekly_mean": {"fn": "sma", "tf": "W1", "period": 5}, "upper": {"fn": "bbands", "period": 20, "output": "upper"},
    "mean_of_high": {"fn": "sma", "input": "high20", "n": 4}, "weekly_gap": {"fn": "mom", "tf": "W1", "ref": "weekly_mean", "n": 2}, "weekly_average": {"fn": "sma", "ref": "weekly_high", "n": 3},
}
#: Searched settings of a breakout: its exits and the length of the high that it breaks.
SPACE = {"stop_atr": [1.5, 3.0], "max_bars": [5, 12], "features.high.period": [10, 20, 40]}


def feature_set(spark, sf):
    d = st.compute_features(b.daily_bars(spark, sf), "D1", FEATURES)
    return _r(d.select("symbol", "ts", *FEATURES), *FEATURES)


def signal_table(spark, sf):
    """A pullback above the last swing's mean with earnings blocked and news without a calendar."""
    d = st.compute_features(b.daily_bars(spark, sf), "D1", {"mean": {"fn": "sma", "n": 20}})
    earnings = d.where(F.dayofyear("ts") % 30 == 0).select("symbol", F.to_date("ts").alias("d"))
    got, warnings = st.signals(
        d, f.gt("close", "mean") & f.lt("close", "open"), f.lt("close", "mean") & f.gt("close", "open"), f.lt("close", "mean"), f.gt("close", "mean"),
        ("no_earnings_3d", "no_high_impact_news_30m", "no_high_impact_news_30m"), {"earnings": earnings},
    )
    return _r(got.select("symbol", "ts", "long_entry", "short_entry", "long_exit", "short_exit", "atr", F.lit("; ".join(warnings)).alias("warnings")), "atr")


def param_grids(spark, sf):
    """Grid of the searched settings, whole and drawn, next to the number of bars they would run over."""
    n = b.daily_bars(spark, sf).count()
    whole, drawn = st.param_grid(spark, SPACE, 3), st.param_grid(spark, SPACE, 3, max_trials=7, seed=1)
    return whole.withColumn("kind", F.lit("whole")).unionByName(drawn.withColumn("kind", F.lit("drawn"))).withColumnRenamed("features.high.period", "period").withColumn("n_bars", F.lit(n))


def _breakouts(spark, sf):
    """Breakouts over highs of several lengths: 8 of 12 parameter sets, all folds, one job."""
    d = f.atr(b.daily_bars(spark, sf))
    d = d.withColumns({f"h{n}": f.highest("high", n) for n in (10, 20, 40)} | {"l10": f.lowest("low", 10)}).withColumns({"long_exit": f.lt("close", "l10"), "short_exit": F.lit(False)})
    grid = st.param_grid(spark, SPACE, 2, max_trials=8)
    long = f.gt("close", st.chosen("features.high.period", {10: "h10", 20: "h20", 40: "h40"}))
    rule = trades.ExitRule(F.col("stop_atr"), 2.0, F.col("max_bars"))
    spans = s.folds(b.timeline(d), 3)
    return st.trades_on_windows(d, grid, spans, long, F.lit(False), rule), d, grid, spans


def walk_forward_trades(spark, sf):
    made = _breakouts(spark, sf)[0]
    return _r(made.select("param_id", "fold", "phase", "symbol", "rn", "exit_rn", "exit_ts", "reason", "entry", "exit", "qty", "net_pnl"), "entry", "exit", "net_pnl", n=4)


def walk_forward_choice(spark, sf):
    made, d, grid, spans = _breakouts(spark, sf)
    return _r(st.choose(st.window_scores(made, b.timeline(d), grid, spans)), "train_sharpe", "test_sharpe", "test_pnl", n=6)


QUERIES = {q.__name__: q for q in (feature_set, signal_table, param_grids, walk_forward_trades, walk_forward_choice)}

#: Bars y with rn, average range and next bar; then signals sg, candidates ca, and trades by the rules below.
BARS = ZIGZAG.split("z as (select symbol, rn, 0 dir")[0].rstrip().rstrip(",")


def trade_sql(keys: str, stop: str, target: float, limit: str) -> str:
    """Trades tk of candidates ca (keys, symbol, rn, side, o1, atr, w_end, parameters) over bars yy (lx, sx, next_ts)."""
    k = f"{keys}, " if keys else ""
    same = "".join(f" and {{0}}.{c.strip()} = {{1}}.{c.strip()}" for c in keys.split(",") if c.strip())
    on = lambda x, y: f"{x}.symbol = {y}.symbol" + same.format(x, y)
    return f"""e0 as (select *, o1*(1 + side*3e0/1e4) entry from ca where o1 is not null and atr > 0),
e1 as (select *, entry - side*cast({stop} as double)*atr as stop, entry + side*{target}e0*cast({stop} as double)*atr as target, cast({limit} as int) as lim from e0),
e2 as (select *, cast(floor(1000/abs(entry - stop)) as bigint) qty from e1 where floor(1000/abs(entry - stop)) >= 1),
pa as (select {''.join(f'e2.{c.strip()}, ' for c in keys.split(',') if c.strip())}e2.symbol, e2.rn, side, entry, stop, target, qty, yy.rn j, yy.ts, open o, close c, yy.rn > e2.rn + 1 later, yy.rn = e2.rn + 1 + lim at_limit,
  case when side > 0 then low else high end adverse, case when side > 0 then high else low end favour, coalesce(case when side > 0 then plx else psx end, false) asked, next_ts is null or coalesce(next_ts >= w_end, false) last_
  from e2 join yy on yy.symbol = e2.symbol and yy.rn between e2.rn + 1 and e2.rn + 1 + lim and (w_end is null or yy.ts < w_end)),
hi as (select *, case when at_limit then 'time' when later and asked then 'signal' when later and side*o <= side*stop then 'stop_gap' when later and side*target <= side*o then 'target_gap'
  when side*adverse <= side*stop then 'stop' when side*target <= side*favour then 'target' when last_ then 'end_of_data' end reason from pa),
fx as (select {k}symbol, rn, min(j) exit_rn, min_by(ts, j) exit_ts, min_by(reason, j) reason, any_value(side) side, any_value(entry) entry, any_value(stop) stop, any_value(qty) qty,
  min_by(case reason when 'stop' then stop when 'target' then target when 'end_of_data' then c else o end, j) x from hi where reason is not null group by {k}symbol, rn),
fy as (select *, x*(1 - side*3e0/1e4) exit, qty*side*(x*(1 - side*3e0/1e4) - entry) net_pnl from fx),
nx as materialized (select a.*, (select min(n.rn) from fy n where {on('n', 'a')} and n.rn >= a.exit_rn) nxt from fy a),
tk as (select nx.* from nx join (select {k}symbol, min(rn) m from nx group by {k}symbol) mi on {on('nx', 'mi')} and nx.rn = mi.m
  union all select nx.* from tk join nx on {on('nx', 'tk')} and nx.rn = tk.nxt)"""


RSI2 = f"""{BARS}, dd as (select y.*, close - lag(close) over ({W}) d from y),
r2 as (select symbol, rn, null::double e200, null::double e5, null::double u, null::double v, close sc, 0e0 su, 0e0 sv from dd where rn = 1
  union all select x.symbol, x.rn, case when x.rn = 200 then (r.sc + x.close)/200 when x.rn > 200 then r.e200*199e0/201 + x.close*2e0/201 end,
    case when x.rn = 5 then (r.sc + x.close)/5 when x.rn > 5 then r.e5*4e0/6 + x.close*2e0/6 end,
    case when x.rn = 3 then (r.su + greatest(x.d, 0))/2 when x.rn > 3 then (r.u + greatest(x.d, 0))/2 end, case when x.rn = 3 then (r.sv + greatest(-x.d, 0))/2 when x.rn > 3 then (r.v + greatest(-x.d, 0))/2 end,
    r.sc + x.close, r.su + greatest(x.d, 0), r.sv + greatest(-x.d, 0) from r2 r join dd x on x.symbol = r.symbol and x.rn = r.rn + 1),
sg as materialized (select y.*, coalesce(close > e200 and coalesce(100*u/nullif(u + v, 0), 0) < 10 and u is not null, false) le, false se, coalesce(close > e5, false) lx, false sx from y join r2 using (symbol, rn)),
yy as materialized (select *, lag(lx) over ({W}) plx, lag(sx) over ({W}) psx, lead(ts) over ({W}) next_ts, lead(open) over ({W}) o1 from sg),
ca as (select symbol, rn, case when le then 1 else -1 end side, o1, atr, null::timestamp w_end from yy where le <> se),
{trade_sql('', '2.5', 1.5, '7')}"""
BREAKOUT = f"""{BARS}, sg as materialized (select y.*, coalesce(close > {_full('max', 20, 1, 'high')}, false) le, coalesce(close < {_full('min', 20, 1, 'low')}, false) se, false lx, false sx from y),
yy as materialized (select *, lag(lx) over ({W}) plx, lag(sx) over ({W}) psx, lead(ts) over ({W}) next_ts, lead(open) over ({W}) o1 from sg),
ca as (select symbol, rn, case when le then 1 else -1 end side, o1, atr, null::timestamp w_end from yy where le <> se),
{trade_sql('', '2.0', 2, '10')}"""
#: Twelve sets, eight of them by md5; ids count with the length of the high fastest.
GRID = """gr as materialized (select * from (select a*6 + m*3 + h as param_id, [1.5, 3.0][a + 1] stop_atr, [5, 12][m + 1] max_bars, [10, 20, 40][h + 1] period from range(2) x(a), range(2) z(m), range(3) w(h))
  order by md5('0:' || param_id) limit 8)"""
FOLDS = f"""{BARS}, {_fold_sql(3, True, 'fo')},
wi as materialized (select fold, 'train' phase, train_start w_start, train_end w_end from fo union all select fold, 'test', test_start, test_end from fo), {GRID},
sg as materialized (select y.*, {', '.join(f"{_full('max', n, 1, 'high')} h{n}" for n in (10, 20, 40))}, coalesce(close < {_full('min', 10, 1, 'low')}, false) lx, false sx from y),
yy as materialized (select *, lag(lx) over ({W}) plx, lag(sx) over ({W}) psx, lead(ts) over ({W}) next_ts, lead(open) over ({W}) o1 from sg),
ca as (select param_id, fold, phase, symbol, rn, 1 side, o1, atr, w_end, stop_atr, max_bars from yy, gr, wi where close > case period when 10 then h10 when 20 then h20 else h40 end and ts >= w_start and next_ts < w_end),
{trade_sql('param_id, fold, phase', 'stop_atr', 2, 'max_bars')}"""

ORACLES = {
    "feature_set": f"""with {D1}, w0 as (select symbol, date_trunc('week', ts) wk, max(high) high, max_by(close, ts) as close from bars group by 1, 2),
w1 as (select symbol, wk + interval 7 days known, {_full('max', 3, 1, 'high').replace('order by ts', 'order by wk')} weekly_high, {_full('avg', 5, 0, 'close').replace('order by ts', 'order by wk')} weekly_mean, wk from w0),
w2 as (select symbol, known, weekly_high, weekly_mean, weekly_mean - lag(weekly_mean, 2) over (partition by symbol order by wk) weekly_gap from w1),
d1 as (select symbol, ts, ts + interval 1 day fin, {_full('max', 20, 1, 'high')} high20, (close - {_full('avg', 10, 0, 'close')})/nullif({_full('stddev_samp', 10, 0, 'close')}, 0) z, {_full('avg', 20, 0, 'close')} + 2*{_full('stddev_pop', 20, 0, 'close')} upper_ from bars),
j as (select d1.symbol, ts, high20, z, upper_, weekly_high, weekly_mean, weekly_gap from d1 asof left join w2 on w2.symbol = d1.symbol and d1.fin >= w2.known)
select symbol, ts, high20, round(z, 6) z, round(upper_, 6) as upper, round(weekly_high, 6) weekly_high, round(weekly_mean, 6) weekly_mean, round(weekly_gap, 6) weekly_gap, round({_full('avg', 4, 0, 'high20')}, 6) mean_of_high, round({_full('avg', 3, 0, 'weekly_high')}, 6) weekly_average from j""",
    "signal_table": f"""with recursive {BARS}, m as (select *, {_full('avg', 20, 0, 'close')} mean from y),
er as (select symbol, cast(ts as date) d from y where dayofyear(ts) % 30 = 0),
k as (select *, exists (select 1 from er where er.symbol = m.symbol and cast(m.ts as date) between er.d - 3 and er.d) near from m)
select symbol, ts, coalesce(close > mean and close < open, false) and not near long_entry, coalesce(close < mean and close > open, false) and not near short_entry, coalesce(close < mean, false) long_exit, coalesce(close > mean, false) short_exit,
round(atr, 6) atr, 'no_high_impact_news_30m: no calendar, filter inactive' warnings from k""",
    "param_grids": f"""with {D1}, g as (select a*9 + m*3 + h as param_id, [1.5, 2.25, 3.0][a + 1] stop_atr, [5, 8, 12][m + 1] max_bars, [10, 20, 40][h + 1] period from range(3) x(a), range(3) z(m), range(3) w(h)),
u as (select *, 'whole' kind from g union all (select *, 'drawn' from g order by md5('1:' || param_id) limit 7))
select param_id, cast(stop_atr as double) stop_atr, cast(max_bars as double) max_bars, cast(period as double) as period, kind, (select count(*) from bars) n_bars from u""",
    "walk_forward_trades": f"with recursive {FOLDS} select param_id, fold, phase, symbol, rn, exit_rn, exit_ts, reason, round(entry, 4) entry, round(exit, 4) as exit, qty, round(net_pnl, 4) net_pnl from tk",
    "walk_forward_choice": f"""with recursive {FOLDS}, dn as (select fold, phase, count(distinct cast(ts as date)) n from (select distinct ts from bars) t join wi on ts >= w_start and ts < w_end group by 1, 2),
dr as (select param_id, fold, phase, cast(exit_ts as date) d, sum(net_pnl)/100000 ret, count(*) k from tk group by 1, 2, 3, 4),
sc as (select gr.param_id, dn.fold, dn.phase, n, coalesce(sum(ret), 0) s, coalesce(sum(ret*ret), 0) q, coalesce(sum(k), 0) n_trades from gr cross join dn left join dr on dr.param_id = gr.param_id and dr.fold = dn.fold and dr.phase = dn.phase group by 1, 2, 3, 4),
sh as (select *, case when sqrt(greatest((q - s*s/n)/(n - 1), 0)) > 1e-12 then s/n/sqrt(greatest((q - s*s/n)/(n - 1), 0)) else 0 end sharpe from sc),
be as (select *, row_number() over (partition by fold order by n_trades >= 10 desc, sharpe desc, param_id) p from sh where phase = 'train')
select be.fold, be.param_id, be.n_trades train_trades, round(be.sharpe, 6) train_sharpe, t.n_trades test_trades, round(t.sharpe, 6) test_sharpe, round(t.s*100000, 6) test_pnl from be join sh t on t.fold = be.fold and t.param_id = be.param_id and t.phase = 'test' where p = 1""",
    "rsi2_trades": f"with recursive {RSI2} select symbol, rn, exit_rn, exit_ts, reason, round(entry, 4) entry, round(exit, 4) as exit, qty, round(net_pnl, 4) net_pnl, round(net_pnl/(qty*abs(entry - stop)), 4) r_multiple from tk",
    "breakout_trades": f"with recursive {BREAKOUT} select symbol, rn, exit_rn, reason, side, round(entry, 4) entry, round(exit, 4) as exit, qty, round(net_pnl, 4) net_pnl from tk",
    "rsi2_trade_stats": f"""with recursive {RSI2}, ta as (select symbol, net_pnl, net_pnl/(qty*abs(entry - stop)) r from tk),
g as (select symbol, count(*) n, count(*) filter (where net_pnl > 0) w, coalesce(sum(net_pnl) filter (where net_pnl > 0), 0) gw, coalesce(-sum(net_pnl) filter (where net_pnl <= 0), 0) gl, avg(net_pnl) filter (where net_pnl > 0) aw, avg(net_pnl) filter (where net_pnl <= 0) al, avg(r) e,
  avg(r) filter (where r > 0)/nullif(-avg(r) filter (where r <= 0), 0) payoff from ta group by symbol),
g2 as (select *, w/n p, 1.645 z from g), l as (select *, (p + z*z/(2*n) - z*sqrt(p*(1 - p)/n + z*z/(4*n*n)))/(1 + z*z/n) lo from g2)
select symbol, n n_trades, round(p, 6) win_rate, round(lo, 6) win_rate_lower, round(case when gl > 0 then gw/gl when gw > 0 then 'inf'::double else 0 end, 6) profit_factor, round(aw, 6) avg_win, round(al, 6) avg_loss, round(e, 6) expectancy_r, round(payoff, 6) payoff,
round(coalesce(greatest(0, 0.25*(lo - (1 - lo)/payoff)), 0), 6) kelly from l""",
}
