"""Queries of the risk split and the daily plan, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import allocation as a
from tapeworks.operators import metrics as m
from tapeworks.operators import scout
from tapeworks.operators import selection as s
from tapeworks.operators.align import daily_labels
from tapeworks.operators.regime import classify_regime
from tapeworks.plans.pattern_queries import REGIME
from tapeworks.plans.queries import RET, TRD, _r, _returns, _trades
from tapeworks.sources import bars as b


def _records(spark, sf):
    x = F.substring("strategy", 2, 1).cast("int")
    status = F.element_at(F.array(*map(F.lit, ("live", "paper", "validated", "rejected"))), x % 4 + 1)
    return _returns(spark, sf).select("strategy").distinct().select(
        "strategy", F.when(x % 2 == 0, "stocks").otherwise("forex").alias("asset_class"), status.alias("status"),
        F.array(F.concat(F.lit("K"), (x % 3).cast("string")), F.lit("NO")).alias("symbols"), (x < 5).alias("uses_watchlist"), F.lit(2.5).alias("cap_pct"), (0.5 + x * 0.05).alias("dsr"),
    )


def _evidence(spark, sf):
    """Recent Sharpe, Kelly risk from trades and clusters; the book stands 4 % under its peak."""
    r = _returns(spark, sf)
    kelly = m.trade_stats(_trades(spark, sf)).select("strategy", (F.col("kelly") * 100).alias("kelly_pct"))
    group = a.clusters(r, _records(spark, sf), 0.02)
    return s.recent_sharpe(r).withColumn("recent", F.col("recent") + 2).join(kelly, "strategy").join(group, "strategy").withColumns({"equity": F.lit(96.0), "peak": F.lit(100.0)})


def strategy_clusters(spark, sf):
    return a.clusters(_returns(spark, sf), _records(spark, sf), 0.02)


def book_allocation(spark, sf):
    """Split of one day, with every strategy under the fit of its overall Sharpe."""
    fit = _returns(spark, sf).groupBy("strategy").agg(m.sharpe_of(F.col("ret")).alias("fit"))
    got = a.allocate(_records(spark, sf).join(_evidence(spark, sf), "strategy").join(fit, "strategy"), total=9.0, mode="paper")
    return _r(got.select("strategy", "cluster", "score", "cap", "multiplier", "risk_pct", F.array_join("notes", "; ").alias("notes"), "excluded"), "score", "cap", "multiplier", n=4)


def _labels(spark, sf):
    return classify_regime(b.daily_bars(spark, sf)).where("symbol = 'NO'")


def daily_plan(spark, sf):
    """The plan at 13:00 of the first of every month that has bars."""
    regime = _labels(spark, sf)
    days = regime.select((F.date_trunc("month", "ts") + F.expr("interval 13 hours")).alias("asof")).distinct()
    daily = daily_labels(regime).select("d", "label")
    ranking = scout.watchlist(scout.technical_scores(b.daily_bars(spark, sf), min_dollar_volume=1000.0), always=2, most=4)
    got = a.daily_plan(days, _records(spark, sf), _evidence(spark, sf), _returns(spark, sf), regime.select("ts", "label"), ranking, daily, total=9.0)
    return _r(got.select("asof", "regime", "strategy", "cluster", "score", "risk_pct", "excluded", F.array_join("universe", ",").alias("universe")), "score", n=4)


QUERIES = {q.__name__: q for q in (strategy_clusters, book_allocation, daily_plan)}

RECORDS = """sn as (select distinct strategy, cast(strategy[2] as int) x from ret),
rc as (select strategy, case when x % 2 = 0 then 'stocks' else 'forex' end asset_class, ['live', 'paper', 'validated', 'rejected'][x % 4 + 1] status, ['K' || (x % 3), 'NO'] symbols, x < 5 uses_watchlist, 2.5 cap_pct, 0.5 + x*0.05 dsr from sn),
co as (select a.strategy a, b.strategy b, count(*) n, covar_samp(a.ret, b.ret)/nullif(stddev_samp(a.ret)*stddev_samp(b.ret), 0) c from ret a join ret b on a.d = b.d and a.strategy < b.strategy where not (a.ret = 0 and b.ret = 0) group by 1, 2),
li as (select a.strategy a, b.strategy b from rc a join rc b on a.strategy < b.strategy left join co on co.a = a.strategy and co.b = b.strategy
  where case when coalesce(n, 0) >= 60 then coalesce(c, 0) >= 0.02 else a.asset_class = b.asset_class and len(list_intersect(a.symbols, b.symbols)) > 0 end),
bi as (select a, b from li union select b, a from li), cr as (select strategy node, strategy root from rc union select bi.b, cr.root from cr join bi on cr.node = bi.a),
cl as materialized (select node strategy, min(root) as cluster from cr group by 1)"""
EVIDENCE = f"""{RECORDS},
rw as (select *, pow(0.5, (row_number() over (partition by strategy order by d desc) - 1)/60e0) w from ret), rm as (select strategy, sum(w*ret)/sum(w) m from rw group by 1),
re as (select strategy, any_value(m)/sqrt(sum(w*(ret - m)*(ret - m))/sum(w))*sqrt(252) + 2 recent from rw join rm using (strategy) group by 1),
kg as (select strategy, count(*) n, count(*) filter (where r > 0) w from tra group by 1), kp as (select *, w/n p, 1.645 z from kg),
kl as (select strategy, (p + z*z/(2*n) - z*sqrt(p*(1 - p)/n + z*z/(4*n*n)))/(1 + z*z/n) lo from kp),
ev as materialized (select rc.*, recent, greatest(0, 25*(lo - (1 - lo)/1.5)) kelly_pct, cluster from rc join re using (strategy) join kl using (strategy) join cl using (strategy)),
ov as (select strategy, avg(ret)/stddev_samp(ret)*sqrt(252) o from ret group by 1)"""


def _fill(source: str, out: str, on: str) -> str:
    """Shares of ``source`` (id, score, cap, budget) by level: each row as the first that is not capped."""
    same = lambda x, y: " and ".join(f"{x}.{c} is not distinct from {y}.{c}" for c in on.split(", "))
    return f"""{out}p as (select *, cap/score r from {source} where score > 0 and cap > 0),
{out}l as (select x.*, (x.budget - coalesce((select sum(cap) from {out}p y where {same('y', 'x')} and (y.r < x.r or (y.r = x.r and y.id < x.id))), 0))/(select sum(score) from {out}p y where {same('y', 'x')} and (y.r > x.r or (y.r = x.r and y.id >= x.id))) lev from {out}p x),
{out} as materialized (select l.*, least(cap, score*coalesce((select min_by(lev, struct_pack(r := r, lev := lev)) from {out}l y where {same('y', 'l')} and y.lev <= y.r), 1e300)) share from {out}l l)"""


def _split(book: str, at: str) -> str:
    return f"""bk as materialized (select *, 0.4*recent + 0.3*(4*dsr - 2) + 0.3*fit score0, least(case when status in ('paper', 'live') then 5 else least(3, cap_pct) end, kelly_pct) cap0 from {book}),
lv as (select *, greatest(score0, 0) score, cap0 as cap from bk where status in ('validated', 'paper', 'live')),
gp as (select {at}, cluster, cluster as id, max(score) score, least(6, coalesce(sum(cap) filter (where score > 0), 0)) as cap, count(*) members, 9*0.9 budget from lv group by {at}, cluster),
{_fill('gp', 'gs', at)},
mb as (select lv.*, lv.strategy as id, gs.share budget from lv join gs on gs.cluster = lv.cluster and {' and '.join(f'gs.{c} is not distinct from lv.{c}' for c in at.split(', '))}),
{_fill('mb', 'ms', at + ', cluster')},
al as materialized (select bk.*, round(coalesce(ms.share, 0), 4) risk_pct, gp.members, case when bk.status = 'rejected' then 'status rejected not eligible in paper mode' when bk.score0 <= 0 then 'score not positive' when bk.cap0 <= 0 then 'no edge to size' end excluded
  from bk left join ms on ms.strategy = bk.strategy and {' and '.join(f'ms.{c} is not distinct from bk.{c}' for c in at.split(', '))} left join gp on gp.cluster = bk.cluster and {' and '.join(f'gp.{c} is not distinct from bk.{c}' for c in at.split(', '))})"""


def _plan_sql() -> str:
    from tapeworks.plans.queries import WATCHLIST

    watch = WATCHLIST.split("steps as (", 1)[1].rsplit("select symbol, ts, round(score", 1)[0]
    for name in "qgk":  # the regime has tables of these names
        watch = watch.replace(f"\n{name} as (", f"\nw{name} as (").replace(f"from {name})", f"from w{name})")
    return f"""{REGIME}, {RET}, {TRD}, {EVIDENCE}, steps as ({watch.rstrip()},
wl as materialized (select ts, list(symbol order by rank) ls from wk where rank <= 2 or (rank <= 4 and score >= 1) group by ts),
lb as materialized (select ts, trend || '/' || vol as label from l where symbol = 'NO'),
dy as materialized (select distinct date_trunc('month', ts) + interval 13 hours asof_ from lb),
cu as materialized (select asof_, coalesce((select max_by(label, ts) from lb where ts < asof_), 'unknown') cur, (select max_by(ls, ts) from wl where ts < asof_) ls from dy),
rl as materialized (select ret.*, coalesce(lb.label, '') as label from ret asof left join lb on ret.d >= lb.ts),
ow as (select strategy, asof_, count(*) n, avg(ret)/nullif(stddev_samp(ret), 0)*sqrt(252) h from rl join cu on rl.d >= asof_ or rl.label = cur group by 1, 2),
bo as (select ev.*, asof_, cur, ls, case when coalesce(n, 0) < 5 then o else n/(n + 120e0)*h + (1 - n/(n + 120e0))*o end fit from ev cross join cu join ov using (strategy) left join ow using (strategy, asof_)),
{_split('bo', 'asof_')}
select asof_ as asof, cur as regime, strategy, cluster, round(score0, 4) score, risk_pct, excluded, case when risk_pct > 0 then array_to_string(list_concat(symbols, case when uses_watchlist then list_filter(coalesce(ls, []), lambda q: not list_contains(symbols, q)) else [] end), ',') else '' end universe from al"""


ORACLES = {
    "strategy_clusters": f"with recursive {RET}, {RECORDS} select strategy, cluster from cl",
    "book_allocation": f"""with recursive {RET}, {TRD}, {EVIDENCE}, bo as (select ev.*, o fit, 1 as one from ev join ov using (strategy)), {_split('bo', 'one')}
select strategy, cluster, round(score0, 4) score, round(cap0, 4) as cap, 0.9 multiplier, risk_pct, case when status = 'rejected' then '' else concat_ws('; ', case when risk_pct > 0 and risk_pct >= round(cap0, 4) - 1e-9 then 'at cap ' || printf('%.2f', cap0) || '%' end,
case when members > 1 then 'shares cluster ' || cluster || ' with ' || (members - 1) || ' more' end, 'budget x0.90 for drawdown') end notes, excluded from al""",
    "daily_plan": _plan_sql(),
}
