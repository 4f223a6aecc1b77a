"""Queries of parameter selection, allocation and scouting, and their SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import metrics as m
from tapeworks.operators import scout
from tapeworks.operators import selection as s
from tapeworks.plans.desk_queries import UNI
from tapeworks.plans.queries import D1, RET, W, _phi, _r, _returns
from tapeworks.sources import bars as b

TRIALS = """
tri as (select concat('s', l_suppkey % 3) strategy, l_partkey % 8 param, l_shipdate d, cast(round(l_discount*100) as bigint) - 5 st,
    case when round(l_tax*100) >= 4 then 1.5e0 else -1e0 end r from lineitem),
pr as (select strategy, param, d, sum(st)/(count(*)*1000e0) ret from tri group by 1, 2, 3)
"""


def _trials(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    r = F.when(F.round(F.col("l_tax") * 100) >= 4, 1.5).otherwise(-1.0)
    t = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("strategy"), (F.col("l_partkey") % 8).alias("param"), F.col("l_shipdate").alias("d"),
        (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("st"), r.alias("r_multiple"), (100 * r).alias("net_pnl"),
    )
    return t.groupBy("strategy", "param", "d").agg((F.sum("st") / (F.count("*") * F.lit(1000.0))).alias("ret")), t.drop("st")


def _folds(spark, sf):
    return s.folds(b.timeline(b.daily_bars(spark, sf)))


def walk_forward_folds(spark, sf):
    return _folds(spark, sf).unionByName(s.folds(b.timeline(b.daily_bars(spark, sf)), 3, anchored=False).withColumn("fold", F.col("fold") + 10))


def walk_forward_scores(spark, sf):
    returns, trades = _trials(spark, sf)
    return _r(s.train_scores(returns, trades, _folds(spark, sf)), "sharpe", n=9)


def walk_forward_best(spark, sf):
    returns, trades = _trials(spark, sf)
    return s.best_params(s.train_scores(returns, trades, _folds(spark, sf))).select("strategy", "fold", "param", "n_trades")


def promotion_gates(spark, sf):
    returns, trades = _trials(spark, sf)
    spans = _folds(spark, sf)
    scores = s.train_scores(returns, trades, spans)
    best = s.best_params(scores)
    found = s.promotion_gate(s.evidence(scores, best, s.stitched_returns(returns, best, spans), s.tested_trades(trades, best, spans)))
    figures = ("sharpe", "max_drawdown", "dsr", "expected_max", "positive_folds", "profit_factor", "stability")
    return _r(found, *figures)


def recent_sharpes(spark, sf):
    return _r(s.recent_sharpe(_returns(spark, sf)), "recent")


def _labels(spark, sf):
    d = b.daily_bars(spark, sf).where("symbol = 'NO'")
    return d.select(F.col("ts").alias("d"), F.when(F.col("close") >= F.col("open"), "up").otherwise("down").alias("label"))


def regime_fits(spark, sf):
    return _r(s.regime_fit(_returns(spark, sf), _labels(spark, sf), "up"), "fit")


def _book(spark, sf):
    r = _returns(spark, sf)
    x = F.substring("strategy", 2, 1).cast("int")
    stats = m.return_stats(r).select("strategy", "dsr")
    both = s.recent_sharpe(r).join(s.regime_fit(r, _labels(spark, sf), "up"), "strategy").join(stats, "strategy")
    return both.select(
        "strategy", F.when(x % 3 == 0, "live").otherwise("validated").alias("status"), (F.col("recent") + 2).alias("recent"), F.col("dsr"), "fit",
        (x * 0.7).alias("kelly_pct"), F.lit(2.5).alias("cap_pct"), (x % 4).cast("string").alias("cluster"),
    )


def risk_allocation(spark, sf):
    return _r(s.allocate(_book(spark, sf), 9.0).select("strategy", "score", "cap", "risk_pct", "excluded"), "score", "cap", "risk_pct", n=4)


def blend_report(spark, sf):
    risks = _returns(spark, sf).select("strategy").distinct().withColumn("risk_pct", F.substring("strategy", 2, 1).cast("int") * 0.25)
    return _r(s.blend_report(_returns(spark, sf), risks), "sharpe", "max_drawdown", "total_return")


def _news(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.concat(F.lit("U"), F.lpad((F.col("user_id") % 25).cast("string"), 2, "0")).alias("symbol"), F.col("ts").alias("published"))


def _scan_days(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.date_trunc("day", "ts").alias("ts")).distinct().withColumn("ts", F.col("ts") + F.expr("interval 13 hours"))


def news_scan(spark, sf):
    return _r(scout.news_scores(_scan_days(spark, sf), _news(spark, sf)), "score")


def scout_ranking(spark, sf):
    news = scout.news_scores(_scan_days(spark, sf), _news(spark, sf))
    chatter = news.where("n % 2 = 0").select("symbol", "ts", "score", F.lit(-1).alias("direction"))
    return _r(scout.watchlist(scout.merged_scores({"news": news, "chatter": chatter}, ("U00", "U01"))), "score")


def reasoned_ranking(spark, sf):
    """The merged ranking with what each source has to say."""
    news = scout.news_scores(_scan_days(spark, sf), _news(spark, sf)).withColumn("reason", F.format_string("%d items", "n"))
    chatter = news.where("n % 2 = 0").select("symbol", "ts", "score", F.lit(-1).alias("direction"), F.when(F.col("n") > 2, "talked about").alias("reason"))
    got = scout.watchlist(scout.merged_scores({"news": news, "chatter": chatter}, ("U00", "U01")))
    return _r(got.withColumn("reasons", F.array_join("reasons", "; ")), "score")


def scout_masks(spark, sf):
    days = _scan_days(spark, sf)
    picks = scout.watchlist(scout.news_scores(days, _news(spark, sf)))
    return scout.scout_mask(picks, days, _news(spark, sf), hold=3)


def universe_watchlist(spark, sf):
    return _r(scout.watchlist(scout.technical_scores(b.universe_bars(spark, sf), min_dollar_volume=1000.0)), "score")


QUERIES = {q.__name__: q for q in (
    walk_forward_folds, walk_forward_scores, walk_forward_best, promotion_gates, recent_sharpes, regime_fits, risk_allocation, blend_report,
    news_scan, scout_ranking, reasoned_ranking, scout_masks, universe_watchlist,
)}


def _fold_sql(n: int, anchored: bool, name: str) -> str:
    start = "0" if anchored else "greatest(0, a - f1)"
    return f"""{name}t as (select ts, row_number() over (order by ts) - 1 i from (select distinct ts from bars)),
{name}n as (select count(*) n, max(ts) last, floor(count(*)*0.4) f1 from {name}t),
{name}c as (select k, n, last, f1, floor(f1 + (n - f1)*k/{n}e0) a, floor(f1 + (n - f1)*(k + 1)/{n}e0) z from {name}n, range({n}) r(k)),
{name} as (select cast(k as int) fold, t0.ts train_start, t1.ts - interval 11 days train_end, t1.ts test_start, coalesce(t2.ts, last + interval 1 second) test_end
  from {name}c join {name}t t1 on t1.i = a join {name}t t0 on t0.i = {start} left join {name}t t2 on t2.i = z where z - a >= 2 and t1.ts - interval 11 days > t0.ts)"""


SCORES = f"""{_fold_sql(5, True, 'fo')},
sc0 as (select strategy, param, fold, avg(ret) m, stddev_samp(ret) sd, count(*) n from pr join fo on d >= train_start and d < train_end group by 1, 2, 3),
tn as (select strategy, param, fold, count(*) n_trades from tri join fo on d >= train_start and d < train_end group by 1, 2, 3),
sc as (select strategy, param, fold, case when n >= 2 and sd > 0 then m/sd else 0 end sharpe, coalesce(n_trades, 0) n_trades from sc0 left join tn using (strategy, param, fold)),
be as (select * from sc qualify row_number() over (partition by strategy, fold order by n_trades >= 10 desc, sharpe desc, param) = 1)"""
NEWS = """nw as (select 'U' || lpad(cast(user_id % 25 as varchar), 2, '0') symbol, ts published from events),
sd as (select distinct date_trunc('day', ts) + interval 13 hours ts from events),
ns as (select symbol, sd.ts, count(*) n, least(3e0, ln(1 + count(*))) score from sd join nw on published <= sd.ts and published >= sd.ts - interval 24 hours group by 1, 2)"""
RANKED = "row_number() over (partition by ts order by score desc, symbol) rank"
_INV = NormalDist().inv_cdf
BEST_OF_8 = (1 - 0.5772156649015329) * _INV(1 - 1 / 8) + 0.5772156649015329 * _INV(1 - 1 / (8 * math.e))
KEPT = "rank <= 10 or (rank <= 20 and score >= 1)"

ORACLES = {
    "walk_forward_folds": f"""with {D1}, {_fold_sql(5, True, 'fo')}, {_fold_sql(3, False, 'fr')}
select * from fo union all select fold + 10, train_start, train_end, test_start, test_end from fr""",
    "walk_forward_scores": f"with {D1}, {TRIALS}, {SCORES} select strategy, param, fold, round(sharpe, 9) sharpe, n_trades from sc",
    "walk_forward_best": f"with {D1}, {TRIALS}, {SCORES} select strategy, fold, param, n_trades from be",
    "promotion_gates": f"""with {D1}, {TRIALS}, {SCORES}, bf as (select be.strategy, be.param, be.fold, test_start, test_end from be join fo using (fold)),
o as (select pr.strategy, bf.fold, d, ret from pr join bf using (strategy, param) where d >= test_start and d < test_end qualify row_number() over (partition by pr.strategy, d order by bf.fold) = 1),
ot as (select tri.strategy, r from tri join bf using (strategy, param) where d >= test_start and d < test_end),
cu as (select *, sum(ln(1 + ret)) over (partition by strategy order by d) e from o), cd as (select *, exp(e - greatest(max(e) over (partition by strategy order by d), 0)) - 1 dd from cu),
g as (select strategy, count(*) n, avg(ret) m, stddev_samp(ret) sdv, skewness(ret) sk, kurtosis(ret) ku, min(dd) md from cd group by 1),
va as (select strategy, avg(v) v from (select strategy, fold, var_samp(sharpe) v from sc group by 1, 2) group by 1),
em as (select strategy, sqrt(v)*{BEST_OF_8!r} mx from va),
pf as (select strategy, avg(up) positive_folds from (select strategy, fold, case when sum(ln(1 + ret)) > 0 then 1e0 else 0e0 end up from o group by 1, 2) group by 1),
st as (select strategy, max(k)/sum(k) stability, arg_max(param, k*1000 - param) recommended from (select strategy, param, count(*) k from be group by 1, 2) group by 1),
ts as (select strategy, count(*) n_trades, sum(case when r > 0 then r else 0 end)/sum(case when r <= 0 then -r else 0 end) profit_factor from ot group by 1),
q as (select g.*, mx, positive_folds, stability, recommended, n_trades, profit_factor, m/sdv sr from g join em using (strategy) join pf using (strategy) join st using (strategy) join ts using (strategy)),
z as (select *, (sr - mx)*sqrt(n - 1)/sqrt(1 - sk*sr + (ku + 2)/4*sr*sr) x from q), y as (select *, {_phi('x')} dsr from z),
x as (select *, list_filter([case when n_trades < 100 then 'few trades' end, case when profit_factor < 1.2 then 'profit factor' end, case when dsr < 0.95 then 'deflated Sharpe' end,
  case when md < -0.5 then 'drawdown' end, case when positive_folds < 0.5 then 'few positive folds' end], lambda t: t is not null) why from y)
select strategy, round(sr*sqrt(252), 6) sharpe, round(md, 6) max_drawdown, round(dsr, 6) dsr, round(mx*sqrt(252), 6) expected_max, round(positive_folds, 6) positive_folds, n_trades,
  round(profit_factor, 6) profit_factor, round(stability, 6) stability, recommended, array_to_string(why, '; ') reasons, case when len(why) = 0 then 'validated' else 'rejected' end status from x""",
    "recent_sharpes": f"""with {RET}, x as (select *, pow(0.5, (row_number() over (partition by strategy order by d desc) - 1)/60e0) w from ret),
m as (select strategy, sum(w*ret)/sum(w) m from x group by 1)
select strategy, round(any_value(m)/sqrt(sum(w*(ret - m)*(ret - m))/sum(w))*sqrt(252), 6) recent from x join m using (strategy) group by strategy""",
    "regime_fits": f"""with {D1}, {RET}, l as (select ts, case when close >= open then 'up' else 'down' end as label from bars where symbol = 'NO'),
x as (select ret.*, l.label from ret asof left join l on ret.d >= l.ts),
g as (select strategy, avg(ret)/stddev_samp(ret)*sqrt(252) o, avg(ret) filter (where label = 'up')/stddev_samp(ret) filter (where label = 'up')*sqrt(252) w, count(*) filter (where label = 'up') k from x group by 1)
select strategy, round(case when k < 5 then o else k/(k + 120e0)*w + (1 - k/(k + 120e0))*o end, 6) fit from g""",
    "blend_report": f"""with {RET}, a as (select strategy, d, ret*cast(strategy[2] as int)*0.25e0 ret from ret),
u as (select * from a union all select 'blend', d, sum(ret) from a where strategy <> 's0' group by d),
c as (select *, sum(ln(1 + ret)) over (partition by strategy order by d) e from u), c2 as (select *, exp(e - max(e) over (partition by strategy order by d)) - 1 dd from c)
select strategy, round(case when stddev_samp(ret) > 0 then avg(ret)/stddev_samp(ret)*sqrt(252) else 0 end, 6) sharpe, round(min(dd), 6) max_drawdown, round(exp(sum(ln(1 + ret))) - 1, 6) total_return from c2 group by 1""",
    "news_scan": f"with {NEWS} select symbol, ts, n, round(score, 6) score from ns",
    "scout_ranking": f"""with {NEWS}, mg as (select symbol, ts, score, 0 dir, 'news' src from ns union all select symbol, ts, 0.5*score, -1, 'chatter' from ns where n % 2 = 0),
tt as (select symbol, ts, sum(score) score, cast(sign(sum(dir)) as int) direction, string_agg(src, ',' order by src desc) sources from mg where symbol not in ('U00', 'U01') group by 1, 2),
rk as (select *, {RANKED} from tt) select symbol, ts, round(score, 6) score, direction, sources, cast(rank as int) rank from rk where {KEPT}""",
    "reasoned_ranking": f"""with {NEWS}, mg as (select symbol, ts, score, 0 dir, 1 o, 'news' src, n || ' items' why from ns union all select symbol, ts, 0.5*score, -1, 2, 'chatter', case when n > 2 then 'talked about' end from ns where n % 2 = 0),
tt as (select symbol, ts, sum(score) score, cast(sign(sum(dir)) as int) direction, string_agg(src, ',' order by o) sources, string_agg(src || ': ' || why, '; ' order by o) reasons from mg where symbol not in ('U00', 'U01') group by 1, 2),
rk as (select *, {RANKED} from tt) select symbol, ts, round(score, 6) score, direction, sources, reasons, cast(rank as int) rank from rk where {KEPT}""",
    "scout_masks": f"""with {NEWS}, rk as (select *, {RANKED} from ns), pk as (select * from rk where {KEPT}), dn as (select ts, row_number() over (order by ts) i from sd),
sy as (select distinct symbol from nw), pi as (select pk.symbol, dn.i from pk join dn using (ts))
select sy.symbol, dn.ts, exists (select 1 from pi where pi.symbol = sy.symbol and pi.i between dn.i - 2 and dn.i) tradable from dn cross join sy""",
    "universe_watchlist": f"""with {UNI}, t as (select *, close*volume dv, lag(close) over ({W}) pc, lag(close, 20) over ({W}) c20,
    count(*) over ({W} rows between unbounded preceding and current row) n from uni),
t2 as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end tr from t),
t3 as (select *, volume/nullif(avg(volume) over ({W} rows between 20 preceding and 1 preceding), 0) rv, open/pc - 1 gap, close/c20 - 1 mom,
    avg(dv) over ({W} rows between 19 preceding and current row) dollar, avg(tr) over ({W} rows between 13 preceding and current row) atr,
    max(close) over ({W} rows between 251 preceding and current row) top from t2),
t4 as (select symbol, ts, case when rv > 1.5 then least(2, log2(rv)) else 0 end + case when abs(gap) > 0.02 then least(1.5, 25*abs(gap)) else 0 end
    + case when abs(mom) > 0.1 then least(1.5, 5*abs(mom)) else 0 end + case when close >= 0.97*top then 0.5 else 0 end + least(1, 25*atr/close) score,
    cast(case when abs(mom) > 0.05 or abs(gap) > 0.02 then sign(mom + gap) else 0 end as int) direction from t3 where n >= 60 and close >= 5 and dollar >= 1000),
rk as (select *, {RANKED} from t4) select symbol, ts, round(score, 6) score, direction, cast(rank as int) rank from rk where {KEPT}""",
}
