"""Queries of the further indicators, and their SQL."""

from __future__ import annotations

from tapeworks.operators import strategy as st
from tapeworks.plans.queries import D1, W, _full, _r
from tapeworks.sources import bars as b

WINDOWS = {
    "reg": {"fn": "linearreg"}, "slope": {"fn": "linearreg_slope", "n": 10}, "start": {"fn": "linearreg_intercept"}, "forecast": {"fn": "tsf", "n": 10}, "correl": {"fn": "correl", "n": 20},
    "beta": {"fn": "beta"}, "aroon_up": {"fn": "aroon", "output": "up"}, "aroon_osc": {"fn": "aroon", "n": 10, "output": "osc"}, "cci": {"fn": "cci"}, "mfi": {"fn": "mfi"}, "obv": {"fn": "obv"}, "ad": {"fn": "ad"},
    "ultosc": {"fn": "ultosc"}, "slowd": {"fn": "stoch", "output": "slowd"}, "trima": {"fn": "trima", "n": 5}, "ppo": {"fn": "ppo"}, "lowest": {"fn": "minmax", "n": 9, "output": "min"},
}
CASCADES = {
    "dema": {"fn": "dema", "n": 5}, "tema": {"fn": "tema", "n": 5}, "t3": {"fn": "t3", "n": 5}, "trix": {"fn": "trix", "n": 5}, "adosc": {"fn": "adosc"},
    "cmo": {"fn": "cmo"}, "fastk": {"fn": "stochrsi", "output": "fastk"}, "fastd": {"fn": "stochrsi", "output": "fastd"},
}


def window_indicators(spark, sf):
    return _r(st.compute_features(b.daily_bars(spark, sf), "D1", WINDOWS).select("symbol", "ts", *WINDOWS), *WINDOWS)


def average_cascades(spark, sf):
    names = ("dema", "tema", "t3", "trix")
    return _r(st.compute_features(b.daily_bars(spark, sf), "D1", {n: CASCADES[n] for n in names}).select("symbol", "ts", *names), *names)


def oscillator_cascades(spark, sf):
    names = ("adosc", "cmo", "fastk", "fastd")
    return _r(st.compute_features(b.daily_bars(spark, sf), "D1", {n: CASCADES[n] for n in names}).select("symbol", "ts", *names), *names, n=5)


QUERIES = {q.__name__: q for q in (window_indicators, average_cascades, oscillator_cascades)}


def _over(n: int) -> str:
    return f"({W} rows between {n - 1} preceding and current row)"


def _when(n: int, value: str) -> str:
    return f"case when count(*) over {_over(n)} = {n} then {value} end"


def _scan(name: str, source: str, value: str, n: int, weight: str) -> str:
    """A recursion: mean of the first n values that are there, then weight * value + (1 - weight) * before."""
    return f"""{name}i as materialized (select symbol, rn, {value} v, row_number() over (partition by symbol order by rn) k from {source} where {value} is not null),
{name}r as (select symbol, rn, k, cast(v as double) s, case when {n} = 1 then cast(v as double) end e from {name}i where k = 1
  union all select i.symbol, i.rn, i.k, r.s + i.v, case when i.k = {n} then (r.s + i.v)/{n} when i.k > {n} then r.e*(1 - {weight}) + i.v*{weight} end from {name}r r join {name}i i on i.symbol = r.symbol and i.k = r.k + 1),
{name} as materialized (select symbol, rn, e from {name}r where e is not null)"""


NUMBERED = f"{D1}, nb as materialized (select *, row_number() over ({W}) rn, close - lag(close) over ({W}) d from bars)"
FLOW = "case when high > low then (2*close - low - high)/(high - low) else 0 end*volume"
AVERAGES = ",\n".join([NUMBERED, _scan("e1", "nb", "close", 5, "2e0/6"), *[_scan(f"e{k}", f"e{k - 1}", "e", 5, "2e0/6") for k in range(2, 7)]])
OSCILLATORS = ",\n".join([
    NUMBERED, f"fl as materialized (select symbol, rn, sum({FLOW}) over ({W}) a from nb)", _scan("fa", "fl", "a", 1, "2e0/4"), _scan("sl", "fl", "a", 1, "2e0/11"),
    _scan("up", "nb", "greatest(d, d*0)", 14, "1e0/14"), _scan("dn", "nb", "greatest(-d, d*0)", 14, "1e0/14"),
    "rs as materialized (select up.symbol, up.rn, 100*coalesce(up.e/nullif(up.e + dn.e, 0), 0) r, case when up.e + dn.e > 1e-12 then 100*(up.e - dn.e)/(up.e + dn.e) else 0 end cmo from up join dn using (symbol, rn))",
    "sk as (select *, min(r) over w lo, max(r) over w hi, count(*) over w n from rs window w as (partition by symbol order by rn rows between 4 preceding and current row))",
    "sd as (select *, case when n = 5 then case when hi - lo > 1e-12 then 100*(r - lo)/(hi - lo) else 0 end end k from sk)",
    "se as (select *, case when count(k) over w = 3 then avg(k) over w end d3 from sd window w as (partition by symbol order by rn rows between 2 preceding and current row))",
])

ORACLES = {
    "window_indicators": f"""with {D1}, a as (select *, row_number() over ({W}) rn, (high + low + close)/3 tp, lag(close) over ({W}) pc, high/lag(high) over ({W}) - 1 rh, low/lag(low) over ({W}) - 1 rl from bars),
c as (select *, tp - lag(tp) over ({W}) step, close - least(low, pc) bp, greatest(high, pc) - least(low, pc) tr, avg(tp) over {_over(14)} tm, list(tp) over {_over(14)} tl,
  list(struct_pack(v := high, r := rn)) over {_over(15)} hl, list(struct_pack(v := low, r := -rn)) over {_over(15)} ll, list(struct_pack(v := high, r := rn)) over {_over(11)} hs, list(struct_pack(v := low, r := -rn)) over {_over(11)} ls,
  case when count(*) over {_over(5)} = 5 then coalesce(100*(close - min(low) over {_over(5)})/nullif(max(high) over {_over(5)} - min(low) over {_over(5)}, 0), 0) end fk from a),
g as (select *, {_full('avg', 3, 0, 'fk')} sk, list_sum(list_transform(tl, lambda x: abs(x - tm)))/14 md, case when pc is null then null else bp end bq, case when pc is null then null else tr end tq,
  case when step > 0 then tp*volume else 0 end up, case when step < 0 then tp*volume else 0 end dn from c),
tt as (select *, {_full('avg', 3, 0, 'sk')} sd, case when rn > 14 then sum(up) over {_over(14)} end su, case when rn > 14 then sum(dn) over {_over(14)} end sn,
  {', '.join(f"case when rn > {n} then coalesce(sum(bq) over {_over(n)}/nullif(sum(tq) over {_over(n)}, 0), 0) end u{n}" for n in (7, 14, 28))} from g)
select symbol, ts, round({_when(14, f'regr_intercept(close, rn) over {_over(14)} + rn*regr_slope(close, rn) over {_over(14)}')}, 6) reg, round({_when(10, f'regr_slope(close, rn) over {_over(10)}')}, 6) slope,
round({_when(14, f'regr_intercept(close, rn) over {_over(14)} + (rn - 13)*regr_slope(close, rn) over {_over(14)}')}, 6) as start, round({_when(10, f'regr_intercept(close, rn) over {_over(10)} + (rn + 1)*regr_slope(close, rn) over {_over(10)}')}, 6) forecast,
round({_when(20, f'coalesce(covar_pop(high, low) over {_over(20)}/nullif(stddev_pop(high) over {_over(20)}*stddev_pop(low) over {_over(20)}, 0), 0)')}, 6) correl, round(case when rn > 5 then coalesce(covar_pop(rh, rl) over {_over(5)}/nullif(var_pop(rh) over {_over(5)}, 0), 0) end, 6) beta,
round(case when rn > 14 then 100e0*(14 - (rn - list_max(hl).r))/14 end, 6) aroon_up, round(case when rn > 10 then 100e0*(10 - (rn - list_max(hs).r))/10 - 100e0*(10 - (rn + list_min(ls).r))/10 end, 6) aroon_osc,
round({_when(14, 'case when 0.015*md > 1e-12 then (tp - tm)/(0.015*md) else 0 end')}, 6) cci, round(case when su + sn >= 1 then 100*su/(su + sn) when su is not null then 0 end, 6) mfi,
round(sum(coalesce(sign(close - pc), 1)*volume) over ({W}), 6) obv, round(sum({FLOW}) over ({W}), 6) ad, round(100*(4*u7 + 2*u14 + u28)/7, 6) ultosc, round(sd, 6) slowd,
round({_when(5, f'(close + 2*lag(close) over ({W}) + 3*lag(close, 2) over ({W}) + 2*lag(close, 3) over ({W}) + lag(close, 4) over ({W}))/9')}, 6) trima,
round(100*({_full('avg', 12, 0, 'close')}/{_full('avg', 26, 0, 'close')} - 1), 6) ppo, round({_full('min', 9, 0, 'close')}, 6) lowest from tt""",
    "average_cascades": f"""with recursive {AVERAGES}, tx as (select *, lag(e) over (partition by symbol order by rn) pe from e3)
select nb.symbol, nb.ts, round(2*e1.e - e2.e, 6) dema, round(3*e1.e - 3*e2.e + e3.e, 6) tema, round(1.7e0*1.7e0*1.7e0*e3.e - 3*0.7e0*1.7e0*1.7e0*e4.e + 3*0.49e0*1.7e0*e5.e - 0.343e0*e6.e, 6) t3, round(100*(tx.e/tx.pe - 1), 6) trix
from nb {' '.join(f'left join e{k} using (symbol, rn)' for k in range(1, 7))} left join tx using (symbol, rn)""",
    "oscillator_cascades": f"""with recursive {OSCILLATORS}
select nb.symbol, nb.ts, round(case when nb.rn >= 10 then fa.e - sl.e end, 5) adosc, round(se.cmo, 5) cmo, round(case when d3 is not null then k end, 5) fastk, round(d3, 5) fastd from nb left join fa using (symbol, rn) left join sl using (symbol, rn) left join se using (symbol, rn)""",
}
