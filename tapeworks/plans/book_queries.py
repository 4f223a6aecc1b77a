"""Queries over books of trades, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import exposure as x
from tapeworks.operators import metrics as m
from tapeworks.plans.queries import _r


def _event_trades(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = F.make_dt_interval(F.lit(0), F.col("event_id") % 30)
    return e.select(
        F.col("event_type").alias("book"), (F.col("user_id") % 5).alias("account"), F.col("ts").alias("entry_ts"), (F.col("ts") + hours).alias("exit_ts"),
        (F.col("value") / 4).alias("risk_usd"), (F.col("value") * 10).alias("gross_usd"),
    )


def exposure_report(spark, sf):
    return _r(x.exposure(_event_trades(spark, sf), 10_000.0, 18, 10.0, 3.5), "heat_pct", "gross_usd", n=6)


def day_trades(spark, sf):
    return x.round_trips(_event_trades(spark, sf), most=120)


def trade_cost_stats(spark, sf):
    li, q = spark.read.parquet(f"{sf}/lineitem.parquet"), F.col("l_quantity")
    t = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 10).alias("strategy"), F.col("l_linenumber").alias("bars_held"), ((F.round(F.col("l_discount") * 100) - 5) * q).alias("gross_pnl"), (q / 2).alias("spread_slippage"),
        F.round(F.col("l_tax") * 100).alias("fees"), F.when(F.col("l_linenumber") > 2, 0.25).alias("financing"), F.when(F.col("l_returnflag") == "R", 1.25).alias("borrow"), (F.col("l_linenumber") == 7).alias("pdt_violation"),
    )
    return _r(m.cost_stats(t), "avg_bars_held", "costs_share")


QUERIES = {q.__name__: q for q in (exposure_report, day_trades, trade_cost_stats)}

EVENT_TRADES = "et as (select event_type book, user_id % 5 account, ts entry_ts, ts + (event_id % 30)*interval 1 hour exit_ts, cast(value/4 as decimal(28, 6)) risk, cast(value*10 as decimal(28, 6)) gross from events)"
ORACLES = {
    "exposure_report": f"""with {EVENT_TRADES}, ch as (select book, entry_ts ts, 1 n, risk, gross from et union all select book, exit_ts, -1, -risk, -gross from et),
st as (select distinct book, ts, sum(n) over w as open, cast(sum(risk) over w as double)/10000*100 heat, cast(sum(gross) over w as double) gross from ch window w as (partition by book order by ts range unbounded preceding))
select book, ts, cast(open as bigint) as open, round(heat, 6) heat_pct, round(gross, 6) gross_usd, concat_ws(',', case when open > 18 then 'positions' end, case when heat > 10 then 'heat' end, case when gross > 35000 then 'leverage' end) breaches from st""",
    "trade_cost_stats": """with c as (select 's' || (l_suppkey % 10) strategy, l_linenumber n, (round(l_discount*100) - 5)*l_quantity g, l_quantity/2 sp, round(l_tax*100) fe, case when l_linenumber > 2 then 0.25e0 else 0 end fi, case when l_returnflag = 'R' then 1.25e0 else 0 end bo from lineitem)
select strategy, round(avg(n), 6) avg_bars_held, sum(sp) spread_slippage, sum(fe) fees, sum(fi) financing, sum(bo) borrow, 0e0 margin_interest, count(*) filter (where n = 7) violations,
sum(sp + fe + fi + bo) costs_usd, round(sum(sp + fe + fi + bo)/(sum(abs(g)) + sum(sp)), 6) costs_share from c group by 1""",
    # five business days before a weekday are seven days before it; a weekend is the start of the Monday after it
    "day_trades": f"""with {EVENT_TRADES}, ny as (select account, date_trunc('second', exit_ts) exit_ts, case when isodow(exit_ts) > 5 then date_trunc('week', exit_ts) + interval 7 days else date_trunc('second', exit_ts) end m from et
  where cast(timezone('America/New_York', timezone('UTC', entry_ts)) as date) = cast(timezone('America/New_York', timezone('UTC', exit_ts)) as date)),
g as (select account, exit_ts, any_value(m) m, count(*) n from ny group by 1, 2)
select a.account, a.exit_ts, a.n, cast(sum(b.n) as bigint) n_recent, sum(b.n) > 120 as over from g a join g b on b.account = a.account and b.m <= a.m and b.m > a.m - interval 7 days group by 1, 2, 3""",
}
