"""Reports over finished trades: what was open at once, and round trips within days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.align import ny


def exposure(trades: DataFrame, equity: float, max_positions: int = 10, max_heat_pct: float = 12.0, max_leverage: float = 2.0) -> DataFrame:
    """(book, ts, open, heat_pct, gross_usd, breaches): state after each time at which trades of a book begin or end.

    ``trades``: book, entry_ts, exit_ts, risk_usd, gross_usd. Entries add and exits take away; heat is the open
    risk in percent of ``equity``. Changes are summed by time and by day first. Days before are carried over
    from one row a day, so what is sorted together is one day of one book.
    ``breaches`` names the limits passed: positions, heat, leverage. Amounts are summed in decimals, so an empty book is exactly zero.
    """
    exact = lambda c: F.col(c).cast("decimal(28,6)")
    change = lambda at, s: trades.select("book", F.col(at).alias("ts"), F.lit(s).cast("long").alias("n"), (exact("risk_usd") * s).alias("risk"), (exact("gross_usd") * s).alias("gross"))
    both = change("entry_ts", 1).unionByName(change("exit_ts", -1)).where("ts is not null")
    sums = [F.sum(c).cast(t).alias(c) for c, t in (("n", "long"), ("risk", "decimal(38,6)"), ("gross", "decimal(38,6)"))]
    at = both.groupBy("book", "ts").agg(*sums).withColumn("day", F.to_date("ts"))
    past = Window.partitionBy("book").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = at.groupBy("book", "day").agg(*sums)
    base = days.select("book", "day", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}0") for c in ("n", "risk", "gross")])
    run = Window.partitionBy("book", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    state = at.join(base, ["book", "day"]).select("book", "ts", *[(F.col(f"{c}0") + F.sum(c).over(run)).alias(c) for c in ("n", "risk", "gross")])
    heat, gross = F.col("risk").cast("double") / equity * 100, F.col("gross").cast("double")
    over = F.array_compact(F.array(F.when(F.col("n") > max_positions, "positions"), F.when(heat > max_heat_pct, "heat"), F.when(gross > max_leverage * equity, "leverage")))
    return state.select("book", "ts", F.col("n").alias("open"), heat.alias("heat_pct"), gross.alias("gross_usd"), F.array_join(over, ",").alias("breaches"))


def business_seconds(ts: Column) -> Column:
    """Seconds on a clock that stands still at weekends: Saturdays and Sundays are the start of Monday."""
    day = F.datediff(ts, F.lit("1970-01-05").cast("date"))  # a Monday
    week, at = F.floor(day / 7), F.pmod(day, F.lit(7))
    second = F.when(at < 5, F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).otherwise(0)
    return ((week * 5 + F.least(at, F.lit(5))) * 86400 + second).cast("long")


def round_trips(trades: DataFrame, days: int = 5, most: int = 3) -> DataFrame:
    """(account, exit_ts, n, n_recent, over): exits of trades begun on the same New York date, with those of the trailing business days.

    ``n_recent`` counts the account's same-day exits later than ``days`` business days before the exit, itself
    included; ``over`` says that they are more than ``most``. Exits of one second are one row, of ``n`` trades. Every
    exit adds to the count at its time on the business clock and is taken away ``days`` business days later, so the count is a
    running sum. Days before are carried over from one row a day: what is sorted together is one business day of one account.
    """
    same = trades.where(F.to_date(ny(F.col("entry_ts"))) == F.to_date(ny(F.col("exit_ts"))))
    at = same.groupBy("account", F.date_trunc("second", "exit_ts").alias("exit_ts")).agg(F.count("*").alias("n")).withColumn("k", business_seconds(F.col("exit_ts")))
    gone = at.groupBy("account", "k").agg(F.sum("n").alias("n")).select("account", F.lit(None).cast("timestamp").alias("exit_ts"), (-F.col("n")).alias("n"), (F.col("k") + days * 86400).alias("k"))
    both = at.select("account", "exit_ts", "n", "k").unionByName(gone).withColumn("day", F.floor(F.col("k") / 86400))
    past = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = both.groupBy("account", "day").agg(F.sum("n").alias("n0")).select(F.col("account").alias("__account"), "day", F.coalesce(F.sum("n0").over(past), F.lit(0)).alias("n0"))
    run = Window.partitionBy("account", "day").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    state = both.withColumn("n1", F.sum("n").over(run)).withColumnRenamed("day", "__day")
    state = state.join(base, F.col("account").eqNullSafe(F.col("__account")) & (F.col("__day") == F.col("day"))).where("exit_ts is not null")
    return state.withColumn("n_recent", F.col("n0") + F.col("n1")).select("account", "exit_ts", "n", "n_recent", (F.col("n_recent") > most).alias("over"))
