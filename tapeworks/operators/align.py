"""As-of alignment of tables in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, known: str, take: list[str], out: str) -> DataFrame:
    """``left`` with a struct ``out`` of the last ``right`` row whose ``known`` time is not after ``at``.

    The row is taken even where its values are null. One shuffle on the keys: both sides are
    tagged and stacked, and the last right row is carried over the time order.
    """
    l = left.withColumn("__t", F.col(at)).withColumn("__side", F.lit(1)).withColumn(out, F.lit(None).cast(_struct(right, take)))
    r = right.select(*by, F.col(known).alias("__t"), F.lit(0).alias("__side"), F.struct(*take).alias(out))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(out, F.last(F.when(F.col("__side") == 0, F.col(out)), ignorenulls=True).over(w)).where("__side = 1").drop("__t", "__side")


def asof_next(left: DataFrame, right: DataFrame, by: list[str], at: str, known: str, take: list[str], out: str) -> DataFrame:
    """``left`` with a struct ``out`` of the first ``right`` row whose ``known`` time is not before ``at``; null without one."""
    l = left.withColumn("__t", F.col(at)).withColumn("__side", F.lit(0)).withColumn(out, F.lit(None).cast(_struct(right, take)))
    r = right.select(*by, F.col(known).alias("__t"), F.lit(1).alias("__side"), F.struct(*take).alias(out))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(0, Window.unboundedFollowing)
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(out, F.first(F.when(F.col("__side") == 1, F.col(out)), ignorenulls=True).over(w)).where("__side = 0").drop("__t", "__side")


def next_event(left: DataFrame, events: DataFrame, at: str, event: str, out: str) -> DataFrame:
    """``left`` with ``out``: the first market-wide event (``event`` of ``events``) not before ``at``; null without one.

    Rows meet the events of their own day; where none is left on it, the first event of the next day that has any comes from
    a list with one row for each day. So no task sorts more than a day.
    """
    e = events.select(F.col(event).alias("__event"), F.to_date(event).alias("__day")).where("__event is not null").distinct()
    l = left.withColumn("__day", F.to_date(at))
    firsts = e.groupBy("__day").agg(F.min("__event").alias("__first"))
    days = l.select("__day").distinct().join(firsts, "__day", "full")
    later = days.select("__day", F.first("__first", ignorenulls=True).over(Window.orderBy("__day").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    same = asof_next(l, e, ["__day"], at, "__event", ["__event"], "__same")
    return same.join(later, "__day", "left").withColumn(out, F.coalesce("__same.__event", "__later")).drop("__day", "__same", "__later")


def asof_filled(left: DataFrame, right: DataFrame, by: list[str], at: str, known: str, value: str, fill) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row not after ``at``, ``fill`` where there is none or it is null (masks, labels)."""
    got = asof(left, right, by, at, known, [value], "__asof")
    return got.withColumn(value, F.coalesce(F.col(f"__asof.{value}"), F.lit(fill))).drop("__asof")


def clear_of_earnings(bars: DataFrame, earnings: DataFrame, days_before: int, days_after: int) -> DataFrame:
    """Bars whose date is not within ``days_before`` days before to ``days_after`` days after an earnings date of their symbol."""
    near = earnings.select("symbol", F.explode(F.sequence(F.date_sub("d", days_before), F.date_add("d", days_after))).alias("__d")).distinct()
    return bars.withColumn("__d", F.to_date("ts")).join(near, ["symbol", "__d"], "left_anti").drop("__d")


def _struct(df: DataFrame, take: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in take) + ">"


def align_higher(base: DataFrame, base_seconds: int, higher: DataFrame, higher_seconds: int, take: list[str], out: str = "higher") -> DataFrame:
    """For each base bar the last higher bar that has closed when the base bar closes."""
    end = lambda s: F.col("ts") + F.expr(f"interval {s} seconds")
    b = base.withColumn("__end", end(base_seconds))
    return asof(b, higher.withColumn("__known", end(higher_seconds)), ["symbol"], "__end", "__known", take, out).drop("__end")


def daily_labels(labels: DataFrame) -> DataFrame:
    """The last label of each day."""
    return labels.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.max_by("label", "ts").alias("label"))


def outside_events(bars: DataFrame, events: DataFrame, before: str, after: str) -> DataFrame:
    """Bars with no event in [ts - before, ts + after] (both ends count); event times are bucketed by hour for an equi-join."""
    hours = F.sequence(F.date_trunc("hour", F.col("ts") - F.expr(f"interval {before}")), F.date_trunc("hour", F.col("ts") + F.expr(f"interval {after}")), F.expr("interval 1 hour"))
    e = events.select(F.col("ts").alias("event_ts"), F.date_trunc("hour", "ts").alias("h"))
    b = bars.select("symbol", "tf", "ts", F.explode(hours).alias("h"))
    inside = (F.col("event_ts") >= F.col("ts") - F.expr(f"interval {before}")) & (F.col("event_ts") <= F.col("ts") + F.expr(f"interval {after}"))
    hit = b.join(e, "h").where(inside).select("symbol", "tf", "ts").distinct()
    return bars.join(hit, ["symbol", "tf", "ts"], "left_anti")


def ny(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "America/New_York")
