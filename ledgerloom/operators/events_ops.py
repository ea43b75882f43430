"""Streaks, gaps, windows and correlations over (user_id, day) events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by():
    return Window.partitionBy("user_id").orderBy("day")


def days_of(events: DataFrame) -> DataFrame:
    """Distinct (user_id, day)."""
    return events.select("user_id", F.to_date("ts").alias("day")).distinct()


def trailing_sessions(events: DataFrame, days: int = 7, least: int = 3) -> DataFrame:
    """First day on which a user has at least ``least`` sessions within the trailing days."""
    counted = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("user_id").orderBy("number").rangeBetween(-(days - 1), 0)
    hits = counted.withColumn("number", number).withColumn("seen", F.sum("n").over(w)).filter(F.col("seen") >= least)
    return hits.groupBy("user_id").agg(F.min("day").alias("day"), F.min_by("seen", "day").alias("seen"))


def returns(events: DataFrame, gap: int) -> DataFrame:
    """Days after a gap of at least ``gap`` days."""
    d = days_of(events).withColumn("before", F.lag("day").over(_by()))
    return d.withColumn("gap", F.datediff("day", "before")).filter(F.col("gap") >= gap).select("user_id", "day", "gap")


def islands(days: DataFrame) -> DataFrame:
    """Runs of consecutive days: user_id, first, last, length."""
    run = F.date_sub("day", F.row_number().over(_by()))
    return days.withColumn("run", run).groupBy("user_id", "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("length")).drop("run")


def first_run(events: DataFrame, length: int) -> DataFrame:
    """First day on which a run of consecutive days reaches a length."""
    hit = islands(days_of(events)).filter(F.col("length") >= length)
    return hit.groupBy("user_id").agg(F.min(F.date_add("first", length - 1)).alias("day"))


def clear_spans(events: DataFrame, trigger: Column, days: int) -> DataFrame:
    """Users' first span of ``days`` without a trigger, by the day on which it ends.

    That is the last day where there is no trigger at all, else the day before the first trigger that comes so
    long after the first event or after the trigger before it.
    """
    day = F.to_date("ts")
    ends = events.groupBy("user_id").agg(F.min(day).alias("since"), F.max(day).alias("until"))
    t = events.filter(trigger).select("user_id", day.alias("day")).distinct().withColumn("before", F.lag("day").over(_by()))
    none = ends.join(t.select("user_id").distinct(), "user_id", "left_anti").filter(F.datediff("until", "since") >= days).select("user_id", F.col("until").alias("day"))
    spans = t.join(ends, "user_id").filter(F.datediff("day", F.coalesce("before", "since")) >= days)
    return none.unionByName(spans.groupBy("user_id").agg(F.date_sub(F.min("day"), 1).alias("day")))


def first_of_week(events: DataFrame, win: Column) -> DataFrame:
    """First winning event of each user and ISO week."""
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date")
    return events.filter(win).groupBy("user_id", week.alias("week")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def streaks(events: DataFrame, least: float) -> DataFrame:
    """Longest run of days whose mean value reaches ``least``, by user."""
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    runs = islands(daily.filter(F.col("mean") >= least).select("user_id", "day"))
    return runs.groupBy("user_id").agg(F.max("length").alias("record"), F.max_by("length", "last").alias("current"))


def latest_per_week(events: DataFrame) -> DataFrame:
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date")
    return events.groupBy("user_id", week.alias("week")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


def first_last(events: DataFrame) -> DataFrame:
    """First and last value and their difference by user."""
    at = F.struct("ts", "event_id")
    out = events.groupBy("user_id").agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"))
    return out.withColumn("delta", F.round(F.col("last") - F.col("first"), 6))


def by_flag(events: DataFrame, flag: Column) -> DataFrame:
    """Mean of users' daily values on days with and without a flagged event."""
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"), F.max(flag.cast("int")).alias("flag"))
    return daily.groupBy("flag").agg(F.round(F.avg("mean"), 6).alias("mean"), F.count("*").alias("days"))


def correlation(events: DataFrame) -> DataFrame:
    """Pearson r of daily mean and daily count, with its class; null below three days."""
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("y"))
    out = daily.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).withColumn("r", F.when(F.col("n") >= 3, F.round("r", 6)))
    a = F.abs("r")
    return out.withColumn("class", F.when(a < 0.2, "nenhuma").when(a < 0.4, "fraca").when(a < 0.7, "moderada").when(a.isNotNull(), "forte"))
