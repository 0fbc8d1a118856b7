"""Ranges of missing trading days, of all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import rolling as R
from panelkit.operators.months import calendar_broadcast


def trading_calendar(spark, start: Column, end: Column, holidays: DataFrame) -> DataFrame:
    """(date, n): weekdays from start to end that are no holidays, numbered from 1."""
    days = spark.range(1).select(F.explode(F.sequence(start, end)).alias("date")).filter(F.weekday("date") < 5)
    open_days = days.join(calendar_broadcast(holidays.select("date").distinct()), "date", "left_anti")
    return open_days.withColumn("n", F.row_number().over(R.series_window()))


def missing_ranges(held: DataFrame, calendar: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, first_missing, last_missing, n_days): maximal stretches of calendar days that
    a key does not hold, before its first row, between rows, and after its last. Held days
    outside the calendar are left out; a key needs one day inside it to appear.

    A key's held days carry their numbers, and a step of more than one to the row before
    is a gap: one window over the held rows, no anti-join of keys with days. The calendar
    is one row per date and is broadcast.
    """
    days = held.select(key, "date").distinct().join(calendar_broadcast(calendar), "date").select(key, "n")
    w = Window.partitionBy(key).orderBy("n")
    before = F.struct((F.coalesce(F.lag("n").over(w), F.lit(0)) + 1).alias("a"), (F.col("n") - 1).alias("b"))
    after = F.when(F.lead("n").over(w).isNull(), F.struct((F.col("n") + 1).alias("a"), F.col("_last").alias("b")))
    stepped = days.withColumn("_last", calendar.select(F.max("n")).scalar()).select(key, F.array_compact(F.array(before, after)).alias("_g"))
    gaps = stepped.select(key, F.inline("_g")).filter("a <= b")
    first, final = (calendar.select(F.col("n").alias(n), F.col("date").alias(d)) for n, d in (("a", "first_missing"), ("b", "last_missing")))
    named = gaps.join(calendar_broadcast(first), "a").join(calendar_broadcast(final), "b")
    return named.select(key, "first_missing", "last_missing", (F.col("b") - F.col("a") + 1).alias("n_days"))
