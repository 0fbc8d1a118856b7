"""As-of joins without theta joins.

Keyed or not, the lookup runs on the *distinct* (key, date) pairs: both sides are
reduced map-side, unioned, and filled by one window whose partitions hold at most
one row per calendar date. The answer then joins back on equality, so a key that
owns a third of all rows never meets in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import rolling as R


def _lookup(points: DataFrame, steps: DataFrame, keys: list[str], value: str, forward: bool, fill_early: bool, order: str | None) -> DataFrame:
    v = F.col(value)
    if order is None:
        unclear = F.raise_error(F.lit(f"several values of {value} on one date: name the column that orders them"))
        one = F.when(F.min(v) == F.max(v), F.max(v)).otherwise(unclear)
    else:
        one = F.max_by(v, F.col(order))
    latest = steps.filter(v.isNotNull()).groupBy(*keys, "date").agg(one.alias("_v"))
    asked = points.select(*keys, "date").distinct().withColumn("_ask", F.lit(True))
    both = latest.join(asked, [*keys, "date"], "full")
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    following = R.fill_backward("_v", group.orderBy(F.desc("date")))
    found = following if forward else R.fill_forward("_v", group.orderBy("date"))
    if fill_early:
        found = F.coalesce(found, following)
    return both.withColumn(value, found).filter("_ask").select(*keys, "date", value)


def latest_per_date(steps: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keep the last of several decisions on one date, by an explicit order column."""
    return steps.groupBy(*keys, "date").agg(F.max_by(value, order).alias(value))


def backward_asof(df: DataFrame, steps: DataFrame, value: str, keys: tuple[str, ...] = (), fill_early: bool = False, order: str | None = None) -> DataFrame:
    """Add the last ``value`` at or before each row's date; ``fill_early`` gives dates
    before the first step the first one's value. Of several steps on one (keys, date) the
    last by ``order`` holds; without an order different values on one date are an error."""
    ks = list(keys)
    return df.join(_lookup(df, steps, ks, value, False, fill_early, order), [*ks, "date"], "left")


def forward_asof(df: DataFrame, steps: DataFrame, value: str, keys: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Add the first ``value`` at or after each row's date; null when none follows. Steps
    on one date as in ``backward_asof``."""
    ks = list(keys)
    return df.join(_lookup(df, steps, ks, value, True, False, order), [*ks, "date"], "left")


def rate_order(rates: DataFrame) -> str | None:
    """The column that orders decisions on one date, where the frame has one."""
    return "seq" if "seq" in rates.columns else None


def on_calendar(series: DataFrame, dates: DataFrame, value: str) -> DataFrame:
    """A sparse series carried forward onto a denser list of dates."""
    return backward_asof(dates.select("date").distinct(), series, value)
