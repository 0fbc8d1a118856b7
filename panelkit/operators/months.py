"""Calendar grids and monthly compounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import rolling as R
from panelkit.functions.scalar import month_start


def calendar_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a frame with at most one row per date or month. A century of daily
    rows is about 36,500, so the calendar proves the size bound."""
    return F.broadcast(df)


def month_rank(df: DataFrame, ym: str = "ym") -> DataFrame:
    """(ym, m_rank): consecutive numbers of the months present in a frame."""
    return df.select(ym).distinct().withColumn("m_rank", F.row_number().over(R.series_window(ym)))


def monthly_market(market: DataFrame, ret: str = "mkt_r") -> DataFrame:
    """Daily simple returns compounded to (ym, mkt_m)."""
    return market.groupBy(month_start("date").alias("ym")).agg(F.expm1(F.sum(F.log1p(ret))).alias("mkt_m"))


def monthly_sectors(sector_daily: DataFrame) -> DataFrame:
    """(ym, sector, ret) on the dense month x sector grid.

    A sector-month without a return compounds nothing and is a 0% month, so every
    sector gets a row for every month in which any sector traded. Both axes are
    bounded: months by the calendar and sectors by the taxonomy.
    """
    sums = sector_daily.groupBy(month_start("date").alias("ym"), "sector").agg(F.sum(F.log1p("r")).alias("_s"))
    months = sums.select(F.sort_array(F.collect_set("ym"))).scalar()
    grid = sums.select("sector").distinct().select("sector", F.explode(months).alias("ym"))
    return grid.join(sums, ["ym", "sector"], "left").select(
        "ym", "sector", F.expm1(F.coalesce("_s", F.lit(0.0))).alias("ret")
    )


def last_of_month(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Last non-null value of a daily series in each month."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, month_start("date").alias("ym"))
        .agg(F.max_by(value, "date").alias(out))
    )
