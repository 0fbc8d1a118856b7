"""Equal-weight baskets. Each is a group-by with partial aggregation, so a date
with very many symbols is combined map-side before the shuffle. The start filter
follows the windows and means, which need the earlier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import stats as S
from panelkit.operators.clean import is_liquid
from panelkit.operators.selection import medians


def market_index(prices: DataFrame, min_adv: float, start: str | None = None) -> DataFrame:
    """(date, mkt_r): mean return of liquid names."""
    out = prices.filter(is_liquid(min_adv)).groupBy("date").agg(F.avg("r1").alias("mkt_r"))
    return from_date(out, start)


def market_breadth(prices: DataFrame, min_adv: float, start: str | None = None) -> DataFrame:
    """(date, breadth): share of liquid names that rose."""
    up = F.coalesce(F.col("r1") > 0, F.lit(False))
    out = prices.filter(is_liquid(min_adv)).groupBy("date").agg(S.share_true(up).alias("breadth"))
    return from_date(out, start)


def sector_daily_returns(prices: DataFrame, min_adv: float, start: str | None = None) -> DataFrame:
    """(date, sector, r), long; pivot only for display."""
    liquid = prices.filter(is_liquid(min_adv) & F.col("is_equity"))
    out = liquid.groupBy("date", F.col("sector_name").alias("sector")).agg(F.avg("r1").alias("r"))
    return from_date(out, start)


def from_date(df: DataFrame, start: str | None) -> DataFrame:
    return df if start is None else df.filter(F.col("date") >= F.lit(start).cast("date"))


def group_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median per group, exact and split: no task holds a group."""
    return medians(df, keys, value, out)


def abnormal_returns(sector_daily: DataFrame, market: DataFrame) -> DataFrame:
    """(date, sector, abn): sector minus market on common dates."""
    from panelkit.operators.months import calendar_broadcast

    return sector_daily.join(calendar_broadcast(market), "date").select(
        "date", "sector", (F.col("r") - F.col("mkt_r")).alias("abn")
    )
