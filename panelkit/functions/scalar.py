"""Scalar column expressions. Nulls propagate: Spark's ``least``/``greatest``
skip nulls, so clipping is written with CASE WHEN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float, hi: float) -> Column:
    x = col(c)
    return F.when(x > hi, F.lit(float(hi))).when(x < lo, F.lit(float(lo))).otherwise(x)


def floor_at(c: Column | str, lo: float) -> Column:
    x = col(c)
    return F.when(x < lo, F.lit(float(lo))).otherwise(x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Sources may carry NaN; Spark sorts NaN above every number and aggregates do
    not skip it, so it becomes NULL on the way in."""
    return df.select(
        *[
            F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division that yields null for a zero denominator."""
    return F.try_divide(col(num), col(den))


def simple_return(close: Column | str, ldcp: Column | str, lo: float = -0.9, hi: float = 4.0) -> Column:
    return clip(col(close) / col(ldcp) - 1, lo, hi)


def annual_to_daily(rate: Column | float, ppy: int) -> Column:
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.pow(1 + r, F.lit(1.0 / ppy)) - 1


def period_carry(rate_pct: Column | str, months: Column | int) -> Column:
    """Financing of a position over ``months`` at an annual percentage rate."""
    m = months if isinstance(months, Column) else F.lit(months)
    return col(rate_pct) / 100 * m / 12


def net_return(gross: Column | str, cost: float, carry: Column | str, invested: Column | None = None) -> Column:
    """Gross minus cost and carry while invested; the cash leg earns the carry."""
    net = col(gross) - cost - col(carry)
    if invested is None:
        return net
    return F.when(invested, net).otherwise(col(carry))


def same_sign(a: Column | str, b: Column | str) -> Column:
    """True/false, or null when either side is zero or null."""
    sa, sb = F.signum(col(a)), F.signum(col(b))
    return F.when((sa != 0) & (sb != 0), sa == sb)


def mood_label(score: Column | str) -> Column:
    """Left-closed bands: 20.0 belongs to the second one."""
    x = col(score)
    out = F.when(x < fv.MOOD_EDGES[1], fv.MOOD_BANDS[0])
    for edge, name in zip(fv.MOOD_EDGES[2:-1], fv.MOOD_BANDS[1:-1]):
        out = out.when(x < edge, name)
    return out.when(x >= fv.MOOD_EDGES[-2], fv.MOOD_BANDS[-1])


def mood_band(score: Column | str) -> Column:
    """Right-closed bands with the lowest edge included: 20.0 belongs to the first."""
    x = col(score)
    out = F.when(x < fv.MOOD_EDGES[0], None)
    for edge, name in zip(fv.MOOD_EDGES[1:], fv.MOOD_BANDS):
        out = out.when(x <= edge, name)
    return out


def three_way(c: Column | str, low: float, high: float, below: int, above: int) -> Column:
    """``below`` under the low threshold, ``above`` over the high one, else 0."""
    x = col(c)
    return F.when(x < low, below).when(x > high, above).when(x.isNotNull(), 0)


def rate_bucket(rate: Column | str, low: float = 10.0, high: float = 15.0) -> Column:
    x = col(rate)
    return F.when(x < low, "low").when(x < high, "mid").when(x >= high, "high")


def month_start(date: Column | str) -> Column:
    return F.trunc(col(date), "MM").cast("date")


def month_index(date: Column | str) -> Column:
    """Calendar months as one integer, so month arithmetic is plain addition."""
    d = col(date)
    return F.year(d) * 12 + F.month(d)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns of a report table; other columns are untouched.

    Values pass through single precision first: round prices multiply to exact decimal
    ties, which summation order would round either way, and no such tie survives there.
    """
    return df.select(
        *[
            F.round(F.col(f.name).cast("float").cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
