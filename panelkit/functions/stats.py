"""Aggregate expressions: correlation with t, t of a mean, compounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import col

TINY = 1e-9


def t_of_mean(x: Column | str, population: bool = False) -> Column:
    """mean / (std + 1e-9) * sqrt(n), with the sample deviation unless told otherwise."""
    c = col(x)
    std = F.stddev_pop(c) if population else F.stddev_samp(c)
    return F.avg(c) / (std + TINY) * F.sqrt(F.count(c).cast("double"))


def t_of_corr(r: Column, n: Column) -> Column:
    return r * F.sqrt((n - 2) / F.greatest(F.lit(TINY), 1 - r * r))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation of complete pairs; null instead of an error without variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_table(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 8) -> DataFrame:
    """Pearson correlation per group over pairwise complete rows, with n and t.
    Groups below ``min_n`` pairs or without variance on a side are dropped."""
    g = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        pearson(x, y).alias("corr"),
        F.count(F.lit(1)).alias("n"),
    )
    ok = g.filter((F.col("n") >= min_n) & F.col("corr").isNotNull())
    return ok.withColumn("t", t_of_corr(F.col("corr"), F.col("n")))


def compound(log_returns: Column | str) -> Column:
    return F.expm1(F.sum(col(log_returns)))


def growth(ret: Column | str) -> Column:
    """1 + return, and 0 after a total loss or more."""
    r = col(ret)
    return F.when(r > -1, 1 + r).when(r.isNotNull(), F.lit(0.0))


def multiple(ret: Column | str) -> Column:
    """Growth of 1 over all returns of a group; null for a group without returns."""
    return F.when(F.count(col(ret)) > 0, F.product(growth(ret)))


def share_true(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def median(x: Column | str) -> Column:
    return F.percentile(col(x), F.lit(0.5))


def decile_of(rank: Column, n: Column, buckets: int = 10) -> Column:
    """Equal-count bucket (0-based) of a first-come rank among n rows."""
    return F.greatest(F.lit(0), F.ceil((rank - 1) * buckets / (n - 1)) - 1).cast("int")
