"""Exact medians and quantiles of groups of any size, by counting.

Rows are first counted by group and bin, map-side: bins keep the order of values, so counts
of bins tell which bin holds a group's middle, and only its rows are looked at closer. There
equal values are counted first, so a value that many rows share is one row. The
distinct values are range-partitioned by (group, value) and carry the number of rows
before them (``ranks.prefix_sums``); the one or two middle values are then a plain filter.
No task ever holds a group: a group of a hundred million distinct values is spread over as
many tasks as its size needs, and very many small groups cost one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.ranks import prefix_sums
from panelkit.session import materialize


#: Bins per natural logarithm of a value: each is 1% wide.
PER_LOG = 100


def value_bin(value: Column) -> Column:
    """A whole number that never falls as the value rises, NaN above all as Spark sorts it."""
    x = value.cast("double")
    # logarithms of doubles lie between -745 and 710; infinite ones are cut there
    size = F.floor(F.least(F.ln(F.abs(x)), F.lit(800.0)) * PER_LOG) + 1000 * PER_LOG
    return F.when(F.isnan(x), F.lit(10_000 * PER_LOG).cast("long")).when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def quantiles(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """(*keys, out): the ``q`` quantile of the group's non-null values, linear between
    the two nearest; groups without values have no row, but without keys there
    is always one (null of no values). Nulls in keys form groups."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).withColumn("_bin", value_bin(F.col("_v")))
    bins = known.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    places = bins.withColumns(
        {"_start": F.sum("_n").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), "_size": F.sum("_n").over(group)}
    ).withColumn("_at", (F.col("_size") - 1) * F.lit(float(q)))
    low, high = F.floor("_at"), F.ceil("_at")
    # the rows of a bin are places _start to _start + _n - 1 of the group
    holds = lambda place, start, n: (start <= place) & (place < start + n)
    chosen = places.filter(holds(low, F.col("_start"), F.col("_n")) | holds(high, F.col("_start"), F.col("_n")))
    chosen = chosen.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_b"), "_start", low.alias("_low"), high.alias("_high"), (F.col("_at") - low).alias("_share"))
    # one or two bins a group, written so that Spark sees how small the table is
    chosen = materialize(chosen, "selection-bins")
    same = F.col("_bin") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    near = known.join(chosen, same).groupBy(*keys, "_bin", "_start", "_low", "_high", "_share", "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_sums(near, [*keys, "_bin"], [F.col("_v")], "selection", _before=F.col("_n"))
    first = F.col("_start") + F.col("_before")
    middle = placed.filter(holds(F.col("_low"), first, F.col("_n")) | holds(F.col("_high"), first, F.col("_n")))
    # the upper value counts only where the place is not whole: of two rows the larger value
    g = middle.groupBy(*keys).agg(F.min("_v").cast("double").alias("_a"), F.max("_v").cast("double").alias("_b"), F.first("_share").alias("_share"))
    return g.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias(out))


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return quantiles(df, keys, value, 0.5, out)
