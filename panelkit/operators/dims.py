"""The sector dimension and name resolution. Dimension tables are joined without
hints: Spark broadcasts them while they are under its own size threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv


def standard_sectors(spark: SparkSession) -> DataFrame:
    """(code, name, is_equity, is_operating) of the standard taxonomy."""
    df = spark.createDataFrame(fv.SECTORS, "code string, name string")
    return sector_dimension(df, fv.SEGMENTS, fv.FUND_SECTORS)


def sector_dimension(codes: DataFrame, segments: list[str], funds: list[str]) -> DataFrame:
    """Flags: segments are no economic sectors; funds are sectors but no businesses."""
    equity = ~F.col("code").isin(segments)
    return codes.select(
        "code", "name", equity.alias("is_equity"), (equity & ~F.col("code").isin(funds)).alias("is_operating")
    )


def add_sector(df: DataFrame, dim: DataFrame) -> DataFrame:
    """sector_name and is_equity by code; an unknown code shows as ``[code]``."""
    d = dim.select(F.col("code").alias("_code"), F.col("name").alias("_name"), F.col("is_equity").alias("_eq"))
    joined = df.join(d, F.trim("sector") == F.col("_code"), "left")
    return joined.withColumns(
        {
            "sector_name": F.coalesce("_name", F.concat(F.lit("["), F.col("sector"), F.lit("]"))),
            "is_equity": F.coalesce("_eq", F.lit(False)),
        }
    ).drop("_code", "_name", "_eq")


def operating_names(dim: DataFrame) -> DataFrame:
    return dim.filter("is_operating").select(F.col("name").alias("sector"))


def sector_codes(names: DataFrame, col: str = "sector_name") -> DataFrame:
    """Position of each name among the sorted distinct names. The window runs over
    the distinct names only, which the taxonomy bounds."""
    from panelkit.functions.rolling import series_window

    return names.select(col).distinct().withColumn(
        "sector_code", (F.row_number().over(series_window(col)) - 1).cast("double")
    )


def sector_aliases(spark: SparkSession) -> DataFrame:
    """(alias, name) of the known spelling variants."""
    return spark.createDataFrame(fv.SECTOR_ALIASES, "alias string, name string")


def normalize_names(df: DataFrame, col: str, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve ``col``: exact canonical name, then alias, then case-insensitive match,
    else unchanged. ``canonical`` has (name); ``aliases`` has (alias, name)."""
    exact = canonical.select(F.col("name").alias("_exact"))
    alias = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_by_alias"))
    lowered = canonical.groupBy(F.lower("name").alias("_lower")).agg(F.min("name").alias("_by_case"))
    key = F.trim(col)
    return (
        df.join(exact, key == F.col("_exact"), "left")
        .join(alias, key == F.col("_alias"), "left")
        .join(lowered, F.lower(key) == F.col("_lower"), "left")
        .withColumn(col, F.coalesce("_exact", "_by_alias", "_by_case", key))
        .drop("_exact", "_alias", "_by_alias", "_lower", "_by_case")
    )


def unresolved_names(references: dict[str, DataFrame], canonical: DataFrame) -> DataFrame:
    """Distinct (kind, name) that the dimension does not know, e.g. to be reported
    at load. Each reference frame has one ``name`` column."""
    tagged = [df.select(F.lit(kind).alias("kind"), "name") for kind, df in references.items()]
    return reduce(DataFrame.unionByName, tagged).join(canonical.select("name"), "name", "left_anti").select(
        "kind", "name"
    ).distinct()
