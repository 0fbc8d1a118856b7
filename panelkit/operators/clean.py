"""From raw symbol-by-day rows to the clean price panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv
from panelkit.functions import rolling as R
from panelkit.functions.scalar import simple_return
from panelkit.operators.dims import add_sector


def is_common_equity() -> Column:
    """False for dashed contracts, rights, debt lines, and rows without a positive
    previous close. ``name`` separates rights from symbols that merely end in R."""
    s, name = F.col("symbol"), F.coalesce(F.col("name"), F.lit(""))
    rights = s.rlike("R[0-9]$") | (s.rlike("R[0-9]?$") & name.contains("(R"))
    debt = s.rlike("^P[0-9]{2}") | s.contains("TFC") | s.contains("SUK")
    return ~s.contains("-") & ~rights & ~debt & (F.col("ldcp") > 0)


def drop_non_equity(df: DataFrame) -> DataFrame:
    return df.filter(is_common_equity())


def add_returns(df: DataFrame) -> DataFrame:
    """Clipped adjusted return, its log, and traded value."""
    return (
        df.withColumn("r1", simple_return("close", "ldcp"))
        .withColumn("logr", F.log1p("r1"))
        .withColumn("value", F.col("close") * F.col("volume"))
    )


def add_history(df: DataFrame) -> DataFrame:
    """Row number, cumulative log return and 20-row median traded value per symbol, over
    one exchange and sort on (symbol, date)."""
    w = R.symbol_window()
    df = df.withColumns({"pos": F.row_number().over(w), "cumlog": R.running_sum("logr", w), "_v20": R.frame_values("value", 20, w)})
    return R.add_medians(df, {"adv_20": ("_v20", 5)})


def price_panel(raw: DataFrame, sectors: DataFrame, partitions: int | None = None) -> DataFrame:
    """The clean panel. Filters sit before the windows because dropped lines must not
    count as rows of a symbol; the liquidity filter comes later for the same reason.
    With ``partitions``, the one exchange of the windows also places the rows for a
    table bucketed by symbol."""
    clean = drop_non_equity(raw.withColumn("sector", F.trim("sector")))
    if partitions:
        clean = clean.repartition(partitions, "symbol")
    return add_sector(add_history(add_returns(clean)), sectors)


def is_liquid(min_adv: float, traded: bool = False) -> Column:
    ok = F.col("adv_20") > min_adv
    return ok & (F.col("volume") > 0) if traded else ok


def parse_contracts(raw: DataFrame) -> DataFrame:
    """(date, base) of single-stock contracts named BASE-MMM."""
    parts = F.split("symbol", "-")
    return (
        raw.filter(F.col("symbol").contains("-"))
        .select("date", F.element_at(parts, 1).alias("base"), F.upper(F.element_at(parts, -1)).alias("month"))
        .filter(F.col("month").isin(fv.CONTRACT_MONTHS))
        .filter(~F.col("base").isin(fv.INDEX_BASES) & ~F.col("base").contains("ETF"))
        .select("date", "base")
    )


def contract_months(contracts: DataFrame) -> DataFrame:
    """Distinct (base, ym) in which a contract traded."""
    return contracts.select("base", F.trunc("date", "MM").alias("ym")).distinct()


def eligible_now(contracts: DataFrame, days: int = 60) -> DataFrame:
    """Bases with a contract in the trailing days before the last date."""
    cut = contracts.select(F.date_sub(F.max("date"), days)).scalar()
    return contracts.filter(F.col("date") >= cut).select("base").distinct()
