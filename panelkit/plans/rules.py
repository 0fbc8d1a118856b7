"""The rule-based picks, their gate, live marks and gated period returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv
from panelkit.functions import stats as S
from panelkit.functions.scalar import month_start, net_return, period_carry
from panelkit.operators import xsection as X
from panelkit.operators.asof import backward_asof
from panelkit.operators.months import calendar_broadcast
from panelkit.operators.trend import drawdowns, trend_flags
from panelkit.plans.evaluate import by_horizon, every_h_th

PICK_COLUMNS = ["ym", "date", "symbol", "sector_name", "close", "cumlog", "mom_3m", "dist_252h", "adv_growth"]


def rule_score(rows: DataFrame, key: str | list[str] = "ym") -> DataFrame:
    """Adds ``score``: z(3-month momentum) + z(distance below the high) + z(growth of
    traded value, missing as 0), per month."""
    parts = {"_a": F.col("mom_3m"), "_b": -F.col("dist_252h"), "_c": F.coalesce("adv_growth", F.lit(0.0))}
    return X.zscores(rows, parts, key).withColumn("score", F.col("_a") + F.col("_b") + F.col("_c")).drop("_a", "_b", "_c")


def picks_for(panel: DataFrame, market: DataFrame, ym, k: int = 5) -> DataFrame:
    """Top-k of one month with the gate state at its entry date; empty when the month
    has fewer than k eligible rows. ``ym`` is a date literal or a scalar column."""
    month = panel.filter("eligible").filter(F.col("ym") == (F.lit(ym).cast("date") if isinstance(ym, str) else ym))
    enough = month.select(F.count("symbol") >= k).scalar()
    entry = month.select(F.max("date")).scalar()
    top = X.top_k(rule_score(month.select(*PICK_COLUMNS)), "score", k, ["ym"]).filter(enough)
    placed = top.select("ym", "symbol", "sector_name", "rank", "score", "mom_3m", F.col("close").alias("entry_close"), entry.alias("date"))
    gated = backward_asof(placed, trend_flags(market).select("date", "exposure"), "exposure")
    return gated.withColumnRenamed("date", "entry_date").withColumn("risk_on", F.col("exposure") >= 0.5)


def mark_to_latest(picks: DataFrame, prices: DataFrame, keep_unmarked: bool = False, as_of: str | None = None) -> DataFrame:
    """Adds last close and return since entry. A leg needs a level on both dates; with
    ``keep_unmarked`` it stays with a null return instead of dropping out. ``as_of`` takes
    no price after that date, as if later ones were not known yet."""
    if as_of is not None:
        prices = prices.filter(F.col("date") <= F.lit(as_of).cast("date"))
    last = prices.select(F.max("date")).scalar()
    how = "left" if keep_unmarked else "inner"
    held = prices.select("symbol", "date", "cumlog", "close").join(picks.select("symbol"), "symbol", "left_semi")
    at_entry = held.select("symbol", F.col("date").alias("entry_date"), F.col("cumlog").alias("_c0"))
    at_last = held.filter(F.col("date") == last).select("symbol", F.col("cumlog").alias("_c1"), F.col("close").alias("last_close"))
    return (
        picks.join(at_entry, ["symbol", "entry_date"], how).join(at_last, "symbol", how)
        .withColumns({"ret": F.expm1(F.col("_c1") - F.col("_c0")), "as_of": last}).drop("_c0", "_c1")
    )


def interim_performance(marked: DataFrame) -> DataFrame:
    """One row: basket return over the marked legs, what the gate really held, and the
    days held."""
    g = marked.groupBy("entry_date", "as_of", "risk_on").agg(F.count("ret").alias("legs"), F.avg("ret").alias("basket_ret"))
    return g.withColumns(
        {
            "applied_ret": F.when(F.col("risk_on"), F.col("basket_ret")).otherwise(0.0),
            "days_held": F.datediff("as_of", "entry_date"),
        }
    )


def gated_periods(panel: DataFrame, market: DataFrame, macro: DataFrame, horizons: tuple[int, ...] = (1, 2, 3), k: int = 5, min_rows: int = 15, cost: float = fv.COST_PICKS) -> DataFrame:
    """(H, ym, date, gross, carry, risk_on, ret): every H-th month with an outcome, top-k
    net of cost and carry while the trend is on, the carry otherwise."""
    long = by_horizon(panel.filter("eligible"), horizons, PICK_COLUMNS).filter("fwd is not null")
    months = every_h_th(long.select("H", "ym").distinct())
    sized = long.groupBy("H", "ym").agg(F.count("symbol").alias("_n"), F.max("date").alias("date")).filter(F.col("_n") >= min_rows)
    entries = months.join(sized.drop("_n"), ["H", "ym"])
    rows = long.drop("date").join(calendar_broadcast(entries), ["H", "ym"])
    top = X.top_k(rule_score(rows, ["H", "ym"]), "score", k, ["H", "ym"])
    gross = top.groupBy("H", "ym", "date").agg(F.avg("fwd").alias("gross"))
    exposure = trend_flags(market).select("date", "exposure")
    rate = macro.select(month_start("date").alias("ym"), "policy_rate", F.lit(True).alias("_known"))
    priced = backward_asof(gross, exposure, "exposure").join(calendar_broadcast(rate), "ym", "left")
    level = F.when(F.col("_known"), F.col("policy_rate")).otherwise(fv.FALLBACK_RATE)
    carry = period_carry(level, F.col("H"))
    priced = priced.withColumns({"carry": carry, "risk_on": F.coalesce(F.col("exposure") >= 0.5, F.lit(False))})
    return priced.select("H", "ym", "date", "gross", "carry", "risk_on", net_return("gross", cost, "carry", F.col("risk_on")).alias("ret"))


def gated_summary(periods: DataFrame) -> DataFrame:
    """Per horizon: periods, mean, share positive, growth of 1, deepest drawdown."""
    return drawdowns(periods, ["H"], "ym").groupBy("H").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("avg_per_period"), S.share_true(F.col("ret") > 0).alias("pct_positive"),
        S.multiple("ret").alias("multiple"), F.min("drawdown").alias("max_dd"),
    )


def last_completed_month(panel: DataFrame, prices: DataFrame):
    """Scalar: the last month whose eligible rows all lie before the latest date."""
    latest = prices.select(F.max("date")).scalar()
    months = panel.filter("eligible").groupBy("ym").agg(F.max("date").alias("d"))
    done = F.max(F.when(F.col("d") < latest, F.col("ym")))
    return months.select(F.coalesce(done, F.max("ym"))).scalar()


def live_summary(panel: DataFrame, prices: DataFrame, market: DataFrame) -> DataFrame:
    """One row: the live basket of the last completed month beside the market's return
    over the same days."""
    from panelkit.operators.trend import add_level

    picks = picks_for(panel, market, last_completed_month(panel, prices))
    live = interim_performance(mark_to_latest(picks, prices, keep_unmarked=True))
    levels = add_level(market).select("date", "loglevel")
    final = levels.select(F.max_by("loglevel", "date")).scalar()
    base = levels.select(F.col("date").alias("entry_date"), F.col("loglevel").alias("_l0"))
    return live.join(calendar_broadcast(base), "entry_date", "left").withColumn("market_ret", F.expm1(final - F.col("_l0"))).drop("_l0")
