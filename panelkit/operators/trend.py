"""Trend signals, timed returns and performance of one-row-per-date series.

The market series has one row per trading day whatever the size of the panel, so its
unpartitioned windows are bounded by the calendar; statistics are plain group-bys by
``strategy`` and stay distributed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv
from panelkit.functions import rolling as R
from panelkit.functions import stats as S
from panelkit.functions.scalar import annual_to_daily, clip


def add_level(market: DataFrame, ret: str = "mkt_r", out: str = "level") -> DataFrame:
    """Growth of 1, as a running product through logs; ``loglevel`` is kept beside it."""
    w = R.series_window()
    lost = R.running_max((F.col(ret) <= -1).cast("int"), w)
    df = market.withColumn("loglevel", R.running_sum(F.log1p(ret), w))
    return df.withColumn(out, F.when(lost == 1, 0.0).otherwise(F.exp("loglevel")))


def market_momentum(market: DataFrame, rows: int, out: str) -> DataFrame:
    w = R.series_window()
    return add_level(market).withColumn(out, R.trailing_return("loglevel", rows, w))


def trend_flags(market: DataFrame, rows: tuple[int, ...] = fv.ENSEMBLE_ROWS) -> DataFrame:
    """ma_n flags and their mean, the ensemble exposure."""
    w = R.series_window()
    flags = add_level(market).withColumns({f"ma_{n}": R.ma_flag("level", n, w) for n in rows})
    return flags.withColumn("exposure", sum(F.col(f"ma_{n}") for n in rows) / len(rows))


def momentum_signal(market: DataFrame, rows: int) -> DataFrame:
    return market.withColumn(f"mom_{rows}", R.momentum_flag("mkt_r", rows, R.series_window()))


def timing_regime(market: DataFrame, rows: tuple[int, ...] = fv.ENSEMBLE_ROWS) -> DataFrame:
    """One row: the latest exposure, its filters, level, and 20 and 60 row sums."""
    w = R.series_window()
    tail = {f"index_ret_{n}d": F.sum("mkt_r").over(R.last_rows(w, n)) for n in (20, 60)}
    flags = trend_flags(market, rows).withColumns(tail)
    last = flags.filter(F.col("date") == flags.select(F.max("date")).scalar())
    return last.select(
        F.col("date").alias("as_of"),
        "exposure",
        F.when(F.col("exposure") >= 0.5, "RISK-ON").otherwise("RISK-OFF").alias("signal"),
        *[(F.col(f"ma_{n}") == 1.0).alias(f"above_ma{n}") for n in rows],
        F.col("level").alias("index_level"),
        "index_ret_20d",
        "index_ret_60d",
    )


def _position(signal: Column, w) -> Column:
    """A signal is traded one row later."""
    return F.coalesce(clip(F.lag(signal).over(w), 0.0, 1.0), F.lit(0.0))


def _switch(pos: str, w) -> Column:
    return F.coalesce(F.abs(F.col(pos) - F.lag(pos).over(w)), F.lit(0.0))


def timed_returns(
    df: DataFrame, signal: str, cost: float = fv.COST_SWITCH, cash_annual: float = fv.CASH_ANNUAL,
    ppy: int = fv.DAYS_PER_YEAR, out: str = "ret",
) -> DataFrame:
    """Hold the index by the lagged signal, cash otherwise, and pay for switches."""
    w = R.series_window()
    cash = annual_to_daily(cash_annual, ppy)
    pos = f"_pos_{signal}"
    df = df.withColumn(pos, _position(F.col(signal), w))
    ret = F.col(pos) * F.col("mkt_r") + (1 - F.col(pos)) * cash - _switch(pos, w) * cost
    return df.withColumn(out, ret).drop(pos)


def edge_variants(market: DataFrame, rows: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """(date, strategy, ret) of buy and hold and the trend variants."""
    df = trend_flags(market)
    names = {"buy_hold": "mkt_r"}
    for n in rows:
        df = timed_returns(df, f"ma_{n}", out=f"_t{n}")
        names[f"trend_ma{n}"] = f"_t{n}"
    df = timed_returns(df, "exposure", out="_te")
    names["trend_ensemble"] = "_te"
    return _long(df, names)


def hierarchy_variants(
    market: DataFrame, rates: DataFrame, leverage: float = 1.5, cost: float = fv.COST_SWITCH,
    ppy: int = fv.DAYS_PER_YEAR,
) -> DataFrame:
    """(date, strategy, ret): buy and hold, timed, and timed with leverage, where cash
    earns and borrowing costs the policy rate. ``rates`` has (date, rate)."""
    from panelkit.operators.asof import backward_asof, rate_order

    w = R.series_window()
    df = backward_asof(trend_flags(market), rates, "rate", fill_early=True, order=rate_order(rates))
    df = df.withColumn("_fin", annual_to_daily(F.col("rate") / 100, ppy))
    df = df.withColumn("_pos1", _position(F.col("exposure"), w))
    df = df.withColumn("_posL", F.col("_pos1") * leverage)
    timed = F.col("_pos1") * F.col("mkt_r") + (1 - F.col("_pos1")) * F.col("_fin") - _switch("_pos1", w) * cost
    cash = F.greatest(1 - F.col("_posL"), F.lit(0.0))
    borrow = F.greatest(F.col("_posL") - 1, F.lit(0.0))
    levered = F.col("_posL") * F.col("mkt_r") + (cash - borrow) * F.col("_fin") - _switch("_posL", w) * cost
    df = df.withColumns({"_t1": timed, "_tl": levered})
    return _long(df, {"buy_hold": "mkt_r", "timed_1x": "_t1", f"timed_{leverage}x": "_tl"})


def _long(df: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(c).alias("ret")) for k, c in names.items()])
    return df.select("date", F.explode(pairs).alias("p")).select("date", "p.strategy", "p.ret")


def drawdowns(returns: DataFrame, keys: list[str], order: str = "date", ret: str = "ret") -> DataFrame:
    """Adds equity (growth of 1, 0 from a total loss on) and its drawdown from the running maximum."""
    w = Window.partitionBy(*keys).orderBy(order)
    lost = R.running_max((F.col(ret) <= -1).cast("int"), w)
    df = returns.withColumn("equity", F.when(lost == 1, 0.0).otherwise(F.exp(R.running_sum(F.log1p(ret), w))))
    return df.withColumn("drawdown", F.coalesce(F.try_divide("equity", R.running_max("equity", w)) - 1, F.when(F.col("equity") == 0, -1.0)))


def perf_stats(returns: DataFrame, keys: list[str], ppy: int = fv.DAYS_PER_YEAR) -> DataFrame:
    """CAGR, Sharpe, deepest drawdown and win rate of daily returns per key."""
    df = drawdowns(returns.filter(F.col("ret").isNotNull()), keys)
    return df.groupBy(*keys).agg(
        (F.pow(S.multiple("ret"), F.lit(float(ppy)) / F.count("ret")) - 1).alias("cagr"),
        (F.avg("ret") / (F.stddev_samp("ret") + 1e-12) * F.sqrt(F.lit(float(ppy)))).alias("sharpe"),
        F.min("drawdown").alias("max_dd"),
        S.share_true(F.col("ret") > 0).alias("win"),
    )


def period_perf(returns: DataFrame, keys: list[str], per_year: Column, order: str = "ym", min_periods: int = 3) -> DataFrame:
    """Statistics of non-overlapping period returns; groups below ``min_periods`` drop."""
    df = drawdowns(returns.filter(F.col("ret").isNotNull()), keys, order).withColumn("_py", per_year)
    g = df.groupBy(*keys).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"),
        S.multiple("ret").alias("multiple"), F.min("drawdown").alias("max_dd"), F.first("_py").alias("_py"),
    ).filter(F.col("n") >= min_periods)
    vol = F.col("_s") * F.sqrt("_py")
    return g.select(
        *keys, "n",
        (F.pow("multiple", F.col("_py") / F.col("n")) - 1).alias("cagr"),
        vol.alias("vol"),
        (F.col("_m") * F.col("_py") / (vol + S.TINY)).alias("sharpe"),
        "max_dd",
        (F.pow("multiple", 1.0 / F.col("n")) - 1).alias("geo_per_period"),
        "multiple",
    )


def by_period(returns: DataFrame, split: str) -> DataFrame:
    """Each row under ``full`` and under its half, so one group-by serves both."""
    half = F.when(F.col("date") < F.lit(split).cast("date"), "first").otherwise("second")
    return returns.withColumn("period", F.explode(F.array(F.lit("full"), half)))


def subperiod_report(market: DataFrame, rates: DataFrame, split: str, leverage: float = 1.5) -> DataFrame:
    """Performance of the three variants by period, with the average policy rate over
    the sample and the current signal on each row."""
    from panelkit.operators.asof import backward_asof, rate_order

    perf = perf_stats(by_period(hierarchy_variants(market, rates, leverage), split), ["period", "strategy"])
    avg_rate = backward_asof(market, rates, "rate", fill_early=True, order=rate_order(rates)).select(F.avg("rate")).scalar()
    signal = timing_regime(market).select("signal").scalar()
    return perf.withColumns({"avg_policy_rate": avg_rate, "current_signal": signal})


# fixed values: factor, column, points back, relative, low and high threshold, signals
OVERLAY_FACTORS = [
    ("policy_rate_6m_change_pp", "policy_rate", 6, False, -0.25, 0.25, 1, -1),
    ("pkr_depreciation_3m", "pkr_usd", 3, True, -0.02, 0.05, 1, -1),
    ("reserves_3m_change", "fx_reserves_sbp_bn", 3, True, -0.05, 0.05, -1, 1),
    ("cpi_yoy_3m_change_pp", "cpi_yoy", 3, False, -1.0, 1.0, 1, -1),
]


def threshold_signals(macro: DataFrame) -> DataFrame:
    """(date, factor, value, signal) at every month: each factor's change over its
    non-null points, and the three-way signal."""
    from panelkit.functions.scalar import three_way

    frames = []
    for name, column, k, relative, low, high, below, above in OVERLAY_FACTORS:
        w = R.series_window()
        prev = F.lag(column, k).over(w)
        d = F.col(column) / prev - 1 if relative else F.col(column) - prev
        x = macro.filter(F.col(column).isNotNull()).select("date", F.lit(name).alias("factor"), d.alias("value"))
        frames.append(x.filter("value is not null").withColumn("signal", three_way("value", low, high, below, above)))
    return reduce(DataFrame.unionByName, frames)


def macro_overlay(macro: DataFrame) -> DataFrame:
    """One row per factor at its latest point, with the mean score and the tilt."""
    signals = threshold_signals(macro)
    latest = signals.groupBy("factor").agg(
        F.max_by("value", "date").alias("value"), F.max_by("signal", "date").alias("signal")
    )
    score = latest.select(F.avg("signal")).scalar()
    return latest.withColumn("score", score).withColumn("tilt", tilt_of("score"))


def tilt_of(score: str) -> Column:
    s = F.col(score)
    return (
        F.when(s > 0.25, "supportive").when(s < -0.25, "restrictive").when(s.isNotNull(), "neutral").otherwise("unseeded")
    )
