"""Evaluation of month-by-month scores: baskets, rank correlation, precision, legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv
from panelkit.functions import stats as S
from panelkit.functions.scalar import clip, month_index
from panelkit.operators import xsection as X
from panelkit.operators.asof import backward_asof
from panelkit.operators.episodes import greedy_spacing
from panelkit.operators.months import calendar_broadcast
from panelkit.operators.trend import period_perf


def by_horizon(panel: DataFrame, horizons: tuple[int, ...], keep: list[str]) -> DataFrame:
    """Long form (keep..., H, fwd): all horizons are then evaluated in one pass."""
    pairs = F.array(*[F.struct(F.lit(h).alias("H"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons])
    return panel.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.H", "p.fwd")


def tilt_score(panel: DataFrame, factors: dict[str, int] = fv.TILT_FACTORS) -> DataFrame:
    """Adds ``fscore``: signed sum of monthly z-scores, a missing one counting 0."""
    scored = X.zscores(panel, {f"_z_{f}": F.col(f) for f in factors})
    total = sum((F.coalesce(f"_z_{f}", F.lit(0.0)) * s for f, s in factors.items()), F.lit(0.0))
    return scored.withColumn("fscore", total).drop(*[f"_z_{f}" for f in factors])


def tilt_months(scored: DataFrame, frac: float = 0.2, least: int = 3, min_rows: int = 15) -> DataFrame:
    """(H, ym, top, uni, bot, spread, ls, ic) of a long scored frame (ym, symbol, fscore,
    H, fwd), for months with enough outcomes."""
    done = scored.filter("fwd is not null and fscore is not null")
    marked = X.top_fraction(done, "fscore", ["H", "ym"], frac, least, min_rows)
    g = marked.groupBy("H", "ym").agg(
        F.avg(F.when(F.col("is_top"), F.col("fwd"))).alias("top"), F.avg("fwd").alias("uni"),
        F.avg(F.when(F.col("is_bottom"), F.col("fwd"))).alias("bot"),
    )
    ic = X.spearman(done, ["H", "ym"], "fscore", "fwd").select("H", "ym", "ic")
    return g.join(ic, ["H", "ym"]).withColumns({"spread": F.col("top") - F.col("uni"), "ls": F.col("top") - F.col("bot")})


def rebalance_months(records: DataFrame) -> DataFrame:
    """Non-overlapping records: the first, then each one at least H months later."""
    spaced = records.withColumn("_m", month_index("ym")).withColumn("_gap", F.col("H"))
    return greedy_spacing(spaced, ["H"], "_m", F.col("_gap")).drop("_m", "_gap")


def every_h_th(records: DataFrame, keys: tuple[str, ...] = ("H",)) -> DataFrame:
    """Every H-th record in month order, starting with the first."""
    w = Window.partitionBy(*keys).orderBy("ym")
    return records.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % F.col("H") == 0).drop("_i")


def annualised(ret: Column, h: Column) -> Column:
    """Compounded non-overlapping returns scaled to a year of 12 / H periods."""
    return F.pow(S.multiple(ret), 12 / F.first(h) / F.count(ret)) - 1


def mean_log_annual(ret: Column, h: Column) -> Column:
    return annualised(ret, h)


def tilt_summary(months: DataFrame, cost: float = fv.COST_PICKS) -> DataFrame:
    """One row per horizon: means, t of spread, long-short and IC, hit rate, compounding."""
    base = months.groupBy("H").agg(
        F.count("ym").alias("n_months"), F.avg("top").alias("top_avg_fwd"), F.avg("uni").alias("universe_avg_fwd"),
        F.avg("bot").alias("bottom_avg_fwd"), F.avg("spread").alias("spread"), S.t_of_mean("spread").alias("spread_t"),
        F.avg("ls").alias("longshort_avg"), S.t_of_mean("ls").alias("longshort_t"),
        F.avg("ic").alias("ic_mean"), S.t_of_mean("ic").alias("ic_t"),
        S.share_true(F.col("spread") > 0).alias("hit_rate"),
        mean_log_annual(F.col("uni"), F.col("H")).alias("ann_universe"),
    )
    equity = rebalance_months(months).groupBy("H").agg(annualised(F.col("top") - cost, F.col("H")).alias("ann_top_net"))
    usable = (F.col("spread_t") >= 2) & (F.col("hit_rate") >= 0.55)
    return base.join(equity, "H", "left").withColumn("reliable", usable)


def scored_months(scored: DataFrame, k: int = 5, min_extra: int = 5, skip_months: int = 0) -> DataFrame:
    """(H, ym, top, uni, bot, spread, ic, prec) of a long scored frame (ym, symbol, score,
    H, fwd). Picks are taken over all scored rows; the universe, the correlation and the
    realised best only over rows with an outcome."""
    sizes = scored.groupBy("H", "ym").agg(F.count("symbol").alias("n_test"), F.count("fwd").alias("n_ev"), F.avg("fwd").alias("uni"))
    nth = F.dense_rank().over(Window.partitionBy("H").orderBy("ym"))
    sizes = sizes.withColumn("_i", nth).filter(
        (F.col("_i") > skip_months) & (F.col("n_test") >= k + min_extra) & (F.col("n_ev") >= k + min_extra)
    )
    keys = ["H", "ym"]
    top = X.top_k(scored, "score", k, keys)
    bottom = X.top_k(scored, "score", k, keys, largest=False)
    done = scored.filter("fwd is not null")
    best = X.top_k(done, "fwd", k, keys).select(*keys, "symbol", F.lit(1).alias("_hit"))
    picks = top.join(best, [*keys, "symbol"], "left").groupBy(*keys).agg(
        F.avg("fwd").alias("top"), (F.count("_hit") / F.lit(k)).alias("prec")
    )
    return (
        sizes.select(*keys, "uni").join(picks, keys)
        .join(bottom.groupBy(*keys).agg(F.avg("fwd").alias("bot")), keys)
        .join(X.spearman(done, keys, "score", "fwd").select(*keys, "ic"), keys)
        .withColumn("spread", F.col("top") - F.col("uni"))
    )


def score_summary(months: DataFrame, cost: float = fv.COST_PICKS, recent: int = 18) -> DataFrame:
    """One row per horizon: averages, t, hit rate, precision, compounding, and the last
    ``recent`` months as a holdout."""
    newest = Window.partitionBy("H").orderBy(F.desc("ym"))
    m = months.withColumn("_recent", F.row_number().over(newest) <= recent)
    late = F.when(F.col("_recent"), F.col("spread"))
    base = m.groupBy("H").agg(
        F.count("ym").alias("n_months"), F.avg("ic").alias("ic_mean"), S.t_of_mean("ic").alias("ic_t"),
        F.avg("top").alias("top_avg_fwd"), F.avg("uni").alias("universe_avg_fwd"), F.avg("bot").alias("bottom_avg_fwd"),
        F.avg("spread").alias("spread"), S.share_true(F.col("spread") > 0).alias("hit_rate"), F.avg("prec").alias("precision_at_k"),
        mean_log_annual(F.col("uni"), F.col("H")).alias("ann_universe"),
        F.avg(late).alias("recent_spread"), S.share_true(late > 0).alias("recent_hit"),
    )
    equity = rebalance_months(months).groupBy("H").agg(annualised(F.col("top") - cost, F.col("H")).alias("ann_top_net"))
    return base.join(equity, "H", "left").withColumn("verdict", verdict())


def verdict() -> Column:
    t, hit, spread = F.col("ic_t"), F.col("hit_rate"), F.col("spread")
    return (
        F.when((t >= 2) & (hit >= 0.55) & (spread > 0.005), "reliable")
        .when((spread > 0) & (t >= 1), "weak").otherwise("not_reliable")
    )


def leg_returns(months: DataFrame, cost: float = fv.COST_PICKS) -> DataFrame:
    """(H, leg, ym, ret) of non-overlapping periods for the picks, universe, bottom."""
    legs = F.array(
        F.struct(F.lit("top").alias("leg"), (F.col("top") - cost).alias("ret")),
        F.struct(F.lit("universe").alias("leg"), F.col("uni").alias("ret")),
        F.struct(F.lit("bottom").alias("leg"), (F.col("bot") - cost).alias("ret")),
    )
    return every_h_th(months).select("H", "ym", F.explode(legs).alias("l")).select("H", "ym", "l.*")


def leg_perf(legs: DataFrame) -> DataFrame:
    return period_perf(legs, ["H", "leg"], 12 / F.col("H"))


def volatility_matched(perf: DataFrame, legs: DataFrame) -> DataFrame:
    """Picks levered to the universe's volatility; nulls where the universe lost."""
    mean = legs.filter("leg = 'top'").groupBy("H").agg(F.avg("ret").alias("_mean"))

    def of(leg: str) -> DataFrame:
        return perf.filter(F.col("leg") == leg).select("H", F.col("vol").alias(f"_v_{leg}"), F.col("sharpe").alias(f"_s_{leg}"))

    lever = F.col("_v_universe") / (F.col("_v_top") + S.TINY)
    values = {
        "lever_to_uni_vol": lever, "top_levered_return": F.col("_mean") * lever * 12 / F.col("H"),
        "beats_universe": F.col("_s_top") > F.col("_s_universe"),
    }
    both = of("top").join(of("universe"), "H").join(mean, "H")
    return both.select("H", *[F.when(F.col("_s_universe") > 0, v).alias(n) for n, v in values.items()])


def context_flags(months: DataFrame, entry_dates: DataFrame, daily: DataFrame, macro: DataFrame, dip: float = -0.10) -> DataFrame:
    """Tags each record with post-dip, risk-on, easing, high inflation, budget season.

    ``entry_dates`` has (ym, date); ``daily`` has (date, dd, exposure) of the market."""
    entry = backward_asof(backward_asof(entry_dates, daily, "dd"), daily, "exposure").drop("date")
    ctx = macro.select(month_index("date").alias("_m"), "policy_rate", "cpi_yoy")
    before = ctx.select((F.col("_m") + 3).alias("_m"), F.col("policy_rate").alias("_rate3"))
    cpi_median = macro.select(S.median("cpi_yoy")).scalar()
    tagged = (
        months.withColumn("_m", month_index("ym")).join(calendar_broadcast(entry), "ym")
        .join(calendar_broadcast(ctx), "_m", "left").join(calendar_broadcast(before), "_m", "left")
    )

    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    return tagged.select(
        *months.columns, flag(F.col("dd") <= dip).alias("postdip"), flag(F.col("exposure") >= 0.5).alias("risk_on"),
        flag(F.col("policy_rate") - F.col("_rate3") < -0.25).alias("easing"), flag(F.col("cpi_yoy") > cpi_median).alias("high_infl"),
        F.month("ym").isin(fv.BUDGET_MONTHS).alias("budget"),
    )


def context_table(tagged: DataFrame, min_n: int = 4) -> DataFrame:
    """Mean, spread, t and hit rate under overlapping masks, and under the gate. Masks
    with fewer than ``min_n`` months keep their count only."""
    dip, on, easy, infl = (F.col(c) for c in ("postdip", "risk_on", "easing", "high_infl"))
    masks = [
        ("all", F.lit(True)), ("post_dip", dip), ("normal", ~dip), ("risk_on", on), ("risk_off", ~on),
        ("easing", easy), ("not_easing", ~easy), ("high_inflation", infl), ("low_inflation", ~infl),
        ("budget_season", F.col("budget")), ("gated", on & (dip | easy)),
    ]
    labels = F.array_compact(F.array(*[F.when(m, F.lit(name)) for name, m in masks]))
    g = tagged.withColumn("regime", F.explode(labels)).groupBy("H", "regime").agg(
        F.count("ym").alias("n"), F.avg("top").alias("top_avg"), F.avg("uni").alias("uni_avg"), F.avg("spread").alias("spread"),
        S.t_of_mean("spread").alias("spread_t"), S.share_true(F.col("spread") > 0).alias("hit"),
    )
    enough = F.col("n") >= min_n
    return g.select("H", "regime", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("top_avg", "uni_avg", "spread", "spread_t", "hit")])


def market_state(market: DataFrame) -> DataFrame:
    """(date, dd, exposure): distance from the 63-row high and the trend exposure."""
    from panelkit.functions import rolling as R
    from panelkit.operators.trend import trend_flags

    dd = F.col("level") / R.rolling(F.max, "level", 63, 20, R.series_window()) - 1
    return trend_flags(market).select("date", dd.alias("dd"), clip("exposure", 0, 1).alias("exposure"))


def rotation_summary(months: DataFrame, macro: DataFrame, cost: float = fv.COST_ROTATION) -> DataFrame:
    """Evaluation of sector picks net of cost and carry, both for the picks and for the
    universe at the same carry. A month without a rate has a null carry."""
    from panelkit.functions.scalar import month_start, period_carry

    rate = macro.select(month_start("date").alias("ym"), "policy_rate")
    m = months.join(calendar_broadcast(rate), "ym", "left").withColumn("carry", period_carry("policy_rate", F.col("H")))
    base = m.groupBy("H").agg(
        F.count("ym").alias("n_months"), F.avg("ic").alias("ic_mean"), S.t_of_mean("ic").alias("ic_t"), F.avg("top").alias("top_avg_fwd"),
        F.avg("uni").alias("uni_avg_fwd"), F.avg("spread").alias("spread"), S.t_of_mean("spread").alias("spread_t"),
        S.share_true(F.col("spread") > 0).alias("hit_rate"), F.avg("prec").alias("precision_at_k"), F.avg("carry").alias("avg_carry"),
    )
    legs = F.array(
        F.struct(F.lit("top").alias("leg"), (F.col("top") - cost - F.col("carry")).alias("ret")),
        F.struct(F.lit("uni").alias("leg"), (F.col("uni") - F.col("carry")).alias("ret")),
    )
    held = rebalance_months(m).select("H", "ym", F.explode(legs).alias("l")).select("H", "ym", "l.*")
    perf = period_perf(held, ["H", "leg"], 12 / F.col("H"), min_periods=1)
    perf = perf.withColumn("sharpe", F.when(F.col("n") >= 3, F.col("sharpe")))
    wide = perf.groupBy("H").pivot("leg", ["top", "uni"]).agg(F.first("cagr").alias("cagr_net"), F.first("sharpe").alias("sharpe_net"))
    usable = (F.col("ic_t") >= 2) & (F.col("spread_t") >= 1.5) & (F.col("spread") > 0.005)
    return base.join(wide, "H", "left").withColumn("reliable", usable)
