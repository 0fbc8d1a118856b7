"""The three panels: month-end features, surge labels, sector months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv
from panelkit.functions import rolling as R
from panelkit.functions.scalar import floor_at, month_start, safe_div
from panelkit.operators import frames
from panelkit.operators import months as M
from panelkit.operators.baskets import group_median, market_index
from panelkit.operators.clean import is_liquid
from panelkit.operators.dims import sector_codes
from panelkit.operators.trend import market_momentum
from panelkit.session import materialize

HORIZONS = (1, 2, 3)


def symbol_features(prices: DataFrame, market: DataFrame) -> DataFrame:
    """Daily trailing features of each symbol, with ``ym`` and whether the row is the
    symbol's last of its month.

    ``market`` has one row per date and is broadcast, so rows stay where they are. Every
    window expression sits in one projection over one (symbol, date) order: Spark plans
    a single Window operator, and frames of equal length share one buffer.
    """
    w = R.symbol_window()
    df = prices.join(M.calendar_broadcast(market), "date", "left").withColumns(
        {
            "ym": month_start("date"),
            "_up": (F.col("r1") > 0).cast("double"),
            "_il": safe_div(F.abs("r1"), "value"),
            "_rm": F.col("r1") * F.col("mkt_r"),
            "_mm": F.col("mkt_r") * F.col("mkt_r"),
        }
    )
    moments = {n: R.rolling(F.avg, c, 60, 30, w) for n, c in (("_er", "r1"), ("_em", "mkt_r"), ("_erm", "_rm"), ("_emm", "_mm"))}
    df = df.withColumns(
        {
            "mom_1m": R.trailing_return("cumlog", 21, w),
            "mom_3m": R.trailing_return("cumlog", 63, w),
            "mom_6m": R.trailing_return("cumlog", 126, w),
            "mom_12m": R.trailing_return("cumlog", 252, w),
            "rev_1w": R.trailing_return("cumlog", 5, w),
            "vol_1m": R.rolling(F.stddev_samp, "r1", 20, 10, w),
            "vol_3m": R.rolling(F.stddev_samp, "r1", 63, 30, w),
            "dist_252h": R.distance_from_max("cumlog", 252, 60, w),
            "dist_20h": R.distance_from_max("cumlog", 20, 10, w),
            "dist_6mlow": R.distance_from_min("cumlog", 126, 40, w),
            "dd_6m": R.distance_from_max("cumlog", 126, 40, w),
            "maxup_1m": R.rolling(F.max, "r1", 20, 10, w),
            "upday_frac": R.rolling(F.avg, "_up", 20, 10, w),
            "amihud": R.rolling(F.avg, "_il", 20, 10, w),
            "is_month_end": R.is_last_of("ym", w),
            **moments,
        }
    )
    return derived_features(df).drop("_up", "_il", "_rm", "_mm", *moments)


def derived_features(df: DataFrame) -> DataFrame:
    """What follows from the features of a row, among them beta from the 60-row moments."""
    beta = safe_div(F.col("_erm") - F.col("_er") * F.col("_em"), F.col("_emm") - F.col("_em") * F.col("_em"))
    return df.withColumns(
        {
            "beta_60": beta,
            "log_adv": F.log1p("adv_20"),
            "turnover": safe_div("value", "adv_20"),
            "log_price": F.log(floor_at("close", 0.1)),
            "month": F.month("date"),
            "mom_accel": F.col("mom_1m") - F.col("mom_3m") / 3.0,
            "vol_ratio": safe_div("vol_1m", "vol_3m"),
        }
    )


def add_adv_growth(df: DataFrame, frame: str, min_periods: int) -> DataFrame:
    """Log of recent over long median traded value; the frame's array is used up."""
    df = R.add_medians(df, {"_long": (frame, min_periods)})
    return df.withColumn("adv_growth", F.log1p("adv_20") - F.log1p("_long")).drop("_long")


def month_end_rows(df: DataFrame) -> DataFrame:
    """Each symbol's last row per month, found by the month of its next row."""
    df = df.withColumn("ym", month_start("date"))
    return df.withColumn("_last", R.is_last_of("ym", R.symbol_window())).filter("_last").drop("_last")


def with_histories(rows: DataFrame, prices: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with each symbol's ``values`` as arrays in the order of its row numbers.

    Frames of a few sampled rows are slices of these; evaluated as sliding frames on each
    daily row they would cost their length times the panel. Both sides are placed by symbol,
    so nothing is exchanged, and no symbol's history is sent to the driver.
    """
    return rows.join(R.histories(prices, values).hint("merge"), "symbol")


def sector_medians(prices: DataFrame, rows: int, out: str) -> DataFrame:
    """(date, sector, out): exact median of the trailing return over ``rows`` of all daily
    rows of a sector. One row per date and sector, so it is broadcast."""
    moves = prices.select("date", "sector", R.trailing_return("cumlog", rows, R.symbol_window()).alias("_move"))
    once = materialize(moves.filter("_move is not null"), "daily-moves")
    return F.broadcast(group_median(once, ["date", "sector"], "_move", out))


def forward_labels(month_ends: DataFrame, months: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """fwd_H: return to the same symbol's row H months on, by the grid of months
    present (``months``: any frame with their ym). That row is at most H rows ahead, so
    leads in date order replace a self-join."""
    df = month_ends.join(M.calendar_broadcast(M.month_rank(months)), "ym")
    w = R.symbol_window()

    def label(h: int) -> Column:
        hits = [
            F.when(F.lead("m_rank", j).over(w) == F.col("m_rank") + h, F.lead("cumlog", j).over(w))
            for j in range(1, h + 1)
        ]
        return F.expm1(F.coalesce(*hits) - F.col("cumlog"))

    return df.withColumns({f"fwd_{h}": label(h) for h in horizons})


def macro_context(macro: DataFrame) -> DataFrame:
    """(ym, rate_level, rate_chg_3m, cpi_yoy, pkr_chg_3m, oil_chg_3m) along macro rows."""
    w = R.series_window()
    df = macro.withColumns({"_fx": R.padded("pkr_usd", w), "_oil": R.padded("brent_usd", w)})
    return df.select(
        month_start("date").alias("ym"), F.col("policy_rate").alias("rate_level"),
        R.change("policy_rate", 3, w).alias("rate_chg_3m"), "cpi_yoy",
        R.pct_change("_fx", 3, w).alias("pkr_chg_3m"), R.pct_change("_oil", 3, w).alias("oil_chg_3m"),
    )


def eligible_months(contract_months: DataFrame, window: int = 3) -> DataFrame:
    """(symbol, ym): months in which a contract traded within the trailing window."""
    ahead = F.explode(F.sequence(F.lit(0), F.lit(window - 1)))
    return (
        contract_months.select(F.col("base").alias("symbol"), "ym", ahead.alias("k"))
        .select("symbol", F.add_months("ym", F.col("k")).alias("ym"))
        .distinct()
    )


def feature_rows(prices: DataFrame, min_adv: float) -> DataFrame:
    """Each symbol's last row per month with its trailing features: the values of
    ``symbol_features`` on these rows, from one cheap window and from frames that are
    evaluated on them alone."""
    w = R.symbol_window()
    market = M.calendar_broadcast(market_momentum(market_index(prices, min_adv), 63, "mkt_mom_3m").select("date", "mkt_r", "mkt_mom_3m"))
    returns = {"mom_1m": 21, "mom_3m": 63, "mom_6m": 126, "mom_12m": 252, "rev_1w": 5}
    ends = prices.withColumn("ym", month_start("date")).withColumns(
        {**{n: R.trailing_return("cumlog", k, w) for n, k in returns.items()}, "_end": R.is_last_of("ym", w)}
    ).filter("_end").drop("_end").join(market, "date", "left")
    r, m = F.col("r1"), F.col("mkt_r")
    values = {
        "_cumlog": F.col("cumlog"), "_r1": r, "_up": (r > 0).cast("double"), "_il": safe_div(F.abs("r1"), "value"),
        "_mkt": m, "_rm": r * m, "_mm": m * m, "_value": F.col("value"),
    }
    statistics = {
        "vol_1m": ("deviation", "_r1", 20, 10), "vol_3m": ("deviation", "_r1", 63, 30), "_top252": ("top", "_cumlog", 252, 60), "_top20": ("top", "_cumlog", 20, 10),
        "_low126": ("low", "_cumlog", 126, 40), "_top126": ("top", "_cumlog", 126, 40), "maxup_1m": ("top", "_r1", 20, 10),
        "upday_frac": ("mean", "_up", 20, 10), "amihud": ("mean", "_il", 20, 10), "_er": ("mean", "_r1", 60, 30), "_em": ("mean", "_mkt", 60, 30),
        "_erm": ("mean", "_rm", 60, 30), "_emm": ("mean", "_mm", 60, 30), "_long": ("median", "_value", 120, 40),
    }
    df = frames.at_rows(ends, frames.month_end_statistics(prices.join(market, "date", "left"), values, statistics))
    distances = {"dist_252h": "_top252", "dist_20h": "_top20", "dist_6mlow": "_low126", "dd_6m": "_top126"}
    df = df.withColumns({n: F.expm1(F.col("cumlog") - F.col(c)) for n, c in distances.items()}).withColumn("adv_growth", F.log1p("adv_20") - F.log1p("_long"))
    return derived_features(df).drop(*[n for n in statistics if n.startswith("_")])


def feature_panel(
    prices: DataFrame, macro: DataFrame, mood: DataFrame, contract_months: DataFrame, min_adv: float, min_close: float = 3.0,
) -> DataFrame:
    """Month-end features, forward labels and point-in-time eligibility.

    Month-end rows stay placed by symbol from the price table to the written panel: what
    joins them is one row per date, month or sector and is broadcast, or one row per symbol.
    """
    ends = forward_labels(feature_rows(prices, min_adv), prices.select(month_start("date").alias("ym")))
    ends = ends.join(sector_medians(prices, 63, "_sec3"), ["date", "sector"], "left").withColumns(
        {"rel_str_3m": F.col("mom_3m") - F.col("mkt_mom_3m"), "rel_sec_3m": F.col("mom_3m") - F.col("_sec3")}
    ).drop("_sec3")

    mood_months = M.last_of_month(mood, "mood", "mood_level")
    ends = (
        ends.join(F.broadcast(sector_codes(prices.select("sector_name"))), "sector_name")
        .join(M.calendar_broadcast(macro_context(macro)), "ym", "left")
        .join(M.calendar_broadcast(mood_months), "ym", "left")
        .join(eligible_months(contract_months).groupBy("symbol").agg(F.collect_set("ym").alias("_months")), "symbol", "left")
        .withColumn("fut_elig", F.coalesce(F.array_contains("_months", F.col("ym")), F.lit(False)))
        .drop("_months")
    )
    ok = F.col("fut_elig") & is_liquid(min_adv) & (F.col("close") >= min_close) & F.col("is_equity")
    return ends.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def surge_panel(prices: DataFrame, min_adv: float, surge: float = 0.40, horizon: int = 60, require_label: bool = True) -> DataFrame:
    """Liquid month-end rows with trailing features and the forward-maximum label.

    The label is null unless all ``horizon`` rows ahead exist. Rows without it are
    dropped by default, which also makes the latest month about that many rows old;
    ``require_label=False`` keeps them for a current screen.
    """
    market = market_index(prices, min_adv)
    context = market_momentum(market, 20, "mkt_ret_20").select("date", "mkt_ret_20")
    ends = materialize(surge_rows(prices, min_adv, surge, horizon), "surge-rows")
    ends = ends.join(M.calendar_broadcast(context), "date", "left").join(sector_medians(prices, 60, "_med"), ["date", "sector"], "left")
    ends = ends.withColumn("rel_ret_60", F.col("ret_60") - F.col("_med")).drop("_med")
    return ends.dropna(subset=fv.SURGE_FEATURES + (["surge"] if require_label else []))


def surge_rows(prices: DataFrame, min_adv: float, surge: float, horizon: int) -> DataFrame:
    """Sampled rows of the surge panel: a symbol's last liquid row of each month (liquid,
    and no liquid row of the month among the next 31), with features from its history."""
    w = R.symbol_window()
    liquid = F.coalesce(is_liquid(min_adv), F.lit(False))
    later = F.min(F.when(liquid, month_start("date"))).over(w.rowsBetween(1, 31))
    returns = {"ret_20": 20, "ret_60": 60, "ret_120": 120}
    last = prices.withColumn("ym", month_start("date")).withColumns(
        {**{n: R.trailing_return("cumlog", k, w) for n, k in returns.items()}, "_last": liquid & ~later.eqNullSafe(F.col("ym"))}
    ).filter("_last").drop("_last")
    values = {"_cumlog": F.col("cumlog"), "_r1": F.col("r1"), "_value": F.col("value")}
    df = with_histories(last, prices, values)
    frames = {"_c252": ("_cumlog", 252), "_c20": ("_cumlog", 20), "_r20": ("_r1", 20), "_values": ("_value", 60)}
    df = df.withColumns(
        {**{n: R.last_of(h, k) for n, (h, k) in frames.items()}, "_ahead": R.known_of("_cumlog", F.col("pos") + 1, F.lit(horizon))}
    ).drop(*values, *[f"{v}_gaps" for v in values]).withColumn("_a20", R.array_mean(F.col("_r20")))
    peak = F.exp(R.filled_frame(F.array_max, "_ahead", horizon)) / F.exp("cumlog") - 1
    df = df.withColumns(
        {
            "vol_20": R.filled_frame(lambda x: R.array_deviation(x, F.col("_a20")), "_r20", 10),
            "dist_252h": F.expm1(F.col("cumlog") - R.filled_frame(F.array_max, "_c252", 60)),
            "dist_20h": F.expm1(F.col("cumlog") - R.filled_frame(F.array_max, "_c20", 10)),
            "_peak": peak, "log_adv": F.log1p("adv_20"), "log_price": F.log(floor_at("close", 0.1)),
        }
    )
    df = df.withColumn("surge", F.when(F.col("_peak").isNotNull(), (F.col("_peak") >= surge).cast("double")))
    return add_adv_growth(df.drop("_peak", "_ahead", "_a20", "_c252", "_c20", "_r20"), "_values", 20)


def sector_panel(sector_months: DataFrame, market_months: DataFrame, macro: DataFrame, operating: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Sector-by-month features and forward returns for operating sectors."""
    kept = sector_months.join(operating, "sector", "left_semi")
    w = Window.partitionBy("sector").orderBy("ym")
    t = R.series_window("ym")
    mkt = market_months.withColumn("_mc", R.running_sum(F.log1p("mkt_m"), t))
    mkt = mkt.select("ym", R.trailing_return("_mc", 3, t).alias("_mkt3"))
    months = kept.select("ym").distinct()
    context = months.join(macro.select(month_start("date").alias("ym"), "policy_rate", "cpi_yoy", "pkr_usd", "brent_usd"), "ym", "left")
    context = context.withColumns({"_fx": R.padded("pkr_usd", t), "_oil": R.padded("brent_usd", t)}).select(
        "ym", F.col("policy_rate").alias("rate_level"), R.change("policy_rate", 3, t).alias("rate_chg_3"), "cpi_yoy",
        R.pct_change("_fx", 3, t).alias("pkr_chg_3"), R.pct_change("_oil", 3, t).alias("oil_chg_3"),
    )
    df = kept.withColumn("_c", R.running_sum(F.log1p("ret"), w))
    df = df.withColumns({f"mom_{k}": R.trailing_return("_c", k, w) for k in (1, 3, 6, 12)})
    df = df.withColumns({"rev_1": F.col("ret"), "vol_3": R.rolling(F.stddev_samp, "ret", 3, 2, w)})
    df = df.withColumns({f"fwd_{h}": R.forward_return("_c", h, w) for h in horizons})
    df = df.join(M.calendar_broadcast(mkt), "ym", "left").join(M.calendar_broadcast(context), "ym", "left")
    df = df.withColumn("rel_str_3", F.col("mom_3") - F.col("_mkt3"))
    codes = sector_codes(kept, "sector")
    return df.join(codes, "sector").select("ym", "sector", *fv.SECTOR_FEATURES, *[f"fwd_{h}" for h in horizons])
