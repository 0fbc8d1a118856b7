"""Window queries: trailing features, trend flags, gauge, episodes (E, F, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import MIN_ADV, query
from catalog.relations import MED, W, minp
from panelkit.functions import fixed_values as fv
from panelkit.functions import rolling as R
from panelkit.functions.scalar import month_start
from panelkit.operators import baskets, clean, corr, dims, episodes, history, months, mood, ranks, trend
from panelkit.operators import xsection as X
from panelkit.operators.asof import on_calendar
from panelkit.plans import evaluate as E
from panelkit.plans import panels, rules


@query("e1_cumulative_log_return", "select symbol, date, cumlog from prices", "cumlog")
def _(c):
    return c.m.prices.select("symbol", "date", "cumlog")


@query("e2_rolling_median", f"select symbol, date, adv_20, {minp(MED, 'value', 60, 20)} as adv_60, {minp(MED, 'value', 120, 40)} as adv_120 from prices",
       "adv_20 adv_60 adv_120")
def _(c):
    w = R.symbol_window()
    frames = c.m.prices.select("symbol", "date", "adv_20", R.frame_values("value", 60, w).alias("v60"), R.frame_values("value", 120, w).alias("v120"))
    return R.add_medians(frames, {"adv_60": ("v60", 20), "adv_120": ("v120", 40)})


@query("e3_lagged_momentum", "select symbol, date, rev_1w, ret_20, mom_1m, ret_60, mom_3m, ret_120, mom_6m, mom_12m from features_daily",
       "rev_1w ret_20 mom_1m ret_60 mom_3m ret_120 mom_6m mom_12m")
def _(c):
    w = R.symbol_window()
    names = {"rev_1w": 5, "ret_20": 20, "mom_1m": 21, "ret_60": 60, "mom_3m": 63, "ret_120": 120, "mom_6m": 126, "mom_12m": 252}
    return c.m.prices.select("symbol", "date", *[R.trailing_return("cumlog", k, w).alias(n) for n, k in names.items()])


@query("e4_rolling_deviation", "select symbol, date, vol_1m, vol_3m from features_daily", "vol_1m vol_3m")
def _(c):
    w = R.symbol_window()
    return c.m.prices.select("symbol", "date", R.rolling(F.stddev_samp, "r1", 20, 10, w).alias("vol_1m"), R.rolling(F.stddev_samp, "r1", 63, 30, w).alias("vol_3m"))


@query("e5_distance_from_extremes", "select symbol, date, dist_252h, dist_20h, dist_6mlow, dd_6m from features_daily", "dist_252h dist_20h dist_6mlow dd_6m")
def _(c):
    w = R.symbol_window()
    return c.m.prices.select(
        "symbol", "date", R.distance_from_max("cumlog", 252, 60, w).alias("dist_252h"), R.distance_from_max("cumlog", 20, 10, w).alias("dist_20h"),
        R.distance_from_min("cumlog", 126, 40, w).alias("dist_6mlow"), R.distance_from_max("cumlog", 126, 40, w).alias("dd_6m"))


@query("e6_rolling_max_and_up_share", "select symbol, date, maxup_1m, upday_frac from features_daily", "maxup_1m upday_frac")
def _(c):
    w = R.symbol_window()
    up = (F.col("r1") > 0).cast("double")
    return c.m.prices.select("symbol", "date", R.rolling(F.max, "r1", 20, 10, w).alias("maxup_1m"), R.rolling(F.avg, up, 20, 10, w).alias("upday_frac"))


@query("e7_rolling_beta", "select symbol, date, case when emm - em*em <> 0 then (erm - er*em)/(emm - em*em) end as beta_60 from features_daily", "beta_60")
def _(c):
    return panels.symbol_features(c.m.prices, baskets.market_index(c.m.prices, MIN_ADV)).select("symbol", "date", "beta_60")


@query("e8_illiquidity", "select symbol, date, amihud * 1e6 as amihud_e6 from features_daily", "amihud_e6")
def _(c):
    return panels.symbol_features(c.m.prices, baskets.market_index(c.m.prices, MIN_ADV)).select("symbol", "date", (F.col("amihud") * 1e6).alias("amihud_e6"))


@query("e9_market_momentum", "select date, mkt_ret_20, mkt_mom_3m from full_context", "mkt_ret_20 mkt_mom_3m")
def _(c):
    mkt = baskets.market_index(c.m.prices, MIN_ADV)
    w = R.series_window()
    return trend.add_level(mkt).select("date", R.trailing_return("loglevel", 20, w).alias("mkt_ret_20"), R.trailing_return("loglevel", 63, w).alias("mkt_mom_3m"))


@query("e10_deviation_from_sector_median", "select f.symbol, f.date, f.mom_3m - s.m3 as rel_sec_3m from features_daily f join sector_medians s on f.date = s.date and f.sector = s.sector", "rel_sec_3m")
def _(c):
    mom = c.m.prices.select("symbol", "date", "sector", R.trailing_return("cumlog", 63, R.symbol_window()).alias("m"))
    med = baskets.group_median(mom, ["date", "sector"], "m", "med")
    return mom.join(med, ["date", "sector"], "left").select("symbol", "date", (F.col("m") - F.col("med")).alias("rel_sec_3m"))


@query("e11_month_end_rows", """select symbol, cast(date_trunc('month', date) as date) as ym, max(date) as last_date, max(date) filter (adv_20 > 40000) as last_liquid_date from prices group by 1, 2""")
def _(c):
    cols = c.m.prices.select("symbol", "date", "adv_20")
    every = panels.month_end_rows(cols).select("symbol", "ym", F.col("date").alias("last_date"))
    liquid = panels.month_end_rows(cols.filter(clean.is_liquid(MIN_ADV))).select("symbol", "ym", F.col("date").alias("last_liquid_date"))
    return every.join(liquid, ["symbol", "ym"], "left")


@query("e12_forward_max_label", "select symbol, date, case when peak_60 is not null then case when peak_60 >= 0.25 then 1.0 else 0.0 end end as surge from features_daily", "surge")
def _(c):
    w = R.symbol_window().rowsBetween(1, 60)
    peak = F.when(F.count("cumlog").over(w) == 60, F.expm1(F.max("cumlog").over(w) - F.col("cumlog")))
    return c.m.prices.select("symbol", "date", peak.alias("p")).select("symbol", "date", (F.col("p") >= 0.25).cast("double").alias("surge"))


@query("e13_trend_filters", """select date, ma_20, ma_50, ma_100, ma_200, exposure,
  case when count(mkt_r) over w >= 60 and sum(mkt_r) over w > 0 then 1.0 else 0.0 end as mom_60 from flags window w as (order by date rows between 59 preceding and current row)""",
       "ma_20 ma_50 ma_100 ma_200 exposure mom_60")
def _(c):
    return trend.momentum_signal(trend.trend_flags(c.m.market), 60).drop("mkt_r", "level", "loglevel")


@query("e14_timed_returns", "select date, ret from variants where strategy = 'trend_ensemble'", "ret")
def _(c):
    return trend.timed_returns(trend.trend_flags(c.m.market), "exposure").select("date", "ret")


@query("e15_trailing_percentile_rank", "select date, momentum from mood_components", "momentum")
def _(c):
    w = R.series_window()
    df = trend.add_level(c.m.market).withColumn("x", F.round(F.col("level") / R.rolling(F.avg, "level", 125, 40, w) - 1, 9))
    return df.select("date", R.trailing_pct_rank("x", 252, 90, w).alias("momentum"))


@query("e16_mood_gauge", "select c.date, momentum, trend, breadth, low_volatility, strength, mood from mood_components c join mood m on c.date = m.date",
       "momentum trend breadth low_volatility strength mood")
def _(c):
    return c.m.mood_components.join(months.calendar_broadcast(c.m.mood), "date")


@query("e16_current_mood", """select date as as_of, mood as score, case when mood < 20 then 'Extreme Fear' when mood < 40 then 'Fear' when mood < 60 then 'Neutral' when mood < 80 then 'Greed' else 'Extreme Greed' end as label,
  week_ago, momentum, trend, breadth, low_volatility, strength from (select c.*, m.mood, lag(m.mood, 5) over (order by c.date) as week_ago from mood_components c join mood m on c.date = m.date) q order by date desc limit 1""",
       "score week_ago momentum trend breadth low_volatility strength")
def _(c):
    return mood.current_mood(c.m.mood_components)


@query("e16_mood_history", "select date, mood from mood order by date desc limit 260", "mood")
def _(c):
    return mood.mood_history(c.m.mood)


@query("e17_macro_changes", "select * from deltas", "d_policy_rate d_cpi_yoy pkr_depr oil_ret reserves_chg remit_chg")
def _(c):
    return corr.macro_deltas(c.m.macro)


@query("e17_macro_context", "select * from macro_context", "rate_level rate_chg_3m cpi_yoy pkr_chg_3m oil_chg_3m")
def _(c):
    return panels.macro_context(c.m.macro)


@query("e18_forward_fill", "select m.date, (select x.policy_rate from macro x where x.date <= m.date order by x.date desc limit 1) as policy_rate from market m", "policy_rate")
def _(c):
    return on_calendar(c.m.macro.select("date", "policy_rate"), c.m.market, "policy_rate")


@query("e19_level_and_drawdown", "select strategy, date, eq as equity, eq / max(eq) over (partition by strategy order by date rows unbounded preceding) - 1 as drawdown from (select *, exp(sum(ln(1+ret)) over (partition by strategy order by date rows unbounded preceding)) as eq from variants) q",
       "equity drawdown")
def _(c):
    return trend.drawdowns(trend.edge_variants(c.m.market), ["strategy"]).select("strategy", "date", "equity", "drawdown")


TILT_SQL = """select ym, symbol, coalesce((mom_6m-avg(mom_6m) over w)/(stddev_samp(mom_6m) over w + 1e-9),0) + coalesce((dist_252h-avg(dist_252h) over w)/(stddev_samp(dist_252h) over w + 1e-9),0)
 - coalesce((vol_3m-avg(vol_3m) over w)/(stddev_samp(vol_3m) over w + 1e-9),0) - coalesce((beta_60-avg(beta_60) over w)/(stddev_samp(beta_60) over w + 1e-9),0)
 - coalesce((maxup_1m-avg(maxup_1m) over w)/(stddev_samp(maxup_1m) over w + 1e-9),0) as fscore, fwd_1, fwd_2, fwd_3 from eligible window w as (partition by ym)"""


@query("e20_cross_sectional_score", f"select ym, symbol, fscore from ({TILT_SQL}) q", "fscore")
def _(c):
    return E.tilt_score(c.m.eligible).select("ym", "symbol", "fscore")


RULE = """(mom_3m-avg(mom_3m) over w)/(stddev_samp(mom_3m) over w + 1e-9) + (-dist_252h-avg(-dist_252h) over w)/(stddev_samp(-dist_252h) over w + 1e-9)
 + (coalesce(adv_growth,0)-avg(coalesce(adv_growth,0)) over w)/(stddev_samp(coalesce(adv_growth,0)) over w + 1e-9)"""


@query("e21_top_and_bottom_k", f"""with s as (select ym, symbol, {RULE} as score from eligible window w as (partition by ym)),
 r as (select *, row_number() over (partition by ym order by score desc nulls last, symbol) as t, row_number() over (partition by ym order by score asc nulls last, symbol) as b from s)
 select ym, symbol, 'top' as side, cast(t as int) as rank, score from r where t <= 5 union all select ym, symbol, 'bottom', cast(b as int), score from r where b <= 5""", "score")
def _(c):
    s = rules.rule_score(c.m.eligible.select(*rules.PICK_COLUMNS)).select("ym", "symbol", "score")
    top = X.top_k(s, "score", 5, ["ym"]).withColumn("side", F.lit("top"))
    return top.unionByName(X.top_k(s, "score", 5, ["ym"], largest=False).withColumn("side", F.lit("bottom"))).select("ym", "symbol", "side", "rank", "score")


@query("e22_forward_index_return", "select date, exp(lead(loglevel, 20) over (order by date) - loglevel) - 1 as fwd from levels", "fwd")
def _(c):
    return mood.forward_market(c.m.market, 20)


@query("e23_deciles", """select ym, symbol, cast(greatest(0, ceil((rn - 1) * 10.0 / (n - 1)) - 1) as int) as decile from (
  select ym, symbol, row_number() over (order by round(ret_60, 9), ym, symbol) as rn, count(*) over () as n from surge_panel) q""")
def _(c):
    from panelkit.functions import stats as S

    p = panels.surge_panel(c.m.prices, MIN_ADV, 0.25).select("ym", "symbol", F.round("ret_60", 9).alias("score"))
    slices = p.groupBy("score", "ym").agg(F.count("symbol").alias("rows"))
    placed = ranks.rows_before(slices, "score", ("ym",), "rows", "before").drop("rows")
    inside = F.row_number().over(Window.partitionBy("score", "ym").orderBy("symbol"))
    n = p.select(F.count("symbol")).scalar()
    return p.join(placed, ["score", "ym"]).withColumn("rn", F.col("before") + inside).select("ym", "symbol", S.decile_of(F.col("rn"), n).alias("decile"))


@query("e24_last_of_month", "select ym, mood_level from mood_months", "mood_level")
def _(c):
    return months.last_of_month(c.m.mood, "mood", "mood_level")


@query("e25_non_overlapping_months", """with m as (select ym, row_number() over (order by ym) - 1 as i, dense_rank() over (order by ym) as d from (select distinct ym from eligible) q)
 select cast(h as int) as H, ym from m, (values (1),(2),(3)) v(h) where i % h = 0""")
def _(c):
    ms = c.m.eligible.select("ym").distinct().withColumn("H", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return E.every_h_th(ms).select("H", "ym")


@query("e25_spaced_months", """with recursive m as (select distinct h, ym, cast(year(ym)*12 + month(ym) as int) as x from eligible, (values (1),(2),(3)) v(h)),
 o as (select *, row_number() over (partition by h order by x) as rn from m),
 g as (select h, x, ym from o where rn = 1 union all select n.h, n.x, n.ym from g, lateral (select o.* from o where o.h = g.h and o.x >= g.x + g.h order by o.x limit 1) n)
 select cast(h as int) as H, ym from g""")
def _(c):
    ms = c.m.eligible.select("ym").distinct().withColumn("H", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return E.rebalance_months(ms).select("H", "ym")


def _episodes(cmp: str, window: int, ahead: int) -> str:
    # hits by greedy skipping: each step looks up the next hit at least window + 1 rows on
    return f"""with recursive l as (select symbol, sector_name as sector, date, cumlog, row_number() over w as pos, lag(cumlog, {window}) over w as c0, lag(cumlog, {2 * window}) over w as c1,
  first_value(cumlog) over w as cf, lead(cumlog, {ahead}) over w as cn, last_value(cumlog) over (partition by symbol order by date rows between unbounded preceding and unbounded following) as cl
  from prices where adv_20 > 40000 window w as (partition by symbol order by date)),
 h as (select symbol, sector, date, pos, exp(cumlog - c0) - 1 as move, exp(c0 - coalesce(c1, cf)) - 1 as prior_mom, exp(coalesce(cn, cl) - cumlog) - 1 as fwd from l where exp(cumlog - c0) - 1 {cmp}),
 g as (select symbol, min(pos) as pos from h group by symbol union all
   select g.symbol, (select min(h.pos) from h where h.symbol = g.symbol and h.pos >= g.pos + {window + 1}) from g where g.pos is not null)
 select h.symbol, sector, date, move, prior_mom, fwd from h join g on h.symbol = g.symbol and h.pos = g.pos"""


SURGES = _episodes(">= 0.25", 20, 20)
DIPS = _episodes("<= -0.2", 20, 40)


@query("e26_surge_episodes", SURGES, "move prior_mom fwd")
def _(c):
    return episodes.surge_episodes(c.m.prices, 0.25, 20, MIN_ADV)


@query("e26_dip_episodes", f"select symbol, sector, date, move, fwd from ({DIPS}) q", "move fwd")
def _(c):
    return episodes.dip_episodes(c.m.prices, -0.2, 20, 40, MIN_ADV)


@query("e27_recent_surgers", """with l as (select symbol, sector_name as sector, date, cumlog, close, lag(cumlog, 62) over w as c0, row_number() over (partition by symbol order by date desc) as k from prices where adv_20 > 40000 window w as (partition by symbol order by date))
 select symbol, sector, exp(cumlog - c0) - 1 as ret, close as last_close from l where k = 1 and c0 is not null and date >= (select max(date) - 20 from prices) order by ret desc, symbol limit 20""", "ret last_close")
def _(c):
    return history.recent_surgers(c.m.prices, MIN_ADV, months=3)


@query("e28_eligible_now", "select distinct base from contract_bases where date >= (select max(date) - 60 from contract_bases)")
def _(c):
    return clean.eligible_now(c.m.contracts)


REGIME_SQL = """select date as as_of, exposure, case when exposure >= 0.5 then 'RISK-ON' else 'RISK-OFF' end as signal, ma_20 = 1 as above_ma20, ma_50 = 1 as above_ma50, ma_100 = 1 as above_ma100,
 ma_200 = 1 as above_ma200, level as index_level, index_ret_20d, index_ret_60d from (select *, sum(mkt_r) over (order by date rows between 19 preceding and current row) as index_ret_20d,
 sum(mkt_r) over (order by date rows between 59 preceding and current row) as index_ret_60d from flags) q order by date desc limit 1"""


@query("e29_timing_regime", REGIME_SQL, "exposure index_level index_ret_20d index_ret_60d")
def _(c):
    return trend.timing_regime(c.m.market)


SIGNALS_SQL = """select date, factor, value, case when value < lo then below when value > hi then above else 0 end as signal from (
 select date, 'policy_rate_6m_change_pp' as factor, policy_rate - lag(policy_rate, 6) over (order by date) as value, -0.25 as lo, 0.25 as hi, 1 as below, -1 as above from macro where policy_rate is not null
 union all select date, 'pkr_depreciation_3m', pkr_usd / lag(pkr_usd, 3) over (order by date) - 1, -0.02, 0.05, 1, -1 from macro where pkr_usd is not null
 union all select date, 'reserves_3m_change', fx_reserves_sbp_bn / lag(fx_reserves_sbp_bn, 3) over (order by date) - 1, -0.05, 0.05, -1, 1 from macro where fx_reserves_sbp_bn is not null
 union all select date, 'cpi_yoy_3m_change_pp', cpi_yoy - lag(cpi_yoy, 3) over (order by date), -1.0, 1.0, 1, -1 from macro where cpi_yoy is not null) q where value is not null"""


@query("e30_macro_overlay", f"""with s as ({SIGNALS_SQL}), l as (select factor, max_by(value, date) as value, max_by(signal, date) as signal from s group by factor)
 select factor, value, signal, (select avg(signal) from l) as score, case when (select avg(signal) from l) > 0.25 then 'supportive' when (select avg(signal) from l) < -0.25 then 'restrictive' else 'neutral' end as tilt from l""", "value score")
def _(c):
    return trend.macro_overlay(c.m.macro)


@query("e31_windows_around_picks", """with d as (select symbol, date, max(r1) over f as maxday, avg(value) over f as after_value, avg(value) over (partition by symbol order by date rows between 60 preceding and 1 preceding) as prior_value,
  month(max_by(date, r1) over f) as any_peak, count(*) over f as n_after, list({'r': r1, 'd': date}) over f as win from prices window f as (partition by symbol order by date rows between 1 following and 21 following))
 select e.ym, e.symbol, maxday, after_value / prior_value as volspike, n_after, cast(month(list_sort(list_transform(list_filter(win, lambda x: x.r = maxday), lambda x: x.d))[1]) as int) as peak_month
 from eligible e join d on e.symbol = d.symbol and e.date = d.date where e.fwd_1 is not null""", "maxday volspike")
def _(c):
    from panelkit.plans.drivers import pick_windows

    picks = c.m.eligible.filter("fwd_1 is not null").select("ym", "symbol", "date", "pos")
    return pick_windows(picks, c.m.prices, 21).join(picks, ["symbol", "date"]).select("ym", "symbol", "maxday", "volspike", "n_after", "peak_month")


@query("e32_sector_month_panel", "select * from sector_panel", " ".join([*fv.SECTOR_FEATURES, "fwd_1", "fwd_2", "fwd_3"]))
def _(c):
    return c.m.sector_panel


@query("e33_average_ranks", "select ym, symbol, rank() over (partition by ym order by round(upday_frac, 9)) + (count(*) over (partition by ym, round(upday_frac, 9)) - 1) / 2.0 as rnk from eligible where upday_frac is not null", "rnk")
def _(c):
    p = c.m.eligible.filter("upday_frac is not null").select("ym", "symbol", F.round("upday_frac", 9).alias("x"))
    return ranks.averaged(p, ["ym"], {"x": "rnk"}).select("ym", "symbol", "rnk")


CORR_SQL = """select d.factor, s.sector, corr(x, ret) as corr, count(*) as n from deltas_long d join sector_months s on d.ym = s.ym where x is not null group by 1, 2 having count(*) >= 8 and var_pop(ret) > 0"""


@query("f1_strongest_first", f"select sector, factor, corr, n, corr*sqrt((n-2)/greatest(1e-9, 1-corr*corr)) as t from ({CORR_SQL}) q order by abs(corr*sqrt((n-2)/greatest(1e-9, 1-corr*corr))) desc, sector, factor limit 40", "corr t")
def _(c):
    t = corr.sector_macro_corr(c.m.sector_months, corr.macro_deltas(c.m.macro)).select("sector", "factor", "corr", "n", "t")
    return corr.strongest(t, ["sector", "factor"], 40)


YEARLY = """select year(date) as year, symbol, max_by(sector_name, date) as sector, exp(max_by(cumlog, date) - min_by(cumlog, date)) - 1 as ret from prices where adv_20 > 40000 group by 1, 2 having count(*) >= 40"""


@query("f2_grouped_head", f"select cast(year as int) as year, sector, symbol, ret from ({YEARLY}) q qualify row_number() over (partition by year, sector order by ret desc, symbol) <= 2", "ret")
def _(c):
    y = history.yearly_returns(c.m.prices, MIN_ADV, 40)
    return X.top_k(y, "ret", 2, ["year", "sector"]).orderBy("year", "sector", F.desc("ret")).select("year", "sector", "symbol", "ret")


@query("f3_nulls_last_ranking", "select symbol, sector_name, mom_12m, cast(row_number() over (order by mom_12m desc nulls last, symbol) as int) as position from panel where ym = (select min(ym) + interval 18 month from panel)", "mom_12m")
def _(c):
    first = c.m.panel.select(F.add_months(F.min("ym"), 18)).scalar()
    month = c.m.panel.filter(F.col("ym") == first)
    placed = ranks.prefix_sums(month.select("symbol", "sector_name", "mom_12m"), [], [F.desc_nulls_last("mom_12m"), F.asc("symbol")], "places", position=F.lit(1).cast("long"))
    return placed.withColumn("position", (F.col("position") + 1).cast("int"))


@query("f4_sorted_report", "select symbol, mom_12m, vol_3m from panel where ym = (select max(ym) from panel) order by vol_3m asc nulls last, symbol", "mom_12m vol_3m")
def _(c):
    last = c.m.panel.select(F.max("ym")).scalar()
    return history.sort_table(c.m.panel.filter(F.col("ym") == last).select("symbol", "mom_12m", "vol_3m"), "vol_3m", ascending=True)


@query("g1_union_of_frames", "select strategy, date, ret from variants union all select strategy, date, ret from hierarchy where strategy <> 'buy_hold'", "ret")
def _(c):
    return trend.edge_variants(c.m.market).unionByName(trend.hierarchy_variants(c.m.market, c.m.rates).filter("strategy <> 'buy_hold'"))


@query("g2_union_of_dates", "select date from rate_events union select date from market")
def _(c):
    return c.m.rates.select("date").union(c.m.market.select("date")).distinct()


@query("g3_distinct_contract_months", "select distinct base, cast(date_trunc('month', date) as date) as ym from contract_bases")
def _(c):
    return clean.contract_months(c.m.contracts)


@query("g4_set_difference", "select date from market except select date from rate_events")
def _(c):
    return c.m.market.select("date").exceptAll(c.m.rates.select("date"))


@query("g5_intersection_of_picks", f"""with s as (select ym, symbol, fwd_1, {RULE} as score from eligible where fwd_1 is not null window w as (partition by ym))
 select ym, symbol from s qualify row_number() over (partition by ym order by score desc nulls last, symbol) <= 5 and row_number() over (partition by ym order by fwd_1 desc, symbol) <= 5""")
def _(c):
    rows = rules.rule_score(c.m.eligible.filter("fwd_1 is not null").select(*rules.PICK_COLUMNS, "fwd_1"))
    a = X.top_k(rows, "score", 5, ["ym"]).select("ym", "symbol")
    return a.intersect(X.top_k(rows, "fwd_1", 5, ["ym"]).select("ym", "symbol"))
