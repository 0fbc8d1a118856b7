"""Aggregate queries: baskets, correlations, event studies, statistics (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import MIN_ADV, START, query
from catalog.windows import CORR_SQL, DIPS, RULE, SURGES, TILT_SQL, YEARLY
from panelkit.functions import fixed_values as fv
from panelkit.functions import stats as S
from panelkit.operators import baskets, corr, episodes, eventstudy, flows, history, mood, text, trend
from panelkit.operators import xsection as X
from panelkit.plans import drivers, panels, rules
from panelkit.plans import evaluate as E

PANEL_FEATURES = fv.PANEL_FEATURES
T = "corr*sqrt((n-2)/greatest(1e-9, 1-corr*corr))"


@query("d1_market_index", "select * from market", "mkt_r")
def _(c):
    return baskets.market_index(c.m.prices, MIN_ADV, START)


@query("d2_market_breadth", "select * from breadth", "breadth")
def _(c):
    return baskets.market_breadth(c.m.prices, MIN_ADV, START)


@query("d3_sector_daily_returns", "select * from sector_daily", "r")
def _(c):
    return baskets.sector_daily_returns(c.m.prices, MIN_ADV, START)


@query("d4_monthly_market", "select * from market_months", "mkt_m")
def _(c):
    return c.m.market_months


@query("d4_monthly_sectors", "select * from sector_months", "ret")
def _(c):
    return c.m.sector_months


@query("d5_correlation_with_t", f"""select sector, corr, n, {T} as t from (select s.sector, corr(s.ret, m.mkt_m) as corr, count(*) as n from sector_months s join market_months m on s.ym = m.ym group by 1 having count(*) >= 8 and var_pop(s.ret) > 0) q""", "corr t")
def _(c):
    return S.corr_table(c.m.sector_months.join(c.m.market_months, "ym"), ["sector"], "ret", "mkt_m")


@query("d6_sector_macro_correlation", f"select sector, factor, corr, n, {T} as t, abs({T}) >= 2 as sig, 0 as lag from ({CORR_SQL}) q", "corr t")
def _(c):
    return corr.sector_macro_corr(c.m.sector_months, corr.macro_deltas(c.m.macro))


EXCESS = "(select s.ym, s.sector, s.ret - m.mkt_m as ret from sector_months s join market_months m on s.ym = m.ym)"
CORR_LAG1 = CORR_SQL.replace("sector_months s", f"{EXCESS} s").replace("d.ym = s.ym", "d.ym + interval 1 month = s.ym")
CORR_REL = CORR_SQL.replace("sector_months s", f"{EXCESS} s")


@query("d6_lagged_relative_correlation", f"select sector, factor, corr, n, {T} as t, abs({T}) >= 2 as sig, 1 as lag from ({CORR_LAG1}) q", "corr t")
def _(c):
    return corr.sector_macro_corr(corr.excess_months(c.m.sector_months, c.m.market_months), corr.macro_deltas(c.m.macro), lag=1)


@query("d7_cross_sector_correlation", """select a.sector as a, b.sector as b, corr(a.ret, b.ret) as corr, count(*) as n from sector_months a join sector_months b on a.ym = b.ym
 group by 1, 2 having count(*) >= 8 and var_pop(a.ret) > 0 and var_pop(b.ret) > 0""", "corr")
def _(c):
    return corr.cross_sector_corr(c.m.sector_months)


LEAD = """select a.sector as leader, b.sector as follower, corr(a.ret, b.ret) as corr, count(*) as n from sector_months a join sector_months b
 on b.ym = a.ym + interval 1 month and a.sector <> b.sector group by 1, 2 having count(*) >= 8 and var_pop(a.ret) > 0 and var_pop(b.ret) > 0"""


@query("d8_lead_lag", f"select leader, follower, corr, n, {T} as t from ({LEAD}) q order by abs({T}) desc, leader, follower limit 25", "corr t")
def _(c):
    return corr.lead_lag(c.m.sector_months)


PRIORS = """select concat('Sector ', n_nationkey) as sector, k as factor, d as delta, case k when 'policy_rate' then n_nationkey % 3 - 1 when 'pkr_depreciation' then n_nationkey % 5 - 2 else n_nationkey % 2 end as prior
 from nation, (values ('policy_rate','d_policy_rate'),('pkr_depreciation','pkr_depr'),('oil','oil_ret')) f(k, d)"""
COMPARED = f"""select p.sector, p.factor, cast(p.prior as double) as prior, q.corr as empirical_corr, {T} as t, case when sign(p.prior) <> 0 and sign(q.corr) <> 0 then sign(p.prior) = sign(q.corr) end as agrees
 from ({PRIORS}) p join ({CORR_REL}) q on p.sector = q.sector and p.delta = q.factor"""


def _compared(c):
    measured = corr.sector_macro_corr(corr.excess_months(c.m.sector_months, c.m.market_months), corr.macro_deltas(c.m.macro))
    return corr.prior_vs_empirical(c.view("sector_graph"), measured)


@query("d9_agreement_rate", f"select avg(agrees::int) as rate, count(agrees) as n, cast(1.0 as double) as min_abs_t from ({COMPARED}) q where abs(t) >= 1", "rate")
def _(c):
    return corr.agreement_rate(_compared(c), 1.0)


def _study(c):
    return eventstudy.event_study(c.view("catalog_events"), baskets.abnormal_returns(c.m.sector_daily, c.m.market), eventstudy.trading_days(c.m.market))


@query("d10_event_study", "select * from study", "pre event post drift")
def _(c):
    return _study(c)


@query("d11_car_by_type", "select type, avg(pre) as pre, avg(event) as event, avg(post) as post, avg(drift) as drift, count(event) as n from study group by type", "pre event post drift")
def _(c):
    return eventstudy.car_by_type(_study(c))


@query("d12_event_hit_rate", "select type, avg((sign(event) = sign(expected_sign))::int) as hit_rate, count(event) as n from study where event is not null and expected_sign <> 0 group by type", "hit_rate")
def _(c):
    return eventstudy.hit_rate(_study(c))


def _perf(rel: str, keys: str) -> str:
    return f"""select {keys}, pow(exp(sum(ln(1+ret))), 248.0/count(ret)) - 1 as cagr, avg(ret)/(stddev_samp(ret)+1e-12)*sqrt(248) as sharpe, min(eq/pk-1) as max_dd, avg((ret > 0)::int) as win from (
 select *, max(eq) over (partition by {keys} order by date rows unbounded preceding) as pk from (select *, exp(sum(ln(1+ret)) over (partition by {keys} order by date rows unbounded preceding)) as eq from {rel}) q) z group by {keys}"""


@query("d13_perf_stats", _perf("hierarchy", "strategy"), "cagr sharpe max_dd win")
def _(c):
    return trend.perf_stats(trend.hierarchy_variants(c.m.market, c.m.rates), ["strategy"])


@query("d15_verify_edge", _perf("variants", "strategy"), "cagr sharpe max_dd win")
def _(c):
    return trend.perf_stats(trend.edge_variants(c.m.market), ["strategy"])


HALVES = "(select *, unnest(['full', case when date < date '1998-07-01' then 'first' else 'second' end]) as period from hierarchy)"


@query("d16_subperiod_report", f"""select *, (select avg(rate) from policy_days) as avg_policy_rate, (select case when exposure >= 0.5 then 'RISK-ON' else 'RISK-OFF' end from flags order by date desc limit 1) as current_signal
 from ({_perf(HALVES, 'period, strategy')}) p""", "cagr sharpe max_dd win avg_policy_rate")
def _(c):
    return trend.subperiod_report(c.m.market, c.m.rates, "1998-07-01")


STATS = """select symbol, name, sector, start, "end", (("end" - start) / 365.25) as years, exp(l - f) as end_mult, exp(pk - f) as peak_mult,
 case when ("end" - start) / 365.25 > 0.5 then pow(exp(l - f), 365.25 / ("end" - start)) - 1 end as cagr, (select min(p.date) from prices p where p.symbol = g.symbol and round(p.cumlog, 9) = round(pk, 9)) as peak_date, med_adv, last_close
 from (select symbol, max_by(name, date) as name, max_by(sector_name, date) as sector, min(date) as start, max(date) as "end", min_by(cumlog, date) as f, max_by(cumlog, date) as l, max(cumlog) as pk,
 quantile_cont(adv_20, 0.5) as med_adv, max_by(close, date) as last_close from prices group by symbol having count(*) >= 60) g where med_adv >= 30000 and last_close >= 2"""


@query("d17_symbol_stats", STATS, "years end_mult peak_mult cagr med_adv last_close")
def _(c):
    return history.symbol_stats(c.m.prices, 30_000.0)


@query("d18_multibaggers", f"""select symbol, name, sector, end_mult, peak_mult, cagr, years, peak_date from ({STATS}) q where round(years, 1) >= 1.5 and round(peak_mult, 2) >= 1.8 order by peak_mult desc, symbol limit 30""", "end_mult peak_mult cagr years")
def _(c):
    return history.multibaggers(history.symbol_stats(c.m.prices, 30_000.0), 1.8)


@query("d19_top_gainers_by_year", f"select cast(year as int) as year, symbol, sector, ret from ({YEARLY}) q qualify row_number() over (partition by year order by ret desc, symbol) <= 5", "ret")
def _(c):
    return history.top_gainers_by_year(c.m.prices, MIN_ADV, 5, 40)


RATED = """select s.ym, s.ret as basket, s.ret - m.mkt_m as excess, m.mkt_m, (select r.rate from rate_events r where r.date <= last_day(s.ym) order by r.date desc limit 1) as rate
 from sector_months s join market_months m on s.ym = m.ym where s.sector = 'Sector 7'"""
SPLIT = f"""select case when rate < 25 then 'low' when rate < 26 then 'mid' else 'high' end as bucket, count(*) as n_months, avg(basket) as basket_avg, avg(excess) as excess_avg, avg(mkt_m) as mkt_avg from ({RATED}) q where rate is not null group by 1"""


def _rated(c):
    basket = c.m.sector_months.filter("sector = 'Sector 7'")
    return history.rate_months(basket, c.m.market_months, c.m.rates)


@query("d20_rate_regime_split", SPLIT, "basket_avg excess_avg mkt_avg")
def _(c):
    return history.rate_regime_split(_rated(c), 25.0, 26.0)


MONTHLY = """select symbol, ym, exp(k - lag(k) over (partition by symbol order by ym)) - 1 as ret from (select symbol, cast(date_trunc('month', date) as date) as ym, max_by(cumlog, date) as k from prices group by 1, 2) q"""


@query("d21_level_correlation", f"""with x as (select 'basket' as series, rate, basket as y from ({RATED}) q union all select 'excess', rate, excess from ({RATED}) q
 union all select symbol, rate, m.ret from ({MONTHLY}) m join ({RATED}) q on m.ym = q.ym) select series, corr, n, {T} as t from (select series, corr(rate, y) as corr, count(*) as n from x where rate is not null and y is not null group by 1 having count(*) >= 8) z""", "corr t")
def _(c):
    return history.level_correlation(_rated(c), history.symbol_months(c.m.prices), c.m.market_months, c.m.rates)


@query("d21_name_rate_regimes", f"""with x as (select m.symbol, m.ret - q.mkt_m as x, case when rate < 25 then 'low' when rate < 26 then 'mid' when rate >= 26 then 'high' end as b from ({MONTHLY}) m join ({RATED}) q on m.ym = q.ym where m.ret is not null)
 select symbol, avg(x) filter (b = 'high') as excess_high, avg(x) filter (b = 'low') as excess_low, count(x) filter (b = 'high') as n_high, count(x) filter (b = 'low') as n_low from x group by 1""", "excess_high excess_low")
def _(c):
    return history.name_rate_regimes(_rated(c), history.symbol_months(c.m.prices), c.m.market_months, 25.0, 26.0)


@query("d22_surge_meta", f"select count(*) as n_episodes, avg(fwd) as avg_fwd, quantile_cont(fwd, 0.5) as median_fwd, avg((fwd > 0)::int) as continued_up_rate, avg(prior_mom) as avg_prior_momentum from ({SURGES}) q",
       "avg_fwd median_fwd continued_up_rate avg_prior_momentum")
def _(c):
    return episodes.surge_meta(episodes.surge_episodes(c.m.prices, 0.25, 20, MIN_ADV))


@query("d22_surge_sectors", f"select sector, count(*) as count from ({SURGES}) q group by 1 order by 2 desc, 1 limit 6")
def _(c):
    return episodes.top_sectors(episodes.surge_episodes(c.m.prices, 0.25, 20, MIN_ADV))


@query("d23_dip_rebounds", f"select count(*) as n_episodes, avg(fwd) as avg_rebound, quantile_cont(fwd, 0.5) as median_rebound, avg((fwd > 0)::int) as rebound_positive_rate from ({DIPS}) q", "avg_rebound median_rebound rebound_positive_rate")
def _(c):
    return episodes.dip_meta(episodes.dip_episodes(c.m.prices, -0.2, 20, 40, MIN_ADV))


@query("d23_deepest_dips", f"select symbol, sector, date, move, fwd from ({DIPS}) q order by move, symbol, date limit 12", "move fwd")
def _(c):
    return episodes.deepest_dips(episodes.dip_episodes(c.m.prices, -0.2, 20, 40, MIN_ADV))


@query("d24_shock_response", """select date, title, into_event, rebound_after from (select a.date, a.title, exp(l.loglevel - p.loglevel) - 1 as into_event, exp(n.loglevel - l.loglevel) - 1 as rebound_after
 from anchored a join (select days.idx, loglevel from levels join days on levels.date = days.date) l on l.idx = a.idx join (select days.idx, loglevel from levels join days on levels.date = days.date) p on p.idx = a.idx - 10
 join (select days.idx, loglevel from levels join days on levels.date = days.date) n on n.idx = a.idx + 20 where a.type in ('1-URGENT', '2-HIGH') and a.idx + 40 <= (select max(idx) from days)) q group by all""", "into_event rebound_after")
def _(c):
    return eventstudy.shock_response(c.view("catalog_events"), c.m.market, ["1-URGENT", "2-HIGH"])


@query("d25_sector_booms", """select s.ym, s.sector, s.ret, m.policy_rate from sector_months s left join macro m on cast(date_trunc('month', m.date) as date) = s.ym
 where ret >= (select quantile_cont(ret, 0.9) from sector_months where sector in (select name from sector_dim where is_operating)) and ret <= 0.8 and sector in (select name from sector_dim where is_operating) order by ret desc, sector, s.ym limit 40""", "ret policy_rate")
def _(c):
    return history.sector_booms(c.m.sector_months.join(c.m.operating, "sector", "left_semi"), c.m.macro)


@query("d26_mood_backtest", """with f as (select l.date, exp(lead(loglevel, 20) over (order by l.date) - loglevel) - 1 as fwd from levels l),
 b as (select case when mood <= 20 then 'Extreme Fear' when mood <= 40 then 'Fear' when mood <= 60 then 'Neutral' when mood <= 80 then 'Greed' else 'Extreme Greed' end as band,
  case when mood <= 20 then 1 when mood <= 40 then 2 when mood <= 60 then 3 when mood <= 80 then 4 else 5 end as o, fwd from f join mood m on f.date = m.date where fwd is not null),
 g as (select band, o, count(*) as n, avg(fwd) as avg_fwd, quantile_cont(fwd, 0.5) as median_fwd, avg((fwd > 0)::int) as up_rate from b group by 1, 2)
 select band, n, avg_fwd, median_fwd, up_rate, (select min_by(avg_fwd, o) > max_by(avg_fwd, o) + 0.005 from g) as contrarian from g""", "avg_fwd median_fwd up_rate")
def _(c):
    return mood.mood_backtest(c.m.market, c.m.mood, 20)


def _surge(c):
    return panels.surge_panel(c.m.prices, MIN_ADV, 0.25)


@query("d27_decile_lift", """select cast(decile as int) as decile, avg(surge) as rate, count(*) as n, avg(surge) / (select avg(surge) from surge_panel) as lift from (
 select surge, greatest(0, ceil((rn - 1) * 10.0 / (n - 1)) - 1) as decile from (select surge, row_number() over (order by round(ret_60, 9), ym, symbol) as rn, count(*) over () as n from surge_panel) q) z group by 1""", "rate lift")
def _(c):
    return X.decile_lift(_surge(c).withColumn("score", F.round("ret_60", 9)), "score", "surge")


@query("d28_auc", """select (sum(rk * surge) - sum(surge) * (sum(surge) + 1) / 2) / (sum(surge) * sum(1 - surge)) as auc, cast(sum(surge) as bigint) as positives, cast(sum(1 - surge) as bigint) as negatives from (
 select surge, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk from (select surge, round(log_adv, 1) as s from surge_panel) q) z""", "auc")
def _(c):
    return X.auc(_surge(c).withColumn("score", F.round("log_adv", 1)), "score", "surge")


@query("d29_sector_base_rates", "select sector_name, avg(surge) as surge_rate, count(*) as n from surge_panel group by 1 having count(*) >= 50", "surge_rate")
def _(c):
    return X.base_rates(_surge(c), "surge")


def rounded(df, *columns: str):
    """Both engines rank values of 12 decimals: they add in different orders."""
    return df.withColumns({x: F.round(F.col(x).cast("double"), 12) for x in columns})


_FEATS = ", ".join(f"cast({f} as double) as {f}" for f in PANEL_FEATURES)
LONG = f"(unpivot (select ym, symbol, fwd_1, {_FEATS} from eligible where fwd_1 is not null) on {', '.join(PANEL_FEATURES)} into name feature value v)"


@query("d30_rank_ic", f"""with l as (select ym, feature, round(v, 12) as x, round(fwd_1, 12) as y from {LONG} u where v is not null),
 r as (select ym, feature, x, rank() over (partition by ym, feature order by x) + (count(*) over (partition by ym, feature, x) - 1) / 2.0 as rx, rank() over (partition by ym, feature order by y) + (count(*) over (partition by ym, feature, y) - 1) / 2.0 as ry from l),
 g as (select ym, feature, corr(rx, ry) as ic from r group by 1, 2 having count(*) >= 12 and count(distinct x) > 3 and var_pop(rx) > 0 and var_pop(ry) > 0)
 select feature, avg(ic) as mean_ic, avg(ic) / (stddev_pop(ic) + 1e-9) * sqrt(count(*)) as t, avg((ic > 0)::int) as hit, count(*) as n_months from g group by 1 having count(*) > 5""", "mean_ic t hit")
def _(c):
    return X.rank_ic(rounded(c.m.eligible, *PANEL_FEATURES, "fwd_1"), PANEL_FEATURES, "fwd_1")


TOPF = "(select *, row_number() over (partition by ym order by fwd_1 desc, symbol) <= 5 as best from eligible where fwd_1 is not null)"


@query("d31_profile_difference", f"""select feature, avg(v) filter (best) as surger_mean, avg(v) filter (not best) as other_mean, (avg(v) filter (best) - avg(v) filter (not best)) / (stddev_samp(v) + 1e-9) as std_diff
 from (unpivot (select best, {_FEATS} from {TOPF} z) on {', '.join(PANEL_FEATURES)} into name feature value v) u group by 1""", "surger_mean other_mean std_diff")
def _(c):
    return X.profile_diff(c.m.eligible, PANEL_FEATURES, "fwd_1")


@query("d31_surger_summary", f"select count(*) as n_surgers, avg(fwd_1) as avg_fwd, quantile_cont(fwd_1, 0.5) as median_fwd, min(fwd_1) as min_fwd from {TOPF} q where best", "avg_fwd median_fwd min_fwd")
def _(c):
    return X.surger_summary(X.top_rows(c.m.eligible, "fwd_1"), "fwd_1")


@query("d32_surge_drivers", f"""with sf as (select ym, sector, exp(ln(1+0.0) + sum(ln(1+ret)) over (partition by sector order by ym rows between 1 following and 1 following)) - 1 as sfwd from sector_months),
 q as (select ym, quantile_cont(sfwd, 0.75) as thr from sf where sfwd is not null group by 1),
 d as (select symbol, date, max(r1) over f as maxday, avg(value) over f as av, avg(value) over (partition by symbol order by date rows between 60 preceding and 1 preceding) as pv, count(*) over f as n_after, list({{'r': r1, 'd': date}}) over f as win
   from prices window f as (partition by symbol order by date rows between 1 following and 21 following)),
 r as (select t.fwd_1 as fwd, sf.sfwd, coalesce(sf.sfwd >= q.thr, false) as boom, case when fwd_1 > 0 and n_after > 3 then case when maxday > 0 then ln(1+maxday)/ln(1+fwd_1) else 0.0 end end as ss,
   case when fwd_1 > 0 and n_after > 3 then av / pv end as vs, case when fwd_1 > 0 and n_after > 3 then month(list_sort(list_transform(list_filter(win, lambda x: x.r = maxday), lambda x: x.d))[1]) end as pm
   from {TOPF} t join d on t.symbol = d.symbol and t.date = d.date left join sf on sf.ym = t.ym and sf.sector = t.sector_name left join q on q.ym = t.ym where best and t.ym in (select ym from sector_months))
 select count(*) as n, avg(boom::int) as pct_in_booming_sector, avg(fwd) as avg_surge, avg(sfwd) as avg_sector_move, avg(sfwd)/avg(fwd) as sector_share, 1 - avg(sfwd)/avg(fwd) as idiosyncratic_share, avg(ss) as avg_single_day_share,
  avg((ss > 0.5)::int) as pct_single_day_driven, quantile_cont(case when ss is not null then vs end, 0.5) as median_volume_spike, avg(case when ss is not null then (pm in (2,3,4,8,9,10))::int end) as pct_peak_in_results_season from r""",
       "pct_in_booming_sector avg_surge avg_sector_move sector_share idiosyncratic_share avg_single_day_share pct_single_day_driven median_volume_spike pct_peak_in_results_season")
def _(c):
    return drivers.driver_summary(drivers.driver_rows(c.m.eligible, c.m.prices, c.m.sector_months))


def ic_sql(rel: str, score: str) -> str:
    return f"""select h, ym, corr(rx, ry) as ic from (select h, ym, rank() over (partition by h, ym order by round({score}, 12)) + (count(*) over (partition by h, ym, round({score}, 12)) - 1) / 2.0 as rx,
 rank() over (partition by h, ym order by round(fwd, 12)) + (count(*) over (partition by h, ym, round(fwd, 12)) - 1) / 2.0 as ry from {rel} where fwd is not null and {score} is not null) q group by 1, 2"""


TILT_LONG = f"(select ym, symbol, fscore, h, case h when 1 then fwd_1 when 2 then fwd_2 else fwd_3 end as fwd from ({TILT_SQL}) q, (values (1),(2),(3)) v(h))"
TILT_MONTHS = f"""select a.h, a.ym, a.top, a.uni, a.bot, i.ic, a.top - a.uni as spread, a.top - a.bot as ls from (
 select h, ym, avg(fwd) filter (t <= k) as top, avg(fwd) as uni, avg(fwd) filter (b <= k) as bot from (
  select *, greatest(3, cast(floor(n * 0.2) as int)) as k from (select *, row_number() over (partition by h, ym order by fscore desc, symbol) as t, row_number() over (partition by h, ym order by fscore asc, symbol) as b, count(*) over (partition by h, ym) as n
   from {TILT_LONG} l where fwd is not null and fscore is not null) z where n >= 15) y group by 1, 2) a join ({ic_sql(TILT_LONG + ' l', 'fscore')}) i on a.h = i.h and a.ym = i.ym"""


def spaced(rel: str) -> str:
    """Recursive CTE body: months of ``rel`` at least h after the one kept before."""
    return f"""sp as (select h, min(year(ym)*12+month(ym)) as x from {rel} group by 1 union all
 select sp.h, (select min(year(r.ym)*12+month(r.ym)) from {rel} r where r.h = sp.h and year(r.ym)*12+month(r.ym) >= sp.x + sp.h) from sp where sp.x is not null)"""


def _tilt(c):
    scored = E.tilt_score(c.m.eligible.select("ym", "symbol", *fv.TILT_FACTORS, "fwd_1", "fwd_2", "fwd_3"))
    return E.tilt_months(rounded(E.by_horizon(scored, (1, 2, 3), ["ym", "symbol", "fscore"]), "fscore", "fwd"))


@query("d33_factor_portfolio", f"""with recursive tm as materialized ({TILT_MONTHS}), {spaced('tm')},
 e as (select tm.h, pow(exp(sum(ln(1 + top - 0.005))), 12.0 / tm.h / count(*)) - 1 as ann_top_net from tm join sp on tm.h = sp.h and year(ym)*12+month(ym) = sp.x group by 1)
 select cast(tm.h as int) as H, count(*) as n_months, avg(top) as top_avg_fwd, avg(uni) as universe_avg_fwd, avg(bot) as bottom_avg_fwd, avg(spread) as spread, avg(spread)/(stddev_samp(spread)+1e-9)*sqrt(count(*)) as spread_t,
 avg(ls) as longshort_avg, avg(ls)/(stddev_samp(ls)+1e-9)*sqrt(count(*)) as longshort_t, avg(ic) as ic_mean, avg(ic)/(stddev_samp(ic)+1e-9)*sqrt(count(*)) as ic_t, avg((spread > 0)::int) as hit_rate,
 exp(avg(ln(1+uni)) * 12 / tm.h) - 1 as ann_universe, max(ann_top_net) as ann_top_net, avg(spread)/(stddev_samp(spread)+1e-9)*sqrt(count(*)) >= 2 and avg((spread > 0)::int) >= 0.55 as reliable from tm join e on tm.h = e.h group by tm.h""",
       "top_avg_fwd universe_avg_fwd bottom_avg_fwd spread spread_t longshort_avg longshort_t ic_mean ic_t hit_rate ann_universe ann_top_net")
def _(c):
    return E.tilt_summary(_tilt(c))


@query("d43_t_of_means", f"select cast(h as int) as H, avg(ic)/(stddev_samp(ic)+1e-9)*sqrt(count(*)) as ic_t, avg(spread)/(stddev_samp(spread)+1e-9)*sqrt(count(*)) as spread_t, avg(ls)/(stddev_samp(ls)+1e-9)*sqrt(count(*)) as ls_t from ({TILT_MONTHS}) q group by h", "ic_t spread_t ls_t")
def _(c):
    return _tilt(c).groupBy("H").agg(S.t_of_mean("ic").alias("ic_t"), S.t_of_mean("spread").alias("spread_t"), S.t_of_mean("ls").alias("ls_t"))


@query("d44_annual_compounding", f"""with recursive tm as materialized ({TILT_MONTHS}), {spaced('tm')} select cast(tm.h as int) as H, count(*) as n, pow(exp(sum(ln(1 + top))), 12.0 / tm.h / count(*)) - 1 as annual_top, exp(avg(ln(1 + uni)) * 12 / tm.h) - 1 as annual_universe
 from tm join sp on tm.h = sp.h and year(ym)*12+month(ym) = sp.x group by tm.h""", "annual_top annual_universe")
def _(c):
    kept = E.rebalance_months(_tilt(c))
    return kept.groupBy("H").agg(F.count("ym").alias("n"), E.annualised(F.col("top"), F.col("H")).alias("annual_top"), E.mean_log_annual(F.col("uni"), F.col("H")).alias("annual_universe"))


NOT_NULL = " and ".join(f"{f} is not null" for f in PANEL_FEATURES)
RULE_LONG = f"(select ym, symbol, date, score, h, case h when 1 then fwd_1 when 2 then fwd_2 else fwd_3 end as fwd from (select ym, symbol, date, fwd_1, fwd_2, fwd_3, {RULE} as score from eligible where {NOT_NULL} window w as (partition by ym)) q, (values (1),(2),(3)) v(h))"

def scored_months_sql(rows: str, skip: int) -> str:
    """The months of scored rows (ym, symbol, score, h, fwd) in SQL."""
    return f"""select z.h, z.ym, z.top, z.uni, z.bot, i.ic, z.prec, z.top - z.uni as spread from (
 select h, ym, avg(fwd) filter (t <= 5) as top, avg(fwd) as uni, avg(fwd) filter (b <= 5) as bot, count(*) filter (t <= 5 and fwd is not null and best <= 5) / 5.0 as prec, count(*) as nt, count(fwd) as ne, dense_rank() over (partition by h order by ym) as i from (
  select *, row_number() over (partition by h, ym order by score desc nulls last, symbol) as t, row_number() over (partition by h, ym order by score asc nulls last, symbol) as b, row_number() over (partition by h, ym order by fwd desc nulls last, symbol) as best from {rows} l) y group by 1, 2) z
 join ({ic_sql(rows + ' l', 'score')}) i on z.h = i.h and z.ym = i.ym where nt >= 10 and ne >= 10 and z.i > {skip}"""


SCORED_MONTHS = scored_months_sql(RULE_LONG, 12)


def rule_scored(c):
    rows = c.m.eligible.dropna(subset=PANEL_FEATURES).select(*rules.PICK_COLUMNS, "fwd_1", "fwd_2", "fwd_3")
    return E.by_horizon(rules.rule_score(rows), (1, 2, 3), ["ym", "symbol", "date", "score"])


def rule_months(c):
    return E.scored_months(rounded(rule_scored(c), "score", "fwd"), skip_months=12)


@query("d34_scored_months", f"select cast(h as int) as H, ym, top, uni, bot, ic, prec, spread from ({SCORED_MONTHS}) q", "top uni bot ic prec spread")
def _(c):
    return rule_months(c)


def evaluation_sql(months: str) -> str:
    """The summary of scored months in SQL."""
    return f"""with recursive sm as materialized ({months}), {spaced('sm')},
 e as (select sm.h, pow(exp(sum(ln(1 + top - 0.005))), 12.0 / sm.h / count(*)) - 1 as ann_top_net from sm join sp on sm.h = sp.h and year(ym)*12+month(ym) = sp.x group by 1),
 g as (select h, count(*) as n_months, avg(ic) as ic_mean, avg(ic)/(stddev_samp(ic)+1e-9)*sqrt(count(*)) as ic_t, avg(top) as top_avg_fwd, avg(uni) as universe_avg_fwd, avg(bot) as bottom_avg_fwd, avg(spread) as spread, avg((spread > 0)::int) as hit_rate,
  avg(prec) as precision_at_k, exp(avg(ln(1+uni)) * 12 / h) - 1 as ann_universe, avg(spread) filter (k <= 18) as recent_spread, avg((spread > 0)::int) filter (k <= 18) as recent_hit from (select *, row_number() over (partition by h order by ym desc) as k from sm) q group by h)
 select cast(g.h as int) as H, g.* exclude (h), ann_top_net, case when ic_t >= 2 and hit_rate >= 0.55 and spread > 0.005 then 'reliable' when spread > 0 and ic_t >= 1 then 'weak' else 'not_reliable' end as verdict from g join e on g.h = e.h"""


EVALUATED = "ic_mean ic_t top_avg_fwd universe_avg_fwd bottom_avg_fwd spread hit_rate precision_at_k ann_universe recent_spread recent_hit ann_top_net"


@query("d34_score_evaluation", evaluation_sql(SCORED_MONTHS), EVALUATED)
def _(c):
    return E.score_summary(rule_months(c))


LEGS = f"""select h, leg, ym, ret from (select h, ym, unnest(['top','universe','bottom']) as leg, unnest([top - 0.005, uni, bot - 0.005]) as ret from (select *, row_number() over (partition by h order by ym) - 1 as i from ({SCORED_MONTHS}) q) z where i % h = 0) y"""
LEG_PERF = f"""select h, leg, n, pow(m, 12.0/h/n) - 1 as cagr, s * sqrt(12.0/h) as vol, a * 12.0/h / (s * sqrt(12.0/h) + 1e-9) as sharpe, max_dd, pow(m, 1.0/n) - 1 as geo_per_period, m as multiple from (
 select h, leg, count(*) as n, avg(ret) as a, stddev_samp(ret) as s, exp(sum(ln(1+ret))) as m, min(eq/pk-1) as max_dd from (select *, max(eq) over (partition by h, leg order by ym rows unbounded preceding) as pk from (
  select *, exp(sum(ln(1+ret)) over (partition by h, leg order by ym rows unbounded preceding)) as eq from ({LEGS}) l) e) f group by 1, 2 having count(*) >= 3) g"""


@query("d14_period_performance", f"select cast(h as int) as H, * exclude (h) from ({LEG_PERF}) q", "cagr vol sharpe max_dd geo_per_period multiple")
def _(c):
    return E.leg_perf(E.leg_returns(rule_months(c)))


@query("d35_volatility_matched", f"""with p as materialized ({LEG_PERF}), m as (select h, avg(ret) as mean from ({LEGS}) l where leg = 'top' group by 1)
 select cast(t.h as int) as H, case when u.sharpe > 0 then u.vol / (t.vol + 1e-9) end as lever_to_uni_vol, case when u.sharpe > 0 then mean * u.vol / (t.vol + 1e-9) * 12.0 / t.h end as top_levered_return, case when u.sharpe > 0 then t.sharpe > u.sharpe end as beats_universe from p t join p u on t.h = u.h and t.leg = 'top' and u.leg = 'universe' join m on m.h = t.h""",
       "lever_to_uni_vol top_levered_return")
def _(c):
    legs = E.leg_returns(rule_months(c))
    return E.volatility_matched(E.leg_perf(legs), legs)


STATE = "(select date, level / (case when count(level) over w >= 20 then max(level) over w end) - 1 as dd, exposure from flags window w as (order by date rows between 62 preceding and current row))"
TAGGED = f"""select s.*, coalesce((select dd from {STATE} x where x.date <= e.d and dd is not null order by x.date desc limit 1) <= -0.02, false) as postdip,
 coalesce((select exposure from flags x where x.date <= e.d order by x.date desc limit 1) >= 0.5, false) as risk_on, coalesce(m.policy_rate - b.policy_rate < -0.25, false) as easing,
 coalesce(m.cpi_yoy > (select quantile_cont(cpi_yoy, 0.5) from macro), false) as high_infl, month(s.ym) in (5,6,7) as budget
 from ({SCORED_MONTHS}) s join (select ym, max(date) as d from eligible group by 1) e on e.ym = s.ym left join macro m on cast(date_trunc('month', m.date) as date) = s.ym
 left join macro b on cast(date_trunc('month', b.date) as date) = s.ym - interval 3 month"""
MASKS = """(values ('all'),('post_dip'),('normal'),('risk_on'),('risk_off'),('easing'),('not_easing'),('high_inflation'),('low_inflation'),('budget_season'),('gated')) r(regime)
 where case regime when 'all' then true when 'post_dip' then postdip when 'normal' then not postdip when 'risk_on' then risk_on when 'risk_off' then not risk_on when 'easing' then easing when 'not_easing' then not easing
 when 'high_inflation' then high_infl when 'low_inflation' then not high_infl when 'budget_season' then budget else risk_on and (postdip or easing) end"""


def tagged(c):
    entry = c.m.eligible.groupBy("ym").agg(F.max("date").alias("date"))
    return E.context_flags(rule_months(c), entry, E.market_state(c.m.market), c.m.macro, dip=-0.02)


@query("d36_context_table", f"""select cast(h as int) as H, regime, n, case when n >= 4 then top_avg end as top_avg, case when n >= 4 then uni_avg end as uni_avg, case when n >= 4 then spread end as spread, case when n >= 4 then spread_t end as spread_t, case when n >= 4 then hit end as hit
 from (select h, regime, count(*) as n, avg(top) as top_avg, avg(uni) as uni_avg, avg(spread) as spread, avg(spread)/(stddev_samp(spread)+1e-9)*sqrt(count(*)) as spread_t, avg((spread > 0)::int) as hit from ({TAGGED}) g, {MASKS} group by 1, 2) z""",
       "top_avg uni_avg spread spread_t hit")
def _(c):
    return E.context_table(tagged(c))


KEYWORDS = {"Cement": ["cement", "the"], "Fertilizer": ["gas feedstock", "on"], "Refinery": ["e&p", "le"], "Chemical": ["pta", "der", "qu"]}
_PATTERNS = {s: r"(?:^|[^\pL\pN_])(?:" + "|".join(k.replace("&", "\\&") for k in ks) + ")" for s, ks in KEYWORDS.items()}
LINKED = "list_filter([" + ", ".join(f"case when regexp_matches(lower(headline), '{p}') then '{s}' end" for s, p in _PATTERNS.items()) + "], lambda x: x is not null)"


@query("d37_weighted_sentiment", f"""select sector, sum(w*s)/sum(w) as score, sum(w) as weight from (select unnest(case when len(sectors) > 0 then sectors else {LINKED} end) as sector,
 case coalesce(tier, 3) when 1 then 1.0 when 2 then 0.8 when 3 then 0.55 when 4 then 0.4 when 5 then 0.15 else 0.5 end as w, coalesce(sentiment, 0) as s from news) q group by 1""", "score weight")
def _(c):
    return text.weighted_sentiment(c.view("news"), KEYWORDS)


@query("d38_flow_summary", """select date as as_of, fipi / 1e6 as fipi_last_m, s5 / 1e6 as fipi_5d_m, cum / 1e6 as fipi_cum_m, case when s5 > 0 then 'net BUYER' else 'net SELLER' end as stance,
 (select event_type from (select event_type, sum(value) as v from events group by 1) order by v desc, event_type desc limit 1) as top_buyer, (select event_type from (select event_type, sum(value) as v from events group by 1) order by v, event_type limit 1) as top_seller
 from (select *, sum(fipi) over (order by date rows between 4 preceding and current row) as s5, sum(fipi) over (order by date rows unbounded preceding) as cum from flows) q order by date desc limit 1""", "fipi_last_m fipi_5d_m fipi_cum_m")
def _(c):
    return flows.flow_summary(c.view("flows"), c.view("client_flows"))


SNAP = """select sector, exp(sum(ln(1+r)) filter (k <= 21)) - 1 as r_1m, exp(sum(ln(1+r)) filter (k <= 63)) - 1 as r_3m, exp(sum(ln(1+r))) - 1 as r_12m, stddev_samp(r) * sqrt(248) as vol_ann
 from (select *, row_number() over (partition by sector order by date desc) as k from sector_daily) q where k <= 248 group by 1"""


@query("d39_sector_snapshot", SNAP, "r_1m r_3m r_12m vol_ann")
def _(c):
    return history.sector_snapshot(c.m.sector_daily)


@query("d39_leaders_index", f"select sector, ym, exp(sum(ln(1+ret)) over (partition by sector order by ym rows unbounded preceding)) as level from sector_months where sector in (select sector from ({SNAP}) s order by r_12m desc nulls last, sector limit 12)", "level")
def _(c):
    return history.leaders_index(history.sector_snapshot(c.m.sector_daily), c.m.sector_months)


@query("d40_coverage_counts", "select count(*) as rows, count(policy_rate) as policy_rate, count(cpi_yoy) as cpi_yoy, count(pkr_usd) as pkr_usd, count(brent_usd) as brent_usd, count(remittances_bn) as remittances_bn, count(fx_reserves_sbp_bn) as fx_reserves_sbp_bn from macro")
def _(c):
    from panelkit.plans.report import coverage

    return coverage(c.m.macro.drop("date"))


@query("d40_universe_size", "select (select count(distinct symbol) from prices) as n_symbols, (select count(*) from market_months) as n_months, (select max(date) from prices) as as_of")
def _(c):
    from panelkit.plans.report import universe

    return universe(c.m.prices, c.m.market_months)


@query("d40_value_shares", f"select sector_name as sector, count(*) * 100.0 / sum(count(*)) over () as pct from {TOPF} q where best group by 1 order by 2 desc, 1 limit 8", "pct")
def _(c):
    return X.sector_mix(X.top_rows(c.m.eligible, "fwd_1"))


@query("d41_group_median", "select date, sector, quantile_cont(r1, 0.5) as med from prices group by 1, 2", "med")
def _(c):
    return baskets.group_median(c.m.prices, ["date", "sector"], "r1", "med")


@query("d42_latest_date", "select symbol, max(date) as last_date, (select max(date) from prices) - max(date) as days_behind from prices group by 1")
def _(c):
    latest = c.m.prices.select(F.max("date")).scalar()
    return c.m.prices.groupBy("symbol").agg(F.max("date").alias("last_date")).withColumn("days_behind", F.datediff(latest, "last_date").cast("long"))


@query("d45_daily_variants", "select date, strategy, ret from hierarchy", "ret")
def _(c):
    return trend.hierarchy_variants(c.m.market, c.m.rates)
