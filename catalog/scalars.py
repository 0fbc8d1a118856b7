"""Scalar, filter and dimension queries (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregates import COMPARED, KEYWORDS, LINKED, SPLIT, _compared, _rated, tagged, TAGGED
from catalog.registry import MIN_ADV, START, query
from catalog.windows import SIGNALS_SQL
from panelkit.functions import fixed_values as fv
from panelkit.functions import scalar as X
from panelkit.operators import baskets, clean, dims, history, text, trend
from panelkit.plans import panels, rules

LINES = """select date, volume, ldcp, case k % 10 when 0 then concat(symbol, '-JAN') when 1 then concat(symbol, 'R1') when 2 then concat(symbol, 'R') when 3 then concat('P05', symbol) when 4 then concat(symbol, 'TFC')
 when 5 then concat('SUK', symbol) when 6 then concat(symbol, 'R') else symbol end as symbol, case when k % 10 = 2 then concat(symbol, ' (R)') else symbol end as name from (select *, cast(substring(symbol, 2, 6) as bigint) as k from daily_panel) q"""


def _lines(c):
    k = F.substring("symbol", 2, 6).cast("long") % 10
    s = F.col("symbol")
    named = (
        F.when(k == 0, F.concat(s, F.lit("-JAN"))).when(k == 1, F.concat(s, F.lit("R1"))).when(k.isin(2, 6), F.concat(s, F.lit("R")))
        .when(k == 3, F.concat(F.lit("P05"), s)).when(k == 4, F.concat(s, F.lit("TFC"))).when(k == 5, F.concat(F.lit("SUK"), s)).otherwise(s)
    )
    return c.view("daily_panel").withColumns({"symbol": named, "name": F.when(k == 2, F.concat(s, F.lit(" (R)"))).otherwise(s)})


@query("b1_drop_non_equity", f"""select date, symbol, name, volume from ({LINES}) q where not contains(symbol, '-') and not (regexp_matches(symbol, 'R[0-9]$') or (regexp_matches(symbol, 'R[0-9]?$') and contains(name, '(R')))
 and not (regexp_matches(symbol, '^P[0-9][0-9]') or contains(symbol, 'TFC') or contains(symbol, 'SUK')) and ldcp > 0""")
def _(c):
    return clean.drop_non_equity(_lines(c)).select("date", "symbol", "name", "volume")


@query("b2_adjusted_return", "select date, symbol, r1 from prices", "r1")
def _(c):
    return c.m.prices.select("date", "symbol", X.simple_return("close", "ldcp").alias("r1"))


@query("b3_log_and_simple_return", "select date, ln(1+mkt_r) as logr, exp(ln(1+mkt_r)) - 1 as simple from market", "logr simple")
def _(c):
    return c.m.market.select("date", F.log1p("mkt_r").alias("logr"), F.expm1(F.log1p("mkt_r")).alias("simple"))


@query("b4_traded_value", "select date, symbol, value from prices", "value")
def _(c):
    return c.m.prices.select("date", "symbol", (F.col("close") * F.col("volume")).alias("value"))


@query("b5_sector_names", "select symbol, sector, sector_name, is_equity, count(*) as rows from prices group by 1, 2, 3, 4")
def _(c):
    named = dims.add_sector(c.view("daily_panel"), c.m.sectors)
    return named.groupBy("symbol", "sector", "sector_name", "is_equity").agg(F.count("date").alias("rows"))


@query("b6_sector_flags", "select concat('Sector ', n_nationkey) as name, n_nationkey not in (23) as is_equity, n_nationkey not in (6, 15, 23) as is_operating, coalesce(k, 0) as suppliers from nation left join (select s_nationkey, count(*) as k from supplier group by 1) s on s_nationkey = n_nationkey where n_nationkey <> 24")
def _(c):
    codes = c.table("nation").filter("n_nationkey <> 24").select(F.col("n_name").alias("code"), F.concat(F.lit("Sector "), F.col("n_nationkey").cast("string")).alias("name"))
    dim = dims.sector_dimension(codes, ["NATION_23"], ["NATION_6", "NATION_15"])
    held = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("s_suppkey").alias("k"))
    return dim.join(held, F.col("code") == F.col("n_name"), "left").select("name", "is_equity", "is_operating", F.coalesce("k", F.lit(0).cast("long")).alias("suppliers"))


@query("b7_liquid_mask", "select date, symbol, adv_20 from prices where adv_20 > 40000 and volume > 0", "adv_20")
def _(c):
    return c.m.prices.filter(clean.is_liquid(MIN_ADV, traded=True)).select("date", "symbol", "adv_20")


@query("b8_parse_contracts", "select date, base from contract_bases")
def _(c):
    return clean.parse_contracts(c.m.contract_rows)


@query("b9_calendar_parts", "select distinct date, cast(date_trunc('month', date) as date) as ym, cast(month(date) as int) as month, cast(year(date) as int) as year, last_day(date) as month_end, cast(year(date)*12+month(date) as int) as m_idx from prices")
def _(c):
    d = c.m.prices.select("date").distinct()
    return d.select("date", X.month_start("date").alias("ym"), F.month("date").alias("month"), F.year("date").alias("year"), F.last_day("date").alias("month_end"), X.month_index("date").alias("m_idx"))


@query("b10_safe_division", "select date, symbol, case when volume <> 10 then value / (volume - 10) end as per_excess, case when adv_20 <> 0 then value / adv_20 end as turnover from prices", "per_excess turnover")
def _(c):
    return c.m.prices.select("date", "symbol", X.safe_div("value", F.col("volume") - 10).alias("per_excess"), X.safe_div("value", "adv_20").alias("turnover"))


@query("b11_clipped_logs", "select date, symbol, ln(case when close < 1000 then 1000.0 else close end) as log_price, ln(1+adv_20) as log_adv from prices", "log_price log_adv")
def _(c):
    return c.m.prices.select("date", "symbol", F.log(X.floor_at("close", 1000)).alias("log_price"), F.log1p("adv_20").alias("log_adv"))


SCORES = "select date, symbol, cast(volume % 101 as double) as score from prices"


def _scores(c):
    return c.m.prices.select("date", "symbol", (F.col("volume") % 101).cast("double").alias("score"))


@query("b12_mood_label", f"select date, symbol, case when score < 20 then 'Extreme Fear' when score < 40 then 'Fear' when score < 60 then 'Neutral' when score < 80 then 'Greed' else 'Extreme Greed' end as label from ({SCORES}) q")
def _(c):
    return _scores(c).select("date", "symbol", X.mood_label("score").alias("label"))


@query("b13_mood_bands", f"select date, symbol, case when score <= 20 then 'Extreme Fear' when score <= 40 then 'Fear' when score <= 60 then 'Neutral' when score <= 80 then 'Greed' else 'Extreme Greed' end as band from ({SCORES}) q")
def _(c):
    return _scores(c).select("date", "symbol", X.mood_band("score").alias("band"))


@query("b14_sign_agreement", f"select sector, factor, agrees from ({COMPARED}) q")
def _(c):
    return _compared(c).select("sector", "factor", "agrees")


@query("b15_threshold_signals", SIGNALS_SQL, "value")
def _(c):
    return trend.threshold_signals(c.m.macro)


@query("b16_verdicts", f"""select max(case when bucket = 'high' then excess_avg end) as excess_high, max(case when bucket = 'low' then excess_avg end) as excess_low, case when max(case when bucket = 'high' then excess_avg end) is null or max(case when bucket = 'low' then excess_avg end) is null then 'insufficient' when max(case when bucket = 'high' then excess_avg end) > max(case when bucket = 'low' then excess_avg end) + 0.005 then 'supported'
 when max(case when bucket = 'high' then excess_avg end) < max(case when bucket = 'low' then excess_avg end) - 0.005 then 'not_supported' else 'mixed' end as verdict from ({SPLIT}) q""", "excess_high excess_low")
def _(c):
    return history.rate_verdict(history.rate_regime_split(_rated(c), 25.0, 26.0))


@query("b17_rate_buckets", "select date, case when policy_rate < 25 then 'low' when policy_rate < 26 then 'mid' when policy_rate >= 26 then 'high' end as bucket from macro")
def _(c):
    return c.m.macro.select("date", X.rate_bucket("policy_rate", 25, 26).alias("bucket"))


@query("b18_link_sectors", f"select item_id, unnest({LINKED}) as sector from news")
def _(c):
    return text.link_sectors(c.view("news"), KEYWORDS).select("item_id", F.explode("linked").alias("sector"))


MESSY = """select item_id, case item_id % 5 when 0 then concat('Sector ', item_id % 30) when 1 then concat(' sector ', item_id % 25) when 2 then concat('Alias ', item_id % 10) when 3 then upper(concat('Sector ', item_id % 25)) else concat('Unknown ', item_id % 3) end as name from news"""


def _messy(c):
    k = F.col("item_id")

    def named(prefix: str, n: int):
        return F.concat(F.lit(prefix), (k % n).cast("string"))

    name = F.when(k % 5 == 0, named("Sector ", 30)).when(k % 5 == 1, named(" sector ", 25)).when(k % 5 == 2, named("Alias ", 10)).when(k % 5 == 3, F.upper(named("Sector ", 25))).otherwise(named("Unknown ", 3))
    names = c.view("news").select("item_id", name.alias("name"))
    aliases = c.m.sectors.select(F.regexp_replace("name", "^Sector ", "Alias ").alias("alias"), "name")
    return dims.normalize_names(names, "name", c.m.sectors.select("name"), aliases)


NORMAL = f"select item_id, coalesce((select d.name from sector_dim d where d.name = trim(q.name)), (select d.name from sector_dim d where replace(d.name, 'Sector ', 'Alias ') = trim(q.name)), (select d.name from sector_dim d where lower(d.name) = lower(trim(q.name))), trim(q.name)) as name from ({MESSY}) q"


@query("b19_normalize_names", NORMAL)
def _(c):
    return _messy(c)


@query("b20_unresolved_names", f"select distinct 'news' as kind, name from ({NORMAL}) q where name not in (select name from sector_dim) union select distinct 'graph', n_name from nation where n_name not in (select name from sector_dim)")
def _(c):
    refs = {"news": _messy(c), "graph": c.table("nation").select(F.col("n_name").alias("name"))}
    return dims.unresolved_names(refs, c.m.sectors)


@query("b21_context_flags", f"select cast(h as int) as H, ym, postdip, risk_on, easing, high_infl, budget, month(ym) in (2,3,4,8,9,10) as results from ({TAGGED}) q")
def _(c):
    return tagged(c).select("H", "ym", "postdip", "risk_on", "easing", "high_infl", "budget", F.month("ym").isin(fv.RESULTS_MONTHS).alias("results"))


@query("b22_implausible_cap", "select ym, sector, ret from sector_months where ret >= 0.02 and ret <= 0.05", "ret")
def _(c):
    return c.m.sector_months.filter((F.col("ret") >= 0.02) & (F.col("ret") <= 0.05))


@query("b23_derived_features", "select ym, symbol, mom_accel, vol_ratio, rel_str_3m, turnover from panel", "mom_accel vol_ratio rel_str_3m turnover")
def _(c):
    return c.m.panel.select("ym", "symbol", "mom_accel", "vol_ratio", "rel_str_3m", "turnover")


@query("b24_categorical_codes", "select sector_name, sector_code from sector_numbers", "sector_code")
def _(c):
    return dims.sector_codes(c.m.prices.select("sector_name"))


@query("b25_start_filter", "select date, mkt_r from full_market where date >= date '1998-01-01'", "mkt_r")
def _(c):
    return baskets.market_index(c.m.prices, MIN_ADV, "1998-01-01")


@query("b26_rate_conversions", "select date, pow(1 + rate/100, 1.0/248) - 1 as daily, rate / 100 * 3 / 12 as carry_3m from policy_days", "daily carry_3m", digits=9)
def _(c):
    from panelkit.operators.asof import backward_asof

    r = backward_asof(c.m.market.select("date"), c.m.rates.select("date", "rate"), "rate", fill_early=True)
    return r.select("date", X.annual_to_daily(F.col("rate") / 100, 248).alias("daily"), X.period_carry("rate", 3).alias("carry_3m"))


@query("b27_net_period_return", "select * from gated_periods", "gross carry ret")
def _(c):
    return rules.gated_periods(c.m.panel, c.m.market, c.m.macro)


@query("b28_output_shaping", "select strftime(date, '%Y-%m-%d') as day, mood from mood where mood is not null", "mood", digits=1)
def _(c):
    return c.m.mood.filter("mood is not null").select(F.date_format("date", "yyyy-MM-dd").alias("day"), "mood")
