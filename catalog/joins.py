"""Join queries: context, as-of, event windows, labels, pairs (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregates import CORR_REL, CORR_SQL, COMPARED, NOT_NULL, PANEL_FEATURES, RULE, SCORED_MONTHS, T, TOPF, _compared, _study, rule_months
from catalog.registry import MIN_ADV, query
from panelkit.functions import fixed_values as fv
from panelkit.operators import asof, baskets, clean, corr, eventstudy, graph, history, months
from panelkit.operators import xsection as X
from panelkit.plans import folds, panels, rules


@query("c1_market_context", "select p.symbol, p.date, c.fm as mkt_r, c.mkt_mom_3m from prices p left join full_context c on p.date = c.date", "mkt_r mkt_mom_3m")
def _(c):
    from panelkit.operators.trend import market_momentum

    ctx = market_momentum(baskets.market_index(c.m.prices, MIN_ADV), 63, "mkt_mom_3m").select("date", "mkt_r", "mkt_mom_3m")
    return c.m.prices.select("symbol", "date").join(months.calendar_broadcast(ctx), "date", "left")


@query("c2_macro_context", "select e.symbol, e.ym, m.rate_level, m.cpi_yoy, m.pkr_chg_3m from month_ends e left join macro_context m on e.ym = m.ym", "rate_level cpi_yoy pkr_chg_3m")
def _(c):
    ctx = panels.macro_context(c.m.macro).select("ym", "rate_level", "cpi_yoy", "pkr_chg_3m")
    ends = panels.month_end_rows(c.m.prices.select("symbol", "date")).select("symbol", "ym")
    return ends.join(months.calendar_broadcast(ctx), "ym", "left")


@query("c3_policy_rate_asof", "select distinct p.date, r.rate from (select distinct date from prices) p asof left join (select date, case when change_bps < 0 then rate - 1 else rate end as rate from rate_events) r on p.date >= r.date", "rate")
def _(c):
    # rate cuts are stated twice on their date, the second time deeper; that statement holds
    first = c.m.rates.select("date", "rate", "change_bps", F.lit(1).alias("seq"))
    again = first.filter("change_bps < 0").withColumns({"rate": F.col("rate") - 1, "seq": F.lit(2)})
    return asof.backward_asof(c.m.prices.select("date").distinct(), first.unionByName(again), "rate", order="seq")


@query("c3_keyed_asof", """select o_orderkey, o.cust, o.date, p.paid from (select o_orderkey, o_custkey as cust, cast(o_orderdate as date) as date from orders) o
 asof left join (select o_custkey as cust, cast(l_shipdate as date) as date, max(l_extendedprice) as paid from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) p
 on o.cust = p.cust and o.date >= p.date""", "paid")
def _(c):
    orders = c.table("orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("date").alias("date"))
    lines = c.table("lineitem").select("l_orderkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"))
    owner = c.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"))
    steps = lines.join(owner, "l_orderkey").groupBy("cust", "date").agg(F.max("l_extendedprice").alias("paid"))
    return asof.backward_asof(orders, steps, "paid", ("cust",))


@query("c4_asof_with_early_fill", "select o_orderkey, (select coalesce(max_by(rate, date) filter (date <= cast(o_orderdate as date)), min_by(rate, date)) from rate_events) as rate from orders", "rate")
def _(c):
    # orders before the first decision need the fill
    orders = c.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return asof.backward_asof(orders, c.m.rates.select("date", "rate"), "rate", fill_early=True).drop("date")


@query("c5_signal_at_entry", "select e.ym, e.date, f.exposure from (select ym, max(date) as date from eligible group by 1) e asof left join flags f on e.date >= f.date", "exposure")
def _(c):
    from panelkit.operators.trend import trend_flags

    entry = c.m.eligible.groupBy("ym").agg(F.max("date").alias("date"))
    return asof.backward_asof(entry, trend_flags(c.m.market).select("date", "exposure"), "exposure")


@query("c6_forward_asof", "select date, type, title, sector, expected_sign, idx from anchored", "expected_sign")
def _(c):
    return eventstudy.anchor_days(c.view("catalog_events"), eventstudy.trading_days(c.m.market))


@query("c7_event_windows", "select * from study unpivot include nulls (car for window_name in (pre, event, post, drift))", "expected_sign car")
def _(c):
    from panelkit.operators.baskets import abnormal_returns

    w = eventstudy.event_windows(c.view("catalog_events"), abnormal_returns(c.m.sector_daily, c.m.market), eventstudy.trading_days(c.m.market))
    return w.withColumnRenamed("window", "window_name")


@query("c8_forward_labels", "select e.symbol, e.ym, l.fwd_1, l.fwd_2, l.fwd_3 from month_ends e join month_numbers n on e.ym = n.ym join labels_fwd l on l.symbol = e.symbol and l.m_rank = n.m_rank", "fwd_1 fwd_2 fwd_3")
def _(c):
    ends = panels.month_end_rows(c.m.prices.select("symbol", "date", "cumlog"))
    return panels.forward_labels(ends, ends).select("symbol", "ym", "fwd_1", "fwd_2", "fwd_3")


@query("c9_abnormal_returns", "select * from abnormal", "abn")
def _(c):
    return baskets.abnormal_returns(c.m.sector_daily, c.m.market)


@query("c10_eligible_months", "select * from eligible_grid")
def _(c):
    return panels.eligible_months(clean.contract_months(c.m.contracts))


@query("c10_eligibility_flag", "select symbol, ym, fut_elig, eligible from panel")
def _(c):
    return c.m.panel.select("symbol", "ym", "fut_elig", "eligible")


FOLD_ROWS = f"(select *, year(ym)*12+month(ym) as m from eligible where {NOT_NULL})"


@query("c11_purged_folds", f"""with p as materialized {FOLD_ROWS}, f as (select m, dense_rank() over (order by m) as i from (select distinct m from p) q)
 select cast(f.m as int) as fold, (select count(*) from p where p.m <= f.m - 2 and fwd_2 is not null) as n_train, (select count(*) from p where p.m = f.m) as n_test, cast((select max(m) from p where p.m <= f.m - 2 and fwd_2 is not null) as int) as last_train from f
 where i > 12 and (select count(*) from p where p.m <= f.m - 2 and fwd_2 is not null) >= 300 and (select count(*) from p where p.m = f.m) >= 10""")
def _(c):
    return folds.purged_folds(c.m.eligible.dropna(subset=PANEL_FEATURES), "fwd_2", 2, min_months=12, min_train=300, min_test=10)


@query("c12_pairs_by_month", f"select sector, factor, corr, n, {T} as t from ({CORR_SQL}) q", "corr t")
def _(c):
    t = corr.sector_macro_corr(c.m.sector_months, corr.macro_deltas(c.m.macro))
    return t.select("sector", "factor", "corr", "n", "t")


@query("c13_complete_pairs", "select s.sector, s.ym, s.ret, d.pkr_depr from sector_months s join deltas d on s.ym = d.ym where d.pkr_depr is not null", "ret pkr_depr")
def _(c):
    d = corr.macro_deltas(c.m.macro).select("ym", "pkr_depr")
    return c.m.sector_months.join(months.calendar_broadcast(d), "ym").dropna(subset=["ret", "pkr_depr"])


@query("c14_prior_against_measured", COMPARED, "prior empirical_corr t")
def _(c):
    return _compared(c)


MARKS = """with l as (select symbol, cumlog, close from prices where date = (select max(date) from prices))
 select e.ym, e.symbol, e.date as entry_date, l.close as last_close, exp(l.cumlog - e.cumlog) - 1 as ret, (select max(date) from prices) as as_of from eligible e {} join l on e.symbol = l.symbol"""


@query("c15_mark_to_latest", MARKS.format(""), "last_close ret")
def _(c):
    picks = c.m.eligible.select("ym", "symbol", F.col("date").alias("entry_date"))
    return rules.mark_to_latest(picks, c.m.prices)


@query("c15_mark_model_picks", MARKS.format("left"), "last_close ret")
def _(c):
    picks = c.m.eligible.select("ym", "symbol", F.col("date").alias("entry_date"))
    return rules.mark_to_latest(picks, c.m.prices, keep_unmarked=True)


@query("c16_precision_at_k", f"select cast(h as int) as H, ym, prec from ({SCORED_MONTHS}) q", "prec")
def _(c):
    return rule_months(c).select("H", "ym", "prec")


@query("c17_graph_edges", """with best as (select src, max_by(dst, (n, dst)) as dst from sector_edges group by 1) select distinct src, dst from (select src, dst from best union all select n_name, concat('NATION_', (n_nationkey + 5) % 30) from nation) q where dst in (select n_name from nation)""")
def _(c):
    return graph.downstream_edges(c.view("sector_graph").select("name", "downstream"))


@query("c17_degrees", """with best as (select src, max_by(dst, (n, dst)) as dst from sector_edges group by 1), e as (select distinct src, dst from (select src, dst from best union all select n_name, concat('NATION_', (n_nationkey + 5) % 30) from nation) q where dst in (select n_name from nation))
 select name, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from (select src as name, 1 as o, 0 as i from e union all select dst, 0, 1 from e) z group by 1""")
def _(c):
    return graph.degrees(graph.downstream_edges(c.view("sector_graph").select("name", "downstream")))


@query("c18_causal_chains", "select r_name as trigger, n_name as sector, case when n_nationkey % 2 = 1 then 'up' else 'down' end as direction from nation join region on n_regionkey = r_regionkey")
def _(c):
    known = c.table("nation").select(F.col("n_name").alias("name"))
    return graph.chain_effects(c.view("causal_chains"), known)


@query("c19_types_with_hit_rate", """select c.*, h.hit_rate from (select type, avg(pre) as pre, avg(event) as event, avg(post) as post, avg(drift) as drift, count(event) as n from study group by type) c
 left join (select type, avg((sign(event) = sign(expected_sign))::int) as hit_rate from study where event is not null and expected_sign <> 0 group by type) h on c.type = h.type""", "pre event post drift hit_rate")
def _(c):
    return eventstudy.types_with_hits(_study(c))


@query("c20_semi_join", "select * from sector_months where sector in (select name from sector_dim where is_operating)", "ret")
def _(c):
    return c.m.sector_months.join(c.m.operating, "sector", "left_semi")
