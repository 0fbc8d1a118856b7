"""Shared DuckDB relations, written independently of the Spark plans. An oracle names
the relations it reads; ``with_relations`` prepends them and what they depend on."""

from __future__ import annotations

import re

RELATIONS: dict[str, str] = {}


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql.strip()


def _mentions(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", sql))
    return [n for n in RELATIONS if n in words]


def with_relations(sql: str) -> str:
    order: list[str] = []

    def visit(text: str, stack: tuple[str, ...]) -> None:
        for n in _mentions(text):
            if n in order or n in stack:
                continue
            visit(RELATIONS[n], (*stack, n))
            order.append(n)

    visit(sql, ())
    ctes = ",\n".join(f"{n} as materialized ({RELATIONS[n]})" for n in order)
    return f"with recursive {ctes}\n{sql}" if order else sql


def minp(fn: str, x: str, n: int, m: int, w: str = "partition by symbol order by date") -> str:
    """A trailing frame of n rows with at least m non-null values."""
    f = f"over ({w} rows between {n - 1} preceding and current row)"
    call = fn.replace("?", x)
    return f"case when count({x}) {f} >= {m} then {call} {f} end"


MED = "quantile_cont(?, 0.5)"
W = "partition by symbol order by date"

relation("daily_panel", """
select cast(l_shipdate as date) as date, concat('S', lpad(cast(l_suppkey as varchar),6,'0')) as symbol,
  min(n_name) as sector, concat('S', lpad(cast(l_suppkey as varchar),6,'0')) as name,
  cast(sum(l_quantity) as bigint) as volume, avg(l_extendedprice/l_quantity) as ldcp,
  avg(l_extendedprice/l_quantity)*(1+avg(l_discount)-0.05) as close
from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey
group by cast(l_shipdate as date), l_suppkey""")

relation("sector_dim", """
select n_name as code, concat('Sector ', n_nationkey) as name, n_nationkey <> 23 as is_equity,
  n_nationkey not in (6, 15, 23) as is_operating from nation where n_nationkey <> 24""")

relation("contracts_raw", """
select distinct cast(l_shipdate as date) as date, concat('S', lpad(cast(l_suppkey as varchar),6,'0'), '-',
  substring('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', cast(3*month(l_shipdate)-2 as int), 3)) as symbol
from lineitem where l_returnflag='R' and l_linenumber=1""")

relation("rate_events", """
select date, rate, cast(round((rate-lag(rate) over(order by date))*100) as bigint) as change_bps from
 (select min(cast(o_orderdate as date)) as date, round(avg(o_totalprice)/10000,2) as rate from orders
  where o_orderpriority='1-URGENT' group by year(o_orderdate), quarter(o_orderdate)) q""")

relation("macro_rows", """
select last_day(cast(min(o_orderdate) as date)) as date, avg(o_totalprice)/10000 as cpi_yoy,
  sum(case when o_orderstatus='F' then o_totalprice end)/1e6 as fx_reserves_sbp_bn,
  avg(case when o_orderstatus='O' then o_totalprice end)/1000 as pkr_usd,
  avg(case when o_orderpriority='5-LOW' then o_totalprice end)/1000 as brent_usd, cast(count(*) as double)/100 as remittances_bn
from orders group by year(o_orderdate), month(o_orderdate)""")

relation("macro", """
select m.*, (select r.rate from rate_events r where r.date <= m.date order by r.date desc limit 1) as policy_rate from macro_rows m""")

relation("catalog_events", """
select date, type, title, sector, expected_sign from (
 select cast(o_orderdate as date) as date, o_orderpriority as type, concat('order ', o_orderkey) as title, concat('Sector ', n_nationkey) as sector,
   cast(case o_orderstatus when 'F' then 0.3 when 'O' then -0.3 else 0.0 end as double) as expected_sign,
   row_number() over(partition by year(o_orderdate), month(o_orderdate) order by o_totalprice desc, o_orderkey) as rn
 from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey) z where rn<=3""")

relation("news", """
select d.doc_id as item_id, d.text as headline, case when d.doc_id % 7 <> 0 then cast(1 + d.doc_id % 6 as int) end as tier,
  cast(l.quality - l.toxic as double) as sentiment, case when d.doc_id % 3 = 0 then [d.lang] else [] end as sectors
from documents d join labels l on d.doc_id = l.doc_id""")

relation("sector_edges", """
select sn.n_name as src, cn.n_name as dst, count(*) as n from lineitem join supplier on l_suppkey=s_suppkey
join nation sn on s_nationkey=sn.n_nationkey join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
join nation cn on c_nationkey=cn.n_nationkey group by sn.n_name, cn.n_name""")

relation("flows", """
select cast(ts as date) as date, sum(case when event_type='purchase' then value when event_type='error' then -value else 0 end) as fipi,
  sum(case when event_type='purchase' then -value when event_type='error' then value else 0 end) as lipi
from events group by cast(ts as date)""")

relation("feed", """
with v as (select *, cast(substring(symbol, 2, 6) as bigint) as k from daily_panel),
x as (
 select *, 'plain' as variant, 0 as o from v union all select *, 'repeat', 1 from v where k % 5 = 0
 union all select *, 'blank', 2 from v where k % 7 = 0 union all select *, 'zero', 3 from v where k % 11 = 0
 union all select *, 'short', 4 from v where k % 13 = 0),
y as (select *, concat(lpad(cast(day(date) as varchar),2,'0'), substring('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', cast(3*month(date)-2 as int),3), cast(year(date) as varchar)) as stamp,
  cast(floor(close*100+0.37) as bigint) as cents, cast(floor(ldcp*100+0.37) as bigint) as lcents from x)
select strftime(date, '%Y-%m') as file, cast(datediff('day', date '1990-01-01', date) as bigint)*10000000000 + k*10 + o as pos,
  case variant when 'short' then concat(stamp, '|', symbol)
  else concat(stamp, '| ', symbol, '|', sector, '|', symbol, '||||',
    case variant when 'repeat' then cast(cents+100 as varchar) when 'blank' then '' when 'zero' then '0' else cast(cents as varchar) end,
    '|', volume, '|', lcents) end as line
from y""")

relation("returns", """
select *, case when close/ldcp-1 > 4.0 then 4.0 when close/ldcp-1 < -0.9 then -0.9 else close/ldcp-1 end as r1, close*volume as value
from daily_panel where ldcp > 0""")

relation("history", f"""
select *, ln(1+r1) as logr, sum(ln(1+r1)) over ({W} rows unbounded preceding) as cumlog, {minp(MED, 'value', 20, 5)} as adv_20 from returns""")

relation("prices", """
select h.*, coalesce(s.name, concat('[', h.sector, ']')) as sector_name, coalesce(s.is_equity, false) as is_equity
from history h left join sector_dim s on h.sector = s.code""")

relation("full_market", "select date, avg(r1) as mkt_r from prices where adv_20 > 40000 group by date")
relation("market", "select * from full_market where date >= date '1995-03-01'")
relation("breadth", """select date, avg(case when r1 > 0 then 1.0 else 0.0 end) as breadth from prices
where adv_20 > 40000 and date >= date '1995-03-01' group by date""")
relation("sector_daily", """select date, sector_name as sector, avg(r1) as r from prices
where adv_20 > 40000 and is_equity and date >= date '1995-03-01' group by date, sector_name""")
relation("market_months", """select cast(date_trunc('month', date) as date) as ym, exp(sum(ln(1+mkt_r)))-1 as mkt_m from market group by 1""")
relation("sector_months", """
select g.ym, g.sector, exp(coalesce(s.v, 0))-1 as ret from
 (select distinct a.ym, b.sector from (select distinct cast(date_trunc('month', date) as date) as ym from sector_daily) a, (select distinct sector from sector_daily) b) g
 left join (select cast(date_trunc('month', date) as date) as ym, sector, sum(ln(1+r)) as v from sector_daily group by 1, 2) s on g.ym = s.ym and g.sector = s.sector""")

relation("levels", """
select date, mkt_r, sum(ln(1+mkt_r)) over (order by date rows unbounded preceding) as loglevel,
  exp(sum(ln(1+mkt_r)) over (order by date rows unbounded preceding)) as level from market""")


def _flag(n: int) -> str:
    f = f"over (order by date rows between {n - 1} preceding and current row)"
    return f"case when count(level) {f} >= {n} and level > avg(level) {f} then 1.0 else 0.0 end as ma_{n}"


relation("flags", f"""
select *, (ma_20+ma_50+ma_100+ma_200)/4 as exposure from (select *, {', '.join(_flag(n) for n in (20, 50, 100, 200))} from levels) f""")

relation("mood_raw", f"""
select f.date, exposure*100 as trend,
  round(level / ({minp('avg(?)', 'level', 125, 40, 'order by date')}) - 1, 9) as a,
  round({minp('avg(?)', 'breadth', 20, 8, 'order by date')}, 9) as b,
  round({minp('stddev_samp(?)', 'mkt_r', 20, 8, 'order by date')}, 9) as c,
  round(level / ({minp('max(?)', 'level', 252, 60, 'order by date')}) - 1, 9) as d
from (select flags.*, breadth.breadth from flags left join breadth on flags.date = breadth.date) f""")


relation("mood_lists", """
select *, list(a) over w as la, list(b) over w as lb, list(c) over w as lc, list(d) over w as ld, count(*) over w as n,
  count(a) over w as na, count(b) over w as nb, count(c) over w as nc, count(d) over w as nd
from mood_raw window w as (order by date rows between 251 preceding and current row)""")


def _share(x: str) -> str:
    return f"case when n{x} >= 90 then case when {x} is null then 0.0 else len(list_filter(l{x}, lambda v: v <= {x})) * 100.0 / n end end"


relation("mood_components", f"""
select date, {_share('a')} as momentum, trend, {_share('b')} as breadth, 100 - ({_share('c')}) as low_volatility, {_share('d')} as strength from mood_lists""")
relation("mood", """
select date, (coalesce(momentum,0)+coalesce(trend,0)+coalesce(breadth,0)+coalesce(low_volatility,0)+coalesce(strength,0))
 / ((momentum is not null)::int+(trend is not null)::int+(breadth is not null)::int+(low_volatility is not null)::int+(strength is not null)::int) as mood
from mood_components""")

relation("deltas", """
select cast(date_trunc('month', date) as date) as ym, policy_rate - lag(policy_rate) over w as d_policy_rate, cpi_yoy - lag(cpi_yoy) over w as d_cpi_yoy,
  fx / lag(fx) over w - 1 as pkr_depr, oil / lag(oil) over w - 1 as oil_ret, res / lag(res) over w - 1 as reserves_chg, rem / lag(rem) over w - 1 as remit_chg
from (select date, policy_rate, cpi_yoy, last_value(pkr_usd ignore nulls) over v as fx, last_value(brent_usd ignore nulls) over v as oil,
   last_value(fx_reserves_sbp_bn ignore nulls) over v as res, last_value(remittances_bn ignore nulls) over v as rem
   from macro window v as (order by date rows unbounded preceding)) p
window w as (order by date)
qualify row_number() over w > 1""")
relation("deltas_long", "unpivot deltas on d_policy_rate, d_cpi_yoy, pkr_depr, oil_ret, reserves_chg, remit_chg into name factor value x")

relation("days", "select date, row_number() over (order by date) - 1 as idx from market")
relation("abnormal", "select s.date, sector, r - mkt_r as abn from sector_daily s join market m on s.date = m.date")
relation("anchored", """
select e.*, (select min(d.idx) from days d where d.date >= e.date) as idx from catalog_events e""")
relation("study", """
select date, type, title, sector, expected_sign, max(car) filter (window_name = 'pre') as pre, max(car) filter (window_name = 'event') as event,
  max(car) filter (window_name = 'post') as post, max(car) filter (window_name = 'drift') as drift
from (
 select a.*, w.window_name, case when a.idx + w.lo >= 0 and a.idx + w.hi <= (select max(idx) from days) and a.sector in (select sector from abnormal)
   then coalesce((select sum(b.abn) from abnormal b join days d on b.date = d.date where b.sector = a.sector and d.idx between a.idx + w.lo and a.idx + w.hi), 0) end as car
 from anchored a, (values ('pre',-5,-1),('event',0,1),('post',1,5),('drift',1,20)) w(window_name, lo, hi)) z
group by all""")

relation("variants", """
with p as (select *, coalesce(lag(ma_50) over w, 0) as p50, coalesce(lag(ma_100) over w, 0) as p100, coalesce(lag(ma_200) over w, 0) as p200, coalesce(lag(exposure) over w, 0) as pe
  from flags window w as (order by date)),
c as (select pow(1.12, 1.0/248) - 1 as cash)
select date, 'buy_hold' as strategy, mkt_r as ret from p
union all select date, 'trend_ma50', p50*mkt_r+(1-p50)*cash-coalesce(abs(p50-lag(p50) over (order by date)),0)*0.003 from p, c
union all select date, 'trend_ma100', p100*mkt_r+(1-p100)*cash-coalesce(abs(p100-lag(p100) over (order by date)),0)*0.003 from p, c
union all select date, 'trend_ma200', p200*mkt_r+(1-p200)*cash-coalesce(abs(p200-lag(p200) over (order by date)),0)*0.003 from p, c
union all select date, 'trend_ensemble', pe*mkt_r+(1-pe)*cash-coalesce(abs(pe-lag(pe) over (order by date)),0)*0.003 from p, c""")

relation("policy_days", """
select m.date, coalesce((select r.rate from rate_events r where r.date <= m.date order by r.date desc limit 1), (select r.rate from rate_events r order by r.date limit 1)) as rate from market m""")
relation("hierarchy", """
with p as (select f.*, pow(1 + rate/100, 1.0/248) - 1 as fin, coalesce(lag(exposure) over (order by f.date), 0) as p1 from flags f join policy_days d on f.date = d.date),
q as (select *, 1.5*p1 as pl, coalesce(abs(p1 - lag(p1) over (order by date)), 0) as s1 from p),
z as (select *, coalesce(abs(pl - lag(pl) over (order by date)), 0) as sl from q)
select date, 'buy_hold' as strategy, mkt_r as ret from z
union all select date, 'timed_1x', p1*mkt_r + (1-p1)*fin - s1*0.003 from z
union all select date, 'timed_1.5x', pl*mkt_r + greatest(1-pl,0)*fin - greatest(pl-1,0)*fin - sl*0.003 from z""")

relation("full_context", """
select date, mkt_r as fm, exp(c - lag(c, 63) over (order by date)) - 1 as mkt_mom_3m, exp(c - lag(c, 20) over (order by date)) - 1 as mkt_ret_20
from (select *, sum(ln(1+mkt_r)) over (order by date rows unbounded preceding) as c from full_market) q""")

_RET = "exp(cumlog - lag(cumlog, {}) over (" + W + ")) - 1"

relation("features_raw", f"""
select p.*, c.fm, c.mkt_mom_3m, c.mkt_ret_20, cast(date_trunc('month', p.date) as date) as ym,
  case when value <> 0 then abs(r1) / value end as il, case when r1 > 0 then 1.0 else 0.0 end as up, r1 * fm as rm, fm * fm as mm
from prices p left join full_context c on p.date = c.date""")

relation("features_daily", f"""
select *, {_RET.format(21)} as mom_1m, {_RET.format(63)} as mom_3m, {_RET.format(126)} as mom_6m, {_RET.format(252)} as mom_12m, {_RET.format(5)} as rev_1w,
  {_RET.format(20)} as ret_20, {_RET.format(60)} as ret_60, {_RET.format(120)} as ret_120,
  {minp('stddev_samp(?)', 'r1', 20, 10)} as vol_1m, {minp('stddev_samp(?)', 'r1', 63, 30)} as vol_3m,
  exp(cumlog - {minp('max(?)', 'cumlog', 252, 60)}) - 1 as dist_252h, exp(cumlog - {minp('max(?)', 'cumlog', 20, 10)}) - 1 as dist_20h,
  exp(cumlog - {minp('min(?)', 'cumlog', 126, 40)}) - 1 as dist_6mlow, exp(cumlog - {minp('max(?)', 'cumlog', 126, 40)}) - 1 as dd_6m,
  {minp('max(?)', 'r1', 20, 10)} as maxup_1m, {minp('avg(?)', 'up', 20, 10)} as upday_frac, {minp('avg(?)', 'il', 20, 10)} as amihud,
  {minp(MED, 'value', 120, 40)} as adv_120, {minp(MED, 'value', 60, 20)} as adv_60,
  {minp('avg(?)', 'r1', 60, 30)} as er, {minp('avg(?)', 'fm', 60, 30)} as em, {minp('avg(?)', 'rm', 60, 30)} as erm, {minp('avg(?)', 'mm', 60, 30)} as emm,
  case when count(cumlog) over ({W} rows between 1 following and 60 following) = 60 then exp(max(cumlog) over ({W} rows between 1 following and 60 following) - cumlog) - 1 end as peak_60
from features_raw""")

relation("sector_medians", """
select date, sector, quantile_cont(mom_3m, 0.5) as m3, quantile_cont(ret_60, 0.5) as m60 from features_daily group by date, sector""")

relation("month_ends", """
select f.* from features_daily f join (select symbol, ym, max(date) as d from features_daily group by symbol, ym) x on f.symbol = x.symbol and f.date = x.d""")
relation("month_numbers", "select ym, row_number() over (order by ym) as m_rank from (select distinct ym from month_ends) q")
relation("labels_fwd", """
with g as (select symbol, cumlog, m_rank from month_ends e join month_numbers n on e.ym = n.ym)
select a.symbol, a.m_rank, exp(b.cumlog - a.cumlog) - 1 as fwd_1, exp(c.cumlog - a.cumlog) - 1 as fwd_2, exp(d.cumlog - a.cumlog) - 1 as fwd_3
from g a left join g b on a.symbol = b.symbol and b.m_rank = a.m_rank + 1
 left join g c on a.symbol = c.symbol and c.m_rank = a.m_rank + 2 left join g d on a.symbol = d.symbol and d.m_rank = a.m_rank + 3""")
relation("macro_context", """
select cast(date_trunc('month', date) as date) as ym, policy_rate as rate_level, policy_rate - lag(policy_rate, 3) over w as rate_chg_3m, cpi_yoy,
  fx / lag(fx, 3) over w - 1 as pkr_chg_3m, oil / lag(oil, 3) over w - 1 as oil_chg_3m
from (select *, last_value(pkr_usd ignore nulls) over v as fx, last_value(brent_usd ignore nulls) over v as oil from macro window v as (order by date rows unbounded preceding)) q
window w as (order by date)""")
relation("contract_bases", """
select date, split_part(symbol, '-', 1) as base from contracts_raw
where contains(symbol, '-') and upper(split_part(symbol, '-', -1)) in ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC')
 and split_part(symbol, '-', 1) not in ('KSE30','KMI30','BKTI','KSE100','ALLSHR','KMIALLSHR') and not contains(split_part(symbol, '-', 1), 'ETF')""")
relation("eligible_grid", """
select distinct base as symbol, cast(date_trunc('month', date) + to_months(k) as date) as ym from contract_bases, (values (0),(1),(2)) v(k)""")
relation("sector_numbers", "select sector_name, cast(row_number() over (order by sector_name) - 1 as double) as sector_code from (select distinct sector_name from prices) q")
relation("mood_months", "select cast(date_trunc('month', date) as date) as ym, max_by(mood, date) as mood_level from mood group by 1")

relation("panel", """
select e.ym, e.symbol, e.date, e.sector, e.sector_name, e.close, e.cumlog, e.adv_20, e.is_equity, l.fwd_1, l.fwd_2, l.fwd_3,
  mom_1m, mom_3m, mom_6m, mom_12m, rev_1w, vol_1m, vol_3m, dist_252h, dist_20h, dist_6mlow, ln(1+adv_20) as log_adv, ln(1+adv_20)-ln(1+adv_120) as adv_growth,
  case when adv_20 <> 0 then value/adv_20 end as turnover, mom_3m - mkt_mom_3m as rel_str_3m, mom_3m - s.m3 as rel_sec_3m, maxup_1m, upday_frac,
  ln(case when close < 0.1 then 0.1 else close end) as log_price, cast(month(e.date) as int) as month, mom_1m - mom_3m/3.0 as mom_accel,
  case when vol_3m <> 0 then vol_1m/vol_3m end as vol_ratio, amihud, case when emm - em*em <> 0 then (erm - er*em)/(emm - em*em) end as beta_60, dd_6m,
  c.sector_code, rate_level, rate_chg_3m, cpi_yoy, pkr_chg_3m, oil_chg_3m, mood_level, g.symbol is not null as fut_elig,
  coalesce(g.symbol is not null and adv_20 > 40000 and close >= 3 and is_equity, false) as eligible
from month_ends e join month_numbers n on e.ym = n.ym join labels_fwd l on l.symbol = e.symbol and l.m_rank = n.m_rank
 join sector_medians s on s.date = e.date and s.sector = e.sector join sector_numbers c on c.sector_name = e.sector_name
 left join macro_context m on m.ym = e.ym left join mood_months o on o.ym = e.ym left join eligible_grid g on g.symbol = e.symbol and g.ym = e.ym""")
relation("eligible", "select * from panel where eligible")

relation("surge_rows", """
select f.symbol, f.sector_name, f.date, f.ym, ret_20, ret_60, ret_120, vol_1m as vol_20, dist_252h, dist_20h, ln(1+adv_20)-ln(1+adv_60) as adv_growth,
  ln(1+adv_20) as log_adv, ln(case when close < 0.1 then 0.1 else close end) as log_price, mkt_ret_20, ret_60 - s.m60 as rel_ret_60,
  case when peak_60 is not null then case when peak_60 >= 0.25 then 1.0 else 0.0 end end as surge
from features_daily f join (select symbol, ym, max(date) as d from features_daily where adv_20 > 40000 group by symbol, ym) x on f.symbol = x.symbol and f.date = x.d
 join sector_medians s on s.date = f.date and s.sector = f.sector""")
relation("surge_panel", """
select * from surge_rows where ret_20 is not null and ret_60 is not null and ret_120 is not null and vol_20 is not null and dist_252h is not null
 and dist_20h is not null and adv_growth is not null and log_price is not null and mkt_ret_20 is not null and rel_ret_60 is not null and surge is not null""")

relation("sector_panel", """
with k as (select s.* from sector_months s where sector in (select name from sector_dim where is_operating)),
c as (select *, sum(ln(1+ret)) over (partition by sector order by ym rows unbounded preceding) as c from k),
mk as (select ym, exp(q - lag(q, 3) over (order by ym)) - 1 as mkt3 from (select ym, sum(ln(1+mkt_m)) over (order by ym rows unbounded preceding) as q from market_months) z),
x as (select a.ym, policy_rate, cpi_yoy, last_value(pkr_usd ignore nulls) over v as fx, last_value(brent_usd ignore nulls) over v as oil
  from (select distinct ym from k) a left join macro m on cast(date_trunc('month', m.date) as date) = a.ym window v as (order by a.ym rows unbounded preceding)),
y as (select ym, policy_rate as rate_level, policy_rate - lag(policy_rate, 3) over w as rate_chg_3, cpi_yoy, fx/lag(fx, 3) over w - 1 as pkr_chg_3,
  oil/lag(oil, 3) over w - 1 as oil_chg_3 from x window w as (order by ym)),
n as (select sector, cast(row_number() over (order by sector) - 1 as double) as sector_code from (select distinct sector from k) q)
select c.ym, c.sector, exp(c - lag(c, 1) over w) - 1 as mom_1, exp(c - lag(c, 3) over w) - 1 as mom_3, exp(c - lag(c, 6) over w) - 1 as mom_6, exp(c - lag(c, 12) over w) - 1 as mom_12,
  ret as rev_1, case when count(ret) over (w rows between 2 preceding and current row) >= 2 then stddev_samp(ret) over (w rows between 2 preceding and current row) end as vol_3,
  exp(c - lag(c, 3) over w) - 1 - mkt3 as rel_str_3, rate_level, rate_chg_3, cpi_yoy, pkr_chg_3, oil_chg_3, sector_code,
  exp(lead(c, 1) over w - c) - 1 as fwd_1, exp(lead(c, 2) over w - c) - 1 as fwd_2, exp(lead(c, 3) over w - c) - 1 as fwd_3
from c left join mk on c.ym = mk.ym left join y on c.ym = y.ym join n on c.sector = n.sector
window w as (partition by c.sector order by c.ym)""")

relation("eligible_long", "select *, H as h from (unpivot (select ym, symbol, date, close, cumlog, mom_3m, dist_252h, adv_growth, sector_name, fwd_1, fwd_2, fwd_3 from eligible) on fwd_1, fwd_2, fwd_3 into name k value fwd) q, (values ('fwd_1', 1), ('fwd_2', 2), ('fwd_3', 3)) v(kk, H) where k = kk")

relation("feed_fields", "select file, pos, string_split(line, '|') as f from feed where len(string_split(line, '|')) >= 10")
relation("feed_typed", """
select file, pos, cast(strptime(trim(f[1]), '%d%b%Y') as date) as date, trim(f[2]) as symbol, trim(f[3]) as sector, trim(f[4]) as name, try_cast(trim(f[8]) as double) as close,
  coalesce(cast(try_cast(trim(f[9]) as double) as bigint), 0) as volume, try_cast(trim(f[10]) as double) as ldcp from feed_fields where try_cast(trim(f[8]) as double) > 0""")
relation("feed_panel", "select date, symbol, sector, name, close, volume, ldcp from feed_typed qualify row_number() over (partition by date, symbol order by file desc, pos desc) = 1")

relation("gated_periods", """
with l as (select ym, symbol, date, mom_3m, dist_252h, coalesce(adv_growth, 0) as ag, h, case h when 1 then fwd_1 when 2 then fwd_2 else fwd_3 end as fwd from eligible, (values (1),(2),(3)) v(h)),
d as (select * from l where fwd is not null),
k as (select h, ym from (select h, ym, row_number() over (partition by h order by ym) - 1 as i from (select distinct h, ym from d) q) z where i % h = 0),
s as (select d.*, (mom_3m-avg(mom_3m) over w)/(stddev_samp(mom_3m) over w + 1e-9) + (-dist_252h-avg(-dist_252h) over w)/(stddev_samp(-dist_252h) over w + 1e-9) + (ag-avg(ag) over w)/(stddev_samp(ag) over w + 1e-9) as score,
  count(*) over w as n, max(d.date) over w as edate from d join k on d.h = k.h and d.ym = k.ym window w as (partition by d.h, d.ym)),
t as (select h, ym, edate, avg(fwd) as gross from (select *, row_number() over (partition by h, ym order by score desc nulls last, symbol) as rn from s where n >= 15) q where rn <= 5 group by 1, 2, 3),
r as (select t.*, case when m.date is null then 11.0 else m.policy_rate end / 100 * h / 12 as carry, coalesce((select exposure from flags f where f.date <= t.edate order by f.date desc limit 1) >= 0.5, false) as risk_on
  from t left join macro m on cast(date_trunc('month', m.date) as date) = t.ym)
select cast(h as int) as H, ym, edate as date, gross, carry, risk_on, case when risk_on then gross - 0.005 - carry else carry end as ret from r""")
