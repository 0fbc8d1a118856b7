"""Source and sink queries (A): archives, feeds, context files, bundles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import MIN_ADV, START, query
from panelkit.functions.scalar import month_start
from panelkit.operators import baskets, gaps
from panelkit.plans import report
from panelkit.session import shared_dir
from panelkit.sources import context as ctx
from panelkit.sources import archives as arc
from panelkit.sources import feeds, sinks
from panelkit.streaming.ingest import ingest_new, staged_panel
from panelkit.streaming.upsert import panel_rows, upsert_new

COLS = ["date", "symbol", "sector", "name", "close", "volume", "ldcp"]


def write_archives(lines: DataFrame, folder: str) -> None:
    """Feed lines as gzip archives in (file, pos) order; a long file takes several parts."""
    ordered = lines.repartitionByRange("file", "pos").sortWithinPartitions("file", "pos").select("line", "file")
    ordered.write.mode("append").partitionBy("file").option("compression", "gzip").text(folder)


@query("a1_read_archives", "select * from feed_panel", "close ldcp")
def _(c):
    folder = shared_dir(c.spark, "archives")
    write_archives(c.view("feed_lines"), folder)
    return feeds.parse_feed(feeds.read_archives(c.spark, folder)).select(*COLS)


@query("a1_archive_source", "select * from feed_panel", "close ldcp")
def _(c):
    folder = shared_dir(c.spark, "archives")
    write_archives(c.view("feed_lines"), folder)
    return feeds.parse_feed(arc.read_lines(c.spark, folder)).select(*COLS)


@query("a2_split_feed_lines", "select file, pos, f[1] as date, f[2] as symbol, f[3] as sector, f[8] as close, f[9] as volume, f[10] as ldcp from feed_fields")
def _(c):
    return feeds.split_feed_lines(c.view("feed_lines")).select("file", "pos", "date", "symbol", "sector", "close", "volume", "ldcp")


@query("a3_type_feed", "select * from feed_typed", "close ldcp")
def _(c):
    return feeds.type_feed(feeds.split_feed_lines(c.view("feed_lines"))).select("file", "pos", *COLS)


@query("a4_dedup_keep_last", "select * from feed_panel", "close ldcp")
def _(c):
    return feeds.parse_feed(c.view("feed_lines")).select(*COLS)


@query("a5_write_panel", "select * from feed_panel", "close ldcp")
def _(c):
    path = shared_dir(c.spark, "panel-file")
    sinks.write_panel(feeds.parse_feed(c.view("feed_lines")), path)
    return c.spark.read.parquet(path).select(*COLS)


@query("a6_missing_trading_days", """with x as (select symbol, min(date) over () as a, max(date) over () as b from prices)
 select cast(d as date) as date from (select unnest(generate_series((select min(date) from prices), (select max(date) from prices), interval 1 day)) as d) q
 where isodow(d) < 6 and cast(d as date) not in (select date from prices where symbol = (select min(symbol) from prices)) and cast(d as date) not in (select date from rate_events)""")
def _(c):
    p = c.m.prices
    held = p.filter(F.col("symbol") == p.select(F.min("symbol")).scalar()).select("date").distinct()
    return feeds.missing_trading_days(p.select(F.min("date")).scalar(), p.select(F.max("date")).scalar(), held, c.m.rates)


@query("a6_missing_ranges", """with cal as (select d as date, row_number() over (order by d) as n from (select cast(unnest(generate_series((select min(date) from prices), (select max(date) from prices), interval 1 day)) as date) as d) q where isodow(d) < 6 and d not in (select date from rate_events)),
 h as (select distinct symbol, n from prices join cal using (date)),
 e as (select symbol, n from h union all select distinct symbol, 0 from h union all select distinct symbol, (select max(n) from cal) + 1 from h),
 g as (select symbol, n + 1 as a, lead(n) over (partition by symbol order by n) - 1 as b from e)
 select g.symbol, x.date as first_missing, y.date as last_missing, cast(b - a + 1 as int) as n_days from g join cal x on x.n = a join cal y on y.n = b where a <= b""")
def _(c):
    # the rate decisions' dates stand for holidays, as a file of a list
    path = shared_dir(c.spark, "holidays")
    dates = c.m.rates.select(F.concat(F.lit('  "'), F.col("date").cast("string"), F.lit('",')).alias("value"))
    dates.write.mode("overwrite").text(path)
    p = c.m.prices
    calendar = gaps.trading_calendar(c.spark, p.select(F.min("date")).scalar(), p.select(F.max("date")).scalar(), ctx.read_holidays(c.spark, path))
    return gaps.missing_ranges(p, calendar)


@query("a7_month_upsert", "select * from feed_panel", "close ldcp")
def _(c):
    # three arrivals, the middle years last; each merges the months it touches
    base = shared_dir(c.spark, "upsert")
    archives, panel, checkpoint = (os.path.join(base, x) for x in ("archives", "panel", "checkpoint"))
    lines = c.view("feed_lines")
    for arrival in ("file >= '1998-01'", "file < '1996-01'", "file >= '1996-01' and file < '1998-01'"):
        write_archives(lines.filter(arrival), archives)
        upsert_new(c.spark, archives, panel, checkpoint)
    return panel_rows(c.spark, panel).select(*COLS)


@query("a7_incremental_ingest", "select * from feed_panel", "close ldcp")
def _(c):
    # two arrivals and a run after each: the second run takes the new archives only
    base = shared_dir(c.spark, "ingest")
    archives, staged, checkpoint = (os.path.join(base, x) for x in ("archives", "staged", "checkpoint"))
    lines = c.view("feed_lines")
    for arrival in (lines.filter("file < '1998-01'"), lines.filter("file >= '1998-01'")):
        write_archives(arrival, archives)
        ingest_new(c.spark, archives, staged, checkpoint)
    return staged_panel(c.spark, staged).select(*COLS)


@query("a8_parquet_scan", "select * from orders", "o_totalprice")
def _(c):
    return c.table("orders")


@query("a9_projected_scan", "select cast(l_shipdate as date) as date, l_suppkey, l_quantity from lineitem", "l_quantity")
def _(c):
    return c.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_suppkey", "l_quantity")


def _csv(c, df: DataFrame, name: str) -> str:
    path = shared_dir(c.spark, name)
    sinks.write_csv(df, path)
    return path


MACRO_COLS = ["date", "policy_rate", "cpi_yoy", "fx_reserves_sbp_bn", "remittances_bn", "pkr_usd", "brent_usd"]


@query("a10_read_macro", "select date, policy_rate, cpi_yoy, fx_reserves_sbp_bn, remittances_bn, pkr_usd, brent_usd from macro", " ".join(MACRO_COLS[1:]))
def _(c):
    filled = c.m.macro.withColumn("current_account_mn", F.lit(None).cast("double"))
    path = _csv(c, filled.select(*MACRO_COLS[:5], "current_account_mn", *MACRO_COLS[5:]), "macro-csv")
    return ctx.read_macro_monthly(c.spark, path).select(*MACRO_COLS)


@query("a11_read_rate_events", "select date, rate, cast(change_bps as int) as change_bps, 'orders' as source from rate_events", "rate")
def _(c):
    path = _csv(c, c.m.rates.withColumn("source", F.lit("orders")), "rates-csv")
    return ctx.read_rate_events(c.spark, path).select("date", "rate", "change_bps", "source")


def _documents(c, rows: DataFrame, name: str) -> str:
    """One JSON document per line, each holding the items of one month."""
    path = shared_dir(c.spark, name)
    sinks.write_json(rows, path)
    return path


@query("a12_read_events", "select date, type, title, sector, expected_sign from catalog_events", "expected_sign")
def _(c):
    item = F.struct("date", "type", "title", F.array("sector").alias("sectors"), "expected_sign", F.lit("orders").alias("source"), F.lit("high").alias("confidence"))
    docs = c.view("catalog_events").groupBy(month_start("date").alias("ym")).agg(F.collect_list(item).alias("events")).select("events")
    return ctx.event_sectors(ctx.read_events(c.spark, _documents(c, docs, "events-json"), lines=True))


@query("a13_read_flows", "select * from flows", "fipi lipi")
def _(c):
    item = F.struct(F.col("date"), F.col("fipi"), F.col("lipi"))
    docs = c.view("flows").groupBy(month_start("date").alias("ym")).agg(F.array_sort(F.collect_list(item)).alias("d"))
    docs = docs.select(F.struct(F.col("d.date").alias("days"), F.col("d.fipi").alias("fipi"), F.col("d.lipi").alias("lipi")).alias("daily"))
    return ctx.flow_days(ctx.read_json(c.spark, _documents(c, docs, "flows-json"), ctx.FLOWS_SCHEMA, lines=True))


@query("a13_client_week", "select event_type as client, cast(round(sum(value) * 100) as bigint) as net from events group by 1")
def _(c):
    entry = F.struct(F.col("client"), F.round(F.col("net") * 100).cast("long").alias("net"))
    docs = c.view("client_flows").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    docs = docs.select(F.struct(F.lit("all").alias("window"), F.col("m").alias("net_usd")).alias("client_week"))
    return ctx.client_week(ctx.read_json(c.spark, _documents(c, docs, "clients-json"), ctx.FLOWS_SCHEMA, lines=True))


@query("a14_read_news", "select item_id, headline, tier, sentiment, len(sectors) as n_sectors from (select n.*, cast(item_id as varchar) as k from news n) q", "sentiment")
def _(c):
    item = F.struct("headline", F.col("item_id").cast("string").alias("source"), "tier", "sentiment", "sectors")
    docs = c.view("news").select(F.array(item).alias("items"))
    back = ctx.read_news(c.spark, _documents(c, docs, "news-json"), lines=True)
    return back.select(F.col("source").cast("long").alias("item_id"), "headline", "tier", "sentiment", F.size("sectors").cast("long").alias("n_sectors"))


@query("a15_read_graph", """select concat('Sector ', n_nationkey) as name, k as factor, cast(case k when 'policy_rate' then n_nationkey % 3 - 1 when 'pkr_depreciation' then n_nationkey % 5 - 2 when 'oil' then n_nationkey % 2 else 1 end as double) as prior
 from nation, (values ('policy_rate'),('pkr_depreciation'),('oil'),('other')) f(k)""", "prior")
def _(c):
    node = F.struct(F.col("sector").alias("name"), "downstream", F.col("sensitivity").alias("macro_sensitivity"))
    docs = c.view("sector_graph").select(F.array(node).alias("sectors"))
    graph = ctx.read_json(c.spark, _documents(c, docs, "graph-json"), ctx.GRAPH_SCHEMA, lines=True)
    return ctx.graph_sectors(graph).select("name", F.explode("macro_sensitivity").alias("factor", "prior"))


def fundamentals(c) -> DataFrame:
    """Company documents from customers and the yearly sums of their orders."""
    yearly = c.table("orders").groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("period")).agg(F.sum("o_totalprice").alias("eps"))
    histories = yearly.groupBy("o_custkey").agg(F.collect_list(F.struct("period", "eps")).alias("eps_history"))
    named = histories.join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    doc = F.struct(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("n_name").alias("sector"), "eps_history")
    docs = named.select(F.array(doc).alias("companies"))
    return ctx.read_json(c.spark, _documents(c, docs, "fundamentals-json"), ctx.FUNDAMENTALS_SCHEMA, lines=True)


@query("a15_eps_history", "select concat('C', c_custkey) as ticker, n_name as sector, cast(year(o_orderdate) as varchar) as period, sum(o_totalprice) as eps from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3", "eps")
def _(c):
    return ctx.eps_history(fundamentals(c))


def sovereign(c) -> DataFrame:
    """Sovereign documents from customers and orders, one per region."""
    nation, region = c.table("nation"), c.table("region")
    named = c.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = c.table("orders").join(named, F.col("o_custkey") == F.col("c_custkey")).withColumn("day", F.col("o_orderdate").cast("date"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    ratings = urgent.groupBy("r_name", F.col("day").alias("date"), F.col("n_name").alias("agency")).agg(F.max("o_orderstatus").alias("rating"), F.max("o_orderpriority").alias("outlook"))
    debt = orders.groupBy("r_name", F.year("day").alias("year")).agg((F.sum("o_totalprice") / 1e9).alias("total_usd_bn"), F.avg("c_acctbal").alias("pct_of_gdp"))
    programs = urgent.groupBy("r_name", "day").agg((F.sum("o_totalprice") / 1e6).alias("amount_usd_bn")).select("r_name", F.col("day").alias("date"), F.lit("urgent").alias("program"), F.lit("approval").alias("event"), "amount_usd_bn")
    annual = orders.groupBy("r_name", F.concat(F.lit("FY"), F.year("day").cast("string")).alias("fy")).agg(F.avg("o_totalprice").alias("gdp_growth_pct"))
    lists = {"ratings": ratings, "external_debt": debt, "imf_programs": programs, "macro_annual": annual}
    docs = None
    for name, rows in lists.items():
        one = rows.groupBy("r_name").agg(F.collect_list(F.struct(*[x for x in rows.columns if x != "r_name"])).alias(name))
        docs = one if docs is None else docs.join(one, "r_name", "full")
    path = _documents(c, docs.drop("r_name"), "sovereign-json")
    return ctx.read_json(c.spark, path, ctx.SOVEREIGN_SCHEMA, lines=True)


def _sovereign(c) -> dict[str, DataFrame]:
    return ctx.sovereign_tables(sovereign(c))


SOVEREIGN = """select o.*, cast(o_orderdate as date) as day, c_acctbal, n_name, r_name from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""


@query("a15_rating_spells", f"select agency, rating, outlook, since, lead(since) over (partition by agency order by since) as until from (select n_name as agency, day as since, max(o_orderstatus) as rating, '1-URGENT' as outlook from ({SOVEREIGN}) q where o_orderpriority = '1-URGENT' group by 1, 2) r")
def _(c):
    return ctx.rating_spells(_sovereign(c)["ratings"])


@query("a15_external_debt", f"select cast(year(day) as int) as year, sum(o_totalprice) / 1e9 as total_usd_bn, avg(c_acctbal) as pct_of_gdp, cast(null as varchar) as source from ({SOVEREIGN}) q group by r_name, 1", "total_usd_bn pct_of_gdp")
def _(c):
    return _sovereign(c)["external_debt"]


@query("a15_imf_programs", f"select day as date, 'urgent' as program, 'approval' as event, sum(o_totalprice) / 1e6 as amount_usd_bn, cast(null as varchar) as source from ({SOVEREIGN}) q where o_orderpriority = '1-URGENT' group by r_name, day", "amount_usd_bn")
def _(c):
    return _sovereign(c)["imf_programs"]


@query("a15_macro_annual", f"select concat('FY', year(day)) as fy, avg(o_totalprice) as gdp_growth_pct, cast(null as double) as fiscal_deficit_pct_gdp, cast(null as double) as debt_to_gdp_pct, cast(null as varchar) as source from ({SOVEREIGN}) q group by r_name, 1", "gdp_growth_pct")
def _(c):
    return _sovereign(c)["macro_annual"]


def data_sources(c) -> DataFrame:
    """Documents that list pages as sources."""
    one = F.struct(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), "url", F.lit("page").alias("category"))
    docs = c.table("pages").groupBy((F.col("page_id") % 7).alias("k")).agg(F.collect_list(one).alias("sources")).select("sources")
    return ctx.read_json(c.spark, _documents(c, docs, "sources-json"), ctx.SOURCES_SCHEMA, lines=True)


@query("a15_data_sources", "select concat('p', page_id) as name, url, 'page' as category, cast(null as varchar) as notes from pages")
def _(c):
    return ctx.data_sources(data_sources(c))


@query("a15_causal_chains", """select concat('rate ', case when change_bps < 0 then 'cut' else 'rise' end) as trigger, count(*) as n_affected, sum(sign) as total_sign from (select change_bps from rate_events where change_bps is not null) r,
 (select concat('Sector ', n_nationkey) as sector, cast(n_nationkey % 3 - 1 as double) as sign from nation) s group by 1""", "total_sign")
def _(c):
    affected = c.view("sector_graph").agg(F.collect_list(F.struct("sector", F.col("sensitivity")["policy_rate"].cast("double").alias("sign"))).alias("affected"))
    kind = F.when(F.col("change_bps") < 0, "rate cut").otherwise("rate rise")
    chains = c.m.rates.filter("change_bps is not null").select(kind.alias("trigger")).join(F.broadcast(affected))
    docs = chains.select(F.array(F.struct("trigger", F.lit("carry").alias("mechanism"), "affected")).alias("causal_chains"))
    graph = ctx.read_json(c.spark, _documents(c, docs, "chains-json"), ctx.GRAPH_SCHEMA, lines=True)
    rows = ctx.graph_chains(graph).select("trigger", F.inline("affected"))
    return rows.groupBy("trigger").agg(F.count("sector").alias("n_affected"), F.sum("sign").alias("total_sign"))


@query("a16_csv_sink", "select date, mkt_r from market", "mkt_r")
def _(c):
    path = _csv(c, baskets.market_index(c.m.prices, MIN_ADV, START), "market-csv")
    return c.spark.read.schema("date date, mkt_r double").option("header", "true").csv(path)


@query("a17_bundle_sink", "select 'market' as section, count(*) as rows from market union all select 'sector_months', count(*) from sector_months")
def _(c):
    path = shared_dir(c.spark, "bundle")
    sinks.write_bundle({"market": c.m.market, "sector_months": c.m.sector_months}, path, "json")
    counts = [c.spark.read.json(os.path.join(path, s)).select(F.lit(s).alias("section")) for s in ("market", "sector_months")]
    return counts[0].unionByName(counts[1]).groupBy("section").agg(F.count("section").alias("rows"))


@query("a17_bundle_counts", """select 'market' as section, 'date' as column, count(date) as filled from market union all select 'market', 'mkt_r', count(mkt_r) from market
 union all select 'sector_months', 'ym', count(ym) from sector_months union all select 'sector_months', 'sector', count(sector) from sector_months union all select 'sector_months', 'ret', count(ret) from sector_months
 union all select 'macro', 'date', count(date) from macro union all select 'macro', 'pkr_usd', count(pkr_usd) from macro union all select 'macro', 'brent_usd', count(brent_usd) from macro""")
def _(c):
    tables = {"market": c.m.market, "sector_months": c.m.sector_months.select("ym", "sector", "ret"), "macro": c.m.macro.select("date", "pkr_usd", "brent_usd")}
    return report.column_index(c.spark, sinks.write_bundle(tables, shared_dir(c.spark, "bundle"), "json"))


@query("a18_macro_provenance", """with b as (select date, policy_rate, cpi_yoy, fx_reserves_sbp_bn, remittances_bn, cast(null as double) as current_account_mn, pkr_usd, brent_usd from macro),
 n as (select count(*) as rows, min(date) as first, max(date) as last, [count(date), count(policy_rate), count(cpi_yoy), count(fx_reserves_sbp_bn), count(remittances_bn), count(current_account_mn), count(pkr_usd), count(brent_usd)] as k from b)
 select unnest(['date', 'policy_rate', 'cpi_yoy', 'fx_reserves_sbp_bn', 'remittances_bn', 'current_account_mn', 'pkr_usd', 'brent_usd']) as column, unnest([null, 'rate decisions', 'orders', 'orders', 'orders', null, 'orders', 'orders']) as source, rows, unnest(k) as filled, first, last from n""")
def _(c):
    months = c.view("macro_months").withColumn("month", F.date_format("date", "yyyy-MM")).drop("date")
    baked = ctx.bake_macro(months, c.m.rates.withColumn("seq", F.lit(0)))
    sources = {"policy_rate": "rate decisions"} | {x: "orders" for x in ("cpi_yoy", "fx_reserves_sbp_bn", "remittances_bn", "pkr_usd", "brent_usd")}
    return sinks.write_with_provenance(baked, shared_dir(c.spark, "macro-baked"), "date", sources)


@query("a18_bake_macro", "select date, policy_rate, cpi_yoy, fx_reserves_sbp_bn, remittances_bn, cast(null as double) as current_account_mn, pkr_usd, brent_usd from macro", "policy_rate cpi_yoy fx_reserves_sbp_bn remittances_bn pkr_usd brent_usd")
def _(c):
    months = c.view("macro_months").withColumn("month", F.date_format("date", "yyyy-MM")).drop("date")
    return ctx.bake_macro(months, c.m.rates.withColumn("seq", F.lit(0)))
