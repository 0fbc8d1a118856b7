"""Input views in the shapes the operators expect, derived from the star-schema tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def symbol_of(key: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 6, "0"))


def month_abbrev(date: Column) -> Column:
    return F.substring(F.lit(MONTHS), 3 * F.month(date) - 2, F.lit(3))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and ship day. Lines are combined map-side first, and the
    small supplier and nation tables join the aggregate, not the lines."""
    days = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").cast("long").alias("volume"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("ldcp"),
        (F.avg(F.col("l_extendedprice") / F.col("l_quantity")) * (1 + F.avg("l_discount") - 0.05)).alias("close"),
    )
    sector = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.col("n_name").alias("sector"))
    symbol = symbol_of("l_suppkey")
    return days.join(sector, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "date", symbol.alias("symbol"), "sector", symbol.alias("name"), "volume", "ldcp", "close"
    )


def sector_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, name, is_equity, is_operating): one nation plays the segment and two play
    funds; one code is left out so that the fallback name is exercised."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").filter(n != 24).select(
        F.col("n_name").alias("code"), F.concat(F.lit("Sector "), n.cast("string")).alias("name"),
        (n != 23).alias("is_equity"), (~n.isin(6, 15, 23)).alias("is_operating"),
    )


def contracts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashed contract rows of returned first lines, as in a raw feed."""
    d = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 1").select(
        d.alias("date"), F.concat(symbol_of("l_suppkey"), F.lit("-"), month_abbrev(d)).alias("symbol")
    ).distinct()


def rate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, rate, change_bps): one decision per quarter."""
    d = F.col("o_orderdate").cast("date")
    q = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.year(d).alias("y"), F.quarter(d).alias("q")).agg(
        F.min(d).alias("date"), F.round(F.avg("o_totalprice") / 10000, 2).alias("rate")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return q.select("date", "rate", F.round((F.col("rate") - F.lag("rate").over(w)) * 100).cast("long").alias("change_bps"))


def macro_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end macro rows without the policy rate."""
    p, s, pr = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate"), "MM").alias("ym")).agg(
        (F.avg(p) / 10000).alias("cpi_yoy"), (F.sum(F.when(s == "F", p)) / 1e6).alias("fx_reserves_sbp_bn"),
        (F.avg(F.when(s == "O", p)) / 1000).alias("pkr_usd"), (F.avg(F.when(pr == "5-LOW", p)) / 1000).alias("brent_usd"),
        (F.count(F.lit(1)).cast("double") / 100).alias("remittances_bn"),
    ).select(F.last_day("ym").alias("date"), "cpi_yoy", "fx_reserves_sbp_bn", "pkr_usd", "brent_usd", "remittances_bn")


def catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each month as dated events."""
    d = F.col("o_orderdate").cast("date")
    rank = F.row_number().over(Window.partitionBy(F.trunc(d, "MM")).orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = table(spark, sf_dir, "orders").withColumn("_rn", rank).filter("_rn <= 3")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Sector "), F.col("n_nationkey").cast("string")).alias("sector"))
    sign = F.when(F.col("o_orderstatus") == "F", 0.3).when(F.col("o_orderstatus") == "O", -0.3).otherwise(0.0)
    return (
        top.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(d.alias("date"), F.col("o_orderpriority").alias("type"),
                F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), "sector", sign.alias("expected_sign"))
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as news items; the whole text is the headline."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("headline"),
        F.when(F.col("doc_id") % 7 != 0, (1 + F.col("doc_id") % 6).cast("int")).alias("tier"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.col("lang"))).otherwise(F.array().cast("array<string>")).alias("sectors"),
    )


def sector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): suppliers' nation sells to the customers' nation. The lines are
    counted per (order, supplier) before any join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation")
    sup = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("src"))
    cus = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("dst"))
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(cus, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    return (
        lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("src", "dst").agg(F.sum("n").alias("n"))
    )


def sector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested graph document rows: name, downstream names (one of them unknown), and a
    map of stated sensitivities."""
    names = F.concat(F.lit("Sector "), F.col("n_nationkey").cast("string"))
    k = F.col("n_nationkey")
    busy = sector_edges(spark, sf_dir).groupBy("src").agg(F.max(F.struct("n", "dst")).alias("m")).select("src", F.col("m.dst").alias("best"))
    sens = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("policy_rate", "pkr_depreciation", "oil", "other")]),
        F.array((k % 3 - 1).cast("double"), (k % 5 - 2).cast("double"), (k % 2).cast("double"), F.lit(1.0)),
    )
    return table(spark, sf_dir, "nation").join(busy, F.col("n_name") == F.col("src"), "left").select(
        names.alias("sector"), F.col("n_name").alias("name"),
        F.array_compact(F.array(F.col("best"), F.concat(F.lit("NATION_"), ((k + 5) % 30).cast("string")))).alias("downstream"),
        sens.alias("sensitivity"),
    )


def causal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region, the chain (trigger, affected ARRAY<STRUCT<sector, sign>>)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    effect = F.struct(F.col("n_name").alias("sector"), (F.col("n_nationkey") % 2 * 2 - 1).alias("sign"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("trigger")).agg(F.collect_list(effect).alias("affected"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, fipi, lipi) per day."""
    v, t = F.col("value"), F.col("event_type")
    sign = F.when(t == "purchase", v).when(t == "error", -v).otherwise(0.0)
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.sum(sign).alias("fipi"), F.sum(-sign).alias("lipi"))


def client_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, net) per event type."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("client")).agg(F.sum("value").alias("net"))


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, pos, line): raw feed lines of the daily panel, one file per month, with
    planted bad lines: repeats with another close, blank closes, zero closes, short lines."""
    p = daily_panel(spark, sf_dir).withColumn("key", F.substring("symbol", 2, 6).cast("long"))

    def cents(c: str) -> Column:
        return F.floor(F.col(c) * 100 + 0.37).cast("long")

    variants = F.array_compact(F.array(
        F.lit("plain"), F.when(F.col("key") % 5 == 0, F.lit("repeat")), F.when(F.col("key") % 7 == 0, F.lit("blank")),
        F.when(F.col("key") % 11 == 0, F.lit("zero")), F.when(F.col("key") % 13 == 0, F.lit("short")),
    ))
    p = p.withColumn("variant", F.explode(variants))
    order = F.element_at(F.create_map(*[F.lit(x) for x in ("plain", 0, "repeat", 1, "blank", 2, "zero", 3, "short", 4)]), F.col("variant"))
    close = (
        F.when(F.col("variant") == "repeat", (cents("close") + 100).cast("string")).when(F.col("variant") == "blank", "")
        .when(F.col("variant") == "zero", "0").otherwise(cents("close").cast("string"))
    )
    d = F.col("date")
    stamp = F.concat(F.lpad(F.day(d).cast("string"), 2, "0"), month_abbrev(d), F.year(d).cast("string"))
    full = F.concat_ws("|", stamp, F.concat(F.lit(" "), F.col("symbol")), F.col("sector"), F.col("symbol"), F.lit(""), F.lit(""), F.lit(""),
                       close, F.col("volume").cast("string"), cents("ldcp").cast("string"))
    line = F.when(F.col("variant") == "short", F.concat_ws("|", stamp, F.col("symbol"))).otherwise(full)
    return p.select(F.date_format(d, "yyyy-MM").alias("file"), (F.datediff(d, F.lit("1990-01-01").cast("date")) * 10_000_000_000 + F.col("key") * 10 + order).cast("long").alias("pos"), line.alias("line"))
