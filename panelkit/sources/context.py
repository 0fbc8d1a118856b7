"""Readers of the small dated inputs. An absent file gives an empty typed frame."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelkit.functions import fixed_values as fv
from panelkit.functions.scalar import nan_to_null
from panelkit.operators.asof import backward_asof, latest_per_date
from panelkit.operators.dims import normalize_names, sector_aliases

MACRO_SCHEMA = "date date, " + ", ".join(f"{c} double" for c in fv.MACRO_FILE_COLUMNS[1:])
RATES_SCHEMA = "date date, rate double, change_bps int, source string"
EVENTS_SCHEMA = (
    "events array<struct<date:date,type:string,title:string,sectors:array<string>,"
    "expected_sign:double,source:string,confidence:string>>"
)
NEWS_SCHEMA = (
    "items array<struct<date:date,headline:string,source:string,tier:int,sentiment:double,sectors:array<string>,rationale:string>>"
)
FLOWS_SCHEMA = (
    "source string, as_of string, coverage string, unit string, "
    "client_week struct<window:string,net_usd:map<string,bigint>>, "
    "daily struct<days:array<date>,fipi:array<double>,lipi:array<double>>"
)
GRAPH_SCHEMA = (
    "sectors array<struct<name:string,key_tickers:array<string>,inputs:array<string>,upstream:array<string>,"
    "downstream:array<string>,macro_sensitivity:map<string,double>>>, "
    "causal_chains array<struct<trigger:string,mechanism:string,affected:array<struct<sector:string,sign:double>>,evidence:string>>"
)
FUNDAMENTALS_SCHEMA = (
    "as_of string, companies array<struct<ticker:string,name:string,sector:string,eps_ttm:double,pe:double,roe_pct:double,"
    "bvps:double,div_yield_pct:double,mkt_cap_pkr_bn:double,earnings_growth_yoy_pct:double,revenue_growth_yoy_pct:double,"
    "eps_history:array<struct<period:string,eps:double>>,source:string>>"
)


SOVEREIGN_SCHEMA = (
    "ratings array<struct<date:date,agency:string,rating:string,outlook:string,action:string,source:string>>, "
    "external_debt array<struct<year:int,total_usd_bn:double,pct_of_gdp:double,source:string>>, "
    "imf_programs array<struct<date:date,program:string,event:string,amount_usd_bn:double,source:string>>, "
    "macro_annual array<struct<fy:string,gdp_growth_pct:double,fiscal_deficit_pct_gdp:double,debt_to_gdp_pct:double,source:string>>"
)
SOURCES_SCHEMA = "sources array<struct<name:string,url:string,category:string,notes:string>>"


def read_or_empty(spark: SparkSession, path: str, fmt: str, schema: str, **options: str) -> DataFrame:
    """A typed read; an absent path is an empty frame of the same schema."""
    try:
        return spark.read.format(fmt).schema(schema).options(**options).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, its columns taken by name in any order: values that are
    no such type and absent columns are null, further columns are left out."""
    try:
        raw = spark.read.csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    have = {c.strip().lower(): F.col(f"`{c}`") for c in raw.columns}
    kinds = StructType.fromDDL(schema).fields
    return raw.select(*[F.trim(have[f.name]).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])


def read_macro_monthly(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(read_csv(spark, path, MACRO_SCHEMA))


def read_macro_wide(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_macro_monthly``, with the further columns that wider files have."""
    return nan_to_null(read_csv(spark, path, "date date, " + ", ".join(f"{c} double" for c in fv.MACRO_COLUMNS)))


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """(date) of a list of holidays, one ISO date per line; other lines are left out."""
    lines = read_or_empty(spark, path, "text", "value string")
    return lines.select(F.regexp_extract("value", r"\d{4}-\d{2}-\d{2}", 0).try_cast("date").alias("date")).filter("date is not null").distinct()


def read_rate_events(spark: SparkSession, path: str) -> DataFrame:
    """Rate decisions with ``seq``, their order in the file: the later of two decisions
    on one date is in force."""
    return nan_to_null(read_csv(spark, path, RATES_SCHEMA)).withColumn("seq", F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One nested document per file, or one per line."""
    return read_or_empty(spark, path, "json", schema, multiLine=str(not lines).lower())


def read_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(date, type, title, sectors, expected_sign, source, confidence), one row per event."""
    return read_json(spark, path, EVENTS_SCHEMA, lines).select(F.inline("events"))


def event_sectors(events: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """One row per event and named sector; with a ``canonical`` (name) table, spelling
    variants become its names."""
    rows = events.select("date", "type", "title", F.explode("sectors").alias("sector"), "expected_sign")
    return rows if canonical is None else normalize_names(rows, "sector", canonical, sector_aliases(rows.sparkSession))


def read_news(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return read_json(spark, path, NEWS_SCHEMA, lines).select(F.inline("items"))


def flow_days(flows: DataFrame) -> DataFrame:
    """(date, fipi, lipi) from the parallel arrays."""
    zipped = F.explode(F.arrays_zip("daily.days", "daily.fipi", "daily.lipi")).alias("z")
    return flows.select(zipped).select(F.col("z.days").alias("date"), "z.fipi", "z.lipi")


def client_week(flows: DataFrame) -> DataFrame:
    """(client, net) from the map of net flows."""
    return flows.select(F.explode("client_week.net_usd").alias("client", "net"))


def graph_sectors(graph: DataFrame) -> DataFrame:
    return graph.select(F.inline("sectors"))


def graph_chains(graph: DataFrame) -> DataFrame:
    return graph.select(F.inline("causal_chains"))


def eps_history(fundamentals: DataFrame) -> DataFrame:
    """(ticker, sector, period, eps), one row per company and period."""
    companies = fundamentals.select(F.explode("companies").alias("c"))
    return companies.select("c.ticker", "c.sector", F.explode("c.eps_history").alias("h")).select("ticker", "sector", "h.period", "h.eps")


def companies(fundamentals: DataFrame) -> DataFrame:
    """One row per company with its last measures; the history stays apart."""
    return fundamentals.select(F.inline("companies")).drop("eps_history")


def sovereign_tables(sovereign: DataFrame) -> dict[str, DataFrame]:
    """The four lists of a sovereign document as tables: ratings and programmes by date,
    debt by year, annual figures by fiscal year."""
    return {n: sovereign.select(F.inline(n)) for n in ("ratings", "external_debt", "imf_programs", "macro_annual")}


def rating_spells(ratings: DataFrame) -> DataFrame:
    """(agency, rating, outlook, since, until): how long each agency's rating held, up to
    its next one; null is now. Of several on one date the greatest text counts."""
    one = ratings.groupBy("agency", "date").agg(F.max(F.struct("rating", "outlook")).alias("_r"))
    following = F.lead("date").over(Window.partitionBy("agency").orderBy("date"))
    return one.select("agency", "_r.rating", "_r.outlook", F.col("date").alias("since"), following.alias("until"))


def data_sources(sources: DataFrame) -> DataFrame:
    return sources.select(F.inline("sources"))


def bake_macro(months: DataFrame, rates: DataFrame, order: str = "seq") -> DataFrame:
    """Macro rows keyed by a ``month`` string become month-end rows with the policy rate
    in force, in the fixed column order; absent columns are null. ``order`` decides
    between decisions on one date."""
    dated = months.withColumn("date", F.last_day(F.to_date("month", "yyyy-MM")))
    rated = backward_asof(dated, latest_per_date(rates, "rate", order), "rate").withColumn("policy_rate", F.col("rate"))
    have = set(rated.columns)
    return rated.select(
        "date", *[F.col(c).cast("double") if c in have else F.lit(None).cast("double").alias(c) for c in fv.MACRO_FILE_COLUMNS[1:]]
    )
