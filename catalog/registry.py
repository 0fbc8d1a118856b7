"""Registration of queries and oracles, and the parameters they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from catalog.relations import with_relations
from panelkit.functions.scalar import round_doubles
from panelkit.plans import views
from panelkit.plans.market import Market, from_tables

MIN_ADV = 40_000.0
START = "1995-03-01"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_contexts: dict[tuple[str, str], "Context"] = {}


class Context:
    """One scale folder in one session; shared frames are built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def m(self) -> Market:
        return from_tables(self.spark, self.sf_dir, MIN_ADV, START)

    def view(self, name: str) -> DataFrame:
        return getattr(views, name)(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]


def forget_contexts() -> None:
    """Drop shared frames, so that a timing starts cold."""
    _contexts.clear()


def query(name: str, sql: str | None = None, rnd: str = "", digits: int = 6):
    """Register a query of a Context. ``sql`` may use any shared relation by name;
    ``rnd`` lists its double columns, rounded alike on both sides."""

    def register(fn: Callable[[Context], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(context(spark, sf_dir)), digits)

        QUERIES[name] = run
        if sql is not None:
            cols = rnd.split()
            # adding zero turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
            rounded = ", ".join(f"round(cast(cast({c} as float) as double), {digits}) + 0.0 as {c}" for c in cols)
            star = f"select * replace ({rounded})" if cols else "select *"
            ORACLES[name] = with_relations(f"{star} from ({sql}) final_rows")
        return fn

    return register
