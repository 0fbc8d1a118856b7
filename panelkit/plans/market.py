"""The frames that most analyses share, built once from six inputs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from panelkit.functions import fixed_values as fv
from panelkit.operators import baskets, clean, months, mood
from panelkit.operators.asof import backward_asof, rate_order
from panelkit.operators.dims import operating_names
from panelkit.plans import panels, views
from panelkit.session import bucket_count, materialize

#: About 40 MB of prices; a task that joins them with what is derived from them holds several times that.
LINES_PER_BUCKET = 200_000


@dataclass
class Market:
    """Inputs and shared frames of one market.

    ``prices``, the basket series and the month-end panel feed many analyses, so each is
    written once to the shared folder and read back: plans stay short, nothing is
    recomputed, and executors may come and go. ``prices`` is bucketed by symbol, so the
    per-symbol windows of all analyses need no exchange. A panel that already exists as
    a table is passed as ``clean_prices``. ``buckets`` should give parts of a few hundred
    MB, because a bucket is not split; the default is the session's number of shuffle parts.
    """

    raw: DataFrame
    sectors: DataFrame
    rates: DataFrame
    macro_rows: DataFrame
    contract_rows: DataFrame
    min_adv: float = fv.FLOOR_INDEX
    start: str | None = fv.DEFAULT_START
    clean_prices: DataFrame | None = None
    buckets: int | None = None

    @cached_property
    def prices(self) -> DataFrame:
        if self.clean_prices is not None:
            return self.clean_prices
        return self._write_prices()

    def _write_prices(self) -> DataFrame:
        buckets = self.buckets or bucket_count(self.raw.sparkSession)
        return materialize(clean.price_panel(self.raw, self.sectors, buckets), "prices", "symbol", ("date",), buckets)

    @cached_property
    def market(self) -> DataFrame:
        return materialize(baskets.market_index(self.prices, self.min_adv, self.start), "market")

    @cached_property
    def breadth(self) -> DataFrame:
        return materialize(baskets.market_breadth(self.prices, self.min_adv, self.start), "breadth")

    @cached_property
    def sector_daily(self) -> DataFrame:
        return materialize(baskets.sector_daily_returns(self.prices, self.min_adv, self.start), "sector_daily")

    @cached_property
    def market_months(self) -> DataFrame:
        return months.monthly_market(self.market)

    @cached_property
    def sector_months(self) -> DataFrame:
        return materialize(months.monthly_sectors(self.sector_daily), "sector_months")

    @cached_property
    def macro(self) -> DataFrame:
        """Macro months with the policy rate in force at each month end."""
        joined = backward_asof(self.macro_rows, self.rates, "rate", order=rate_order(self.rates))
        return materialize(joined.withColumnRenamed("rate", "policy_rate"), "macro")

    @cached_property
    def mood_components(self) -> DataFrame:
        return mood.mood_components(self.market, self.breadth)

    @cached_property
    def mood(self) -> DataFrame:
        return materialize(mood.mood_index(self.mood_components), "mood")

    @cached_property
    def contracts(self) -> DataFrame:
        return clean.parse_contracts(self.contract_rows)

    @cached_property
    def operating(self) -> DataFrame:
        return operating_names(self.sectors)

    @cached_property
    def panel(self) -> DataFrame:
        """Month-end features with labels and eligibility."""
        panel = panels.feature_panel(self.prices, self.macro, self.mood, clean.contract_months(self.contracts), self.min_adv)
        return materialize(panel, "panel")

    @cached_property
    def eligible(self) -> DataFrame:
        return self.panel.filter("eligible")

    @cached_property
    def sector_panel(self) -> DataFrame:
        return panels.sector_panel(self.sector_months, self.market_months, self.macro, self.operating)


def from_tables(spark: SparkSession, sf_dir: str, min_adv: float, start: str | None) -> Market:
    """A market over the star-schema tables. A bucket is sorted by one task, so their number
    grows with the lines, which are counted from the file footers."""
    lines = views.table(spark, sf_dir, "lineitem").count()
    return Market(
        buckets=max(bucket_count(spark), math.ceil(lines / LINES_PER_BUCKET)),
        raw=views.daily_panel(spark, sf_dir), sectors=views.sector_dim(spark, sf_dir), rates=views.rate_events(spark, sf_dir),
        macro_rows=views.macro_months(spark, sf_dir), contract_rows=views.contracts_raw(spark, sf_dir), min_adv=min_adv, start=start,
    )
