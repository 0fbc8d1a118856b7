"""The fear/greed gauge of market internals and its forward-return table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv
from panelkit.functions import rolling as R
from panelkit.functions import stats as S
from panelkit.functions.scalar import mood_band, mood_label
from panelkit.operators.asof import backward_asof
from panelkit.operators.trend import add_level, trend_flags

COMPONENTS = ["momentum", "trend", "breadth", "low_volatility", "strength"]


def mood_components(market: DataFrame, breadth: DataFrame) -> DataFrame:
    """Daily 0-100 scores, each ranked against its own trailing year."""
    w = R.series_window()
    base = trend_flags(market).join(F.broadcast(breadth), "date", "left")
    raw = base.withColumns(
        {
            "_mom": F.col("level") / R.rolling(F.avg, "level", 125, 40, w) - 1,
            "_br": R.rolling(F.avg, "breadth", 20, 8, w),
            "_vol": R.rolling(F.stddev_samp, "mkt_r", 20, 8, w),
            "_dd": F.col("level") / R.rolling(F.max, "level", 252, 60, w) - 1,
        }
    )
    inputs = ("_mom", "_br", "_vol", "_dd")
    raw = raw.withColumns({c: F.round(c, 9) for c in inputs})
    ranks = {c: R.trailing_pct_rank(c, 252, 90, w) for c in inputs}
    return raw.select(
        "date",
        ranks["_mom"].alias("momentum"),
        (F.col("exposure") * 100).alias("trend"),
        ranks["_br"].alias("breadth"),
        (100 - ranks["_vol"]).alias("low_volatility"),
        ranks["_dd"].alias("strength"),
    )


def mood_index(components: DataFrame) -> DataFrame:
    """(date, mood): mean of the available components."""
    mood = R.row_mean([F.col(c) for c in COMPONENTS])
    return components.select("date", mood.alias("mood")).filter("mood is not null")


def current_mood(components: DataFrame) -> DataFrame:
    """One row: latest score and label, the score five rows before, the components."""
    w = R.series_window()
    scored = components.withColumn("score", R.row_mean([F.col(c) for c in COMPONENTS])).filter("score is not null")
    scored = scored.withColumn("week_ago", F.coalesce(F.lag("score", 5).over(w), F.col("score")))
    last = scored.filter(F.col("date") == scored.select(F.max("date")).scalar())
    return last.select(F.col("date").alias("as_of"), "score", mood_label("score").alias("label"), "week_ago", *COMPONENTS)


def mood_history(mood: DataFrame, rows: int = 260) -> DataFrame:
    return mood.orderBy(F.desc("date")).limit(rows)


def forward_market(market: DataFrame, rows: int) -> DataFrame:
    """(date, fwd): index return over the next ``rows`` rows."""
    return add_level(market).select("date", R.forward_return("loglevel", rows, R.series_window()).alias("fwd"))


def mood_backtest(market: DataFrame, mood: DataFrame, rows: int = 20) -> DataFrame:
    """Forward index return by mood band, with the contrarian check on each row."""
    df = backward_asof(forward_market(market, rows), mood, "mood").filter("mood is not null and fwd is not null")
    table = df.withColumn("band", mood_band("mood")).groupBy("band").agg(
        F.count("fwd").alias("n"), F.avg("fwd").alias("avg_fwd"), S.median("fwd").alias("median_fwd"),
        S.share_true(F.col("fwd") > 0).alias("up_rate"),
    )
    order = F.array_position(F.array(*[F.lit(b) for b in fv.MOOD_BANDS]), F.col("band"))
    ends = table.select(F.min_by("avg_fwd", order).alias("fear"), F.max_by("avg_fwd", order).alias("greed"))
    contrarian = ends.select(F.col("fear") > F.col("greed") + 0.005).scalar()
    return table.withColumn("contrarian", contrarian)
