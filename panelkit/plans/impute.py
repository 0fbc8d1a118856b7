"""Rows with missing features, kept: medians fitted on training months, and indicators.

For a live month and each horizon, the training rows are those whose outcome was realised
by then (entry month <= month - H). The medians of their features fill the gaps of
training rows and candidates alike, and one indicator per feature says where; no later
month enters a median, and no candidate is lost for a short history. Medians are exact and
split (``operators.selection``); the fitted table has one row per horizon.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import month_index
from panelkit.operators import xsection as X
from panelkit.operators.selection import medians
from panelkit.plans.evaluate import by_horizon
from panelkit.plans.models import fitted
from panelkit.session import materialize


def indicators(features: list[str]) -> list[str]:
    return [f"{f}_missing" for f in features]


def live_rows(panel: DataFrame, features: list[str], horizons: tuple[int, ...], ym=None, name: str = "symbol") -> DataFrame:
    """(H, ym, name, *features, fwd, is_train) as a written table: for each horizon the
    training rows, and the candidates of the month ``ym`` (the latest by default)."""
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    df = panel.select("ym", name, *doubles, *[f"fwd_{h}" for h in horizons])
    entry = panel.select(F.max("ym")).scalar() if ym is None else ym
    long = by_horizon(df, horizons, ["ym", name, *features])
    train = (month_index("ym") <= month_index(entry) - F.col("H")) & F.col("fwd").isNotNull()
    return materialize(long.withColumn("is_train", train).filter(train | (F.col("ym") == entry)), "live-rows")


def fitted_medians(rows: DataFrame, features: list[str]) -> DataFrame:
    """(H, feature, median) of the training rows of each horizon."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    long = rows.filter("is_train").select("H", F.inline(pairs))
    return medians(long, ["H", "feature"], "value", "median")


def filled(rows: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """The rows with gaps filled and ``<feature>_missing`` (1.0 or 0.0) added. A feature
    that training rows never have is filled with 0. ``fitted`` is joined as one row per
    horizon."""
    wide = fitted.groupBy("H").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("_medians"))
    df = rows.join(F.broadcast(wide), "H", "left")
    missing = {m: F.col(f).isNull().cast("double") for f, m in zip(features, indicators(features))}
    values = {f: F.coalesce(F.col(f), F.col("_medians")[f], F.lit(0.0)) for f in features}
    return df.withColumns(missing).withColumns(values).drop("_medians")


def candidate_counts(rows: DataFrame, features: list[str], k: int, min_train: int) -> DataFrame:
    """(H, n_train, n_candidates, n_incomplete, sufficient) before anything is filled."""
    gap = F.lit(False)
    for f in features:
        gap = gap | F.col(f).isNull()
    g = rows.groupBy("H").agg(
        F.count(F.when(F.col("is_train"), 1)).alias("n_train"), F.count(F.when(~F.col("is_train"), 1)).alias("n_candidates"),
        F.count(F.when(~F.col("is_train") & gap, 1)).alias("n_incomplete"),
    )
    return g.withColumn("sufficient", (F.col("n_train") >= min_train) & (F.col("n_candidates") >= k))


def live_picks(panel: DataFrame, features: list[str], horizons: tuple[int, ...], make: Callable[[str], Estimator], k: int, name: str = "symbol", ym=None, min_train: int = 200) -> DataFrame:
    """(H, ym, name, rank, score): per horizon, fit on the filled training rows, score all
    candidates, keep the k best. A horizon with fewer than ``min_train`` training rows or
    k candidates has no picks."""
    rows = live_rows(panel, features, horizons, ym, name)
    middles = materialize(fitted_medians(rows, features), "live-medians")
    inputs = [*features, *indicators(features)]
    ready = VectorAssembler(inputCols=inputs, outputCol="features").transform(filled(rows, middles, features))
    df = materialize(ready.select("H", "ym", name, "features", "fwd", "is_train"), "live-vectors")
    out = df.sparkSession.createDataFrame([], df.select("H", "ym", name, F.lit(1).alias("rank"), F.lit(0.0).alias("score")).schema)
    # one row per horizon
    enough = {r["H"] for r in candidate_counts(rows, features, k, min_train).filter("sufficient").select("H").collect()}
    sure = [h for h in horizons if h in enough]
    with ThreadPool(max(len(sure), 1)) as pool:
        models = pool.map(lambda h: fitted(make("fwd"), df.filter((F.col("H") == h) & F.col("is_train")), len(inputs)), sure)
    for h, model in zip(sure, models):
        mine = df.filter(F.col("H") == h)
        best = model.transform(mine.filter("not is_train")).select("H", "ym", name, F.col("prediction").alias("score"))
        out = out.unionByName(X.top_k(best, "score", k, ["H", "ym"], tie=name))
    return out
