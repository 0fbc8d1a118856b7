"""Walk-forward ridge regression from sufficient statistics, without a loop over folds.

A linear fit needs of its rows only the sums of products of (1, features, outcome). These
are taken once per month and horizon, in one pass over the panel, and are additive: the
statistics of a fold are the running sum up to its last training month. So all folds of
all horizons are fitted by one plan: a scan with partial sums, a window over months, and a
small solve per fold. What is shuffled and windowed is (features + 2)^2 / 2 numbers a
month and horizon, whatever the number of rows.

The fit is on features standardised by the training rows, with penalty ``LAMBDA`` on the
correlation matrix; a feature that is constant in training has weight 0. Rows with a
missing feature take no part; ``panelkit.plans.impute`` fills them beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.scalar import month_index
from panelkit.operators.months import calendar_broadcast
from panelkit.plans.models import fold_sizes
from panelkit.session import materialize

#: Penalty on the diagonal of the correlation matrix.
LAMBDA = 0.1
#: Variances below this share of the mean square count as none.
FLAT = 1e-10


def month_moments(panel: DataFrame, features: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """(H, m, pos, s): per month and horizon, sums of products of (1, features, outcome)
    over complete rows with an outcome; ``pos`` numbers the entries of the upper triangle.
    Tasks add up months of their rows and send one row per month and horizon."""
    d = len(features) + 2
    upper = np.triu_indices(d)
    columns = [month_index("ym").cast("int").alias("m"), *[F.col(f).cast("double").alias(f) for f in features], *[F.col(f"fwd_{h}").cast("double").alias(f"fwd_{h}") for h in horizons]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            month = b.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([np.ones(len(month)), *(b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(features)))], 1)
            for k, h in enumerate(horizons):
                y = b.column(1 + len(features) + k).to_numpy(zero_copy_only=False)
                ok = ~np.isnan(y)
                for m in np.unique(month[ok]).tolist():
                    rows = ok & (month == m)
                    z = np.column_stack([x[rows], y[rows]])
                    sums[h, m] = sums.get((h, m), 0) + (z.T @ z)[upper]
        if sums:
            keys = list(sums)
            values = pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), values], names=["H", "m", "part"])

    parts = panel.dropna(subset=features).select(*columns).mapInArrow(run, "H int, m int, part array<double>")
    return parts.select("H", "m", F.posexplode("part").alias("pos", "s")).groupBy("H", "m", "pos").agg(F.sum("s").alias("s"))


def up_to_month(moments: DataFrame) -> DataFrame:
    """Running sums over the months of a horizon."""
    until = Window.partitionBy("H", "pos").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return moments.withColumn("s", F.sum("s").over(until))


def solve(products: np.ndarray, penalty: float = LAMBDA) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, deviation, weight) of the features and the mean outcome, from the full
    matrix of sums of products. Deviations of flat features are 0."""
    n = products[0, 0]
    mean = products[0] / n
    square = np.diag(products) / n
    cov = products / n - np.outer(mean, mean)
    var = np.diag(cov)
    x = slice(1, len(mean) - 1)
    some = var[x] > FLAT * square[x]
    sd = np.where(some, np.sqrt(np.maximum(var[x], 0)), 0.0)
    scale = np.where(some, 1 / np.where(some, sd, 1), 0.0)
    corr = cov[x, x] * np.outer(scale, scale) + penalty * np.eye(len(sd))
    weight = np.linalg.solve(corr, cov[x, -1] * scale)
    return mean[x], sd, weight, float(mean[-1])


def fitted(sums: DataFrame, features: list[str], penalty: float = LAMBDA) -> DataFrame:
    """(H, fold, n, base, features array<struct<feature, mean, sd, weight>>) from rows
    (H, fold, pos, s): one small system per fold."""
    d = len(features) + 2
    upper = np.triu_indices(d)
    g = sums.groupBy("H", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda r: r["s"]).alias("s"))
    one = pa.struct([("feature", pa.string()), ("mean", pa.float64()), ("sd", pa.float64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(2).to_pylist():
                full = np.zeros((d, d))
                full[upper] = s
                full = full + np.triu(full, 1).T
                mean, sd, weight, base = solve(full, penalty)
                out.append((int(round(full[0, 0])), base, [{"feature": f, "mean": x, "sd": y, "weight": w} for f, x, y, w in zip(features, mean.tolist(), sd.tolist(), weight.tolist())]))
            columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.list_(one))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["H", "fold", "n", "base", "features"])

    return g.mapInArrow(run, "H int, fold int, n bigint, base double, features array<struct<feature: string, mean: double, sd: double, weight: double>>")


def walk_forward_fits(panel: DataFrame, features: list[str], horizons: tuple[int, ...], min_months: int, min_train: int, min_test: int, penalty: float = LAMBDA) -> DataFrame:
    """The fit of every purged fold of every horizon, as ``fitted`` rows."""
    folds = fold_sizes(panel, features, horizons, min_months, min_train, min_test)
    sums = up_to_month(month_moments(panel, features, horizons))
    at = folds.select("H", F.col("fold").cast("int").alias("fold"), F.col("last_train").cast("int").alias("m"))
    return materialize(fitted(sums.join(calendar_broadcast(at), ["H", "m"]).select("H", "fold", "pos", "s"), features, penalty), "ridge-fits")


def weights(fits: DataFrame) -> DataFrame:
    """(H, fold, n, feature, mean, sd, weight), one row per feature."""
    return fits.select("H", "fold", "n", F.inline("features"))


def linear_score(fit: str = "features", base: str = "base") -> Column:
    """base + sum of weight * (x - mean) / sd, by the names of the row's columns held in
    an array ``_x`` in the order of the fit."""
    terms = F.zip_with("_x", fit, lambda x, f: F.when(f["sd"] > 0, f["weight"] * (x - f["mean"]) / f["sd"]).otherwise(0.0))
    return F.aggregate(terms, F.col(base), lambda a, t: a + t)


def scored(panel: DataFrame, fits: DataFrame, features: list[str], horizons: tuple[int, ...], carry: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(H, fold, ym, *carry, score, fwd): every fold month scored by its own fit, which
    arrives as one broadcast row per month and horizon."""
    rows = panel.dropna(subset=features).select("ym", *carry, month_index("ym").cast("int").alias("fold"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), *[f"fwd_{h}" for h in horizons])
    both = rows.join(calendar_broadcast(fits), "fold")
    outcome = F.coalesce(*[F.when(F.col("H") == h, F.col(f"fwd_{h}")) for h in horizons])
    return both.select("H", "fold", "ym", *carry, linear_score().alias("score"), outcome.alias("fwd"))


def held_out_fit(panel: DataFrame, features: list[str], h: int, test_months: int = 18, penalty: float = LAMBDA) -> tuple[DataFrame, DataFrame]:
    """(fits, test): a fit on the months that end h before the last ``test_months`` with an
    outcome, and the complete rows of those months as (ym, _x, y)."""
    known = panel.dropna(subset=[*features, f"fwd_{h}"]).withColumn("_m", month_index("ym").cast("int"))
    labelled = panel.filter(F.col(f"fwd_{h}").isNotNull()).select(month_index("ym").cast("int").alias("m")).distinct()
    cut = labelled.orderBy(F.desc("m")).limit(test_months).select(F.min("m")).scalar()
    sums = up_to_month(month_moments(known, features, (h,)).filter(F.col("m") < cut - h))
    last = Window.partitionBy("H", "pos").orderBy(F.desc("m"))
    newest = sums.withColumn("_i", F.row_number().over(last)).filter("_i = 1")
    fits = fitted(newest.select("H", F.lit(0).alias("fold"), "pos", "s"), features, penalty)
    test = known.filter(F.col("_m") >= cut).select("ym", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), F.col(f"fwd_{h}").alias("y"))
    return fits, test


def expected_importance(fits: DataFrame, test: DataFrame) -> DataFrame:
    """(feature, importance): the expected fall of R squared when a feature is permuted.
    For a linear score it follows from moments of the test rows, so nothing is permuted:
    with slope b, error e and test variance, 2 b cov(e, x) + 2 b^2 var(x) over var(y)."""
    rows = test.join(calendar_broadcast(fits), F.lit(True)).select(F.col("y"), (F.col("y") - linear_score()).alias("e"), F.posexplode(F.arrays_zip("_x", "features")).alias("_i", "_z"))
    rows = rows.select("y", "e", F.col("_z.features.feature").alias("feature"), F.col("_z._x").alias("x"), F.when(F.col("_z.features.sd") > 0, F.col("_z.features.weight") / F.col("_z.features.sd")).otherwise(0.0).alias("b"))
    g = rows.groupBy("feature").agg(F.covar_pop("e", "x").alias("c"), F.var_pop("x").alias("v"), F.var_pop("y").alias("t"), F.first("b").alias("b"))
    return g.select("feature", ((2 * F.col("b") * F.col("c") + 2 * F.col("b") * F.col("b") * F.col("v")) / F.col("t")).alias("importance"))
