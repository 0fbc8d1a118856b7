"""Fitted rankings by boosted trees: classifier split, walk-forward, importance, screens.

Fits are distributed and read one written panel. The driver only lists folds (one per
month and horizon) and their trees; models that a task can hold are fitted side by side in
one job, larger ones by MLlib (``panelkit.plans.boost``). Scores are written, so lineage
does not grow. Folds, horizons, rows and boosting rounds are never thinned.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from panelkit.functions.scalar import month_index
from panelkit.operators import ranks
from panelkit.operators import xsection as X
from panelkit.operators.months import calendar_broadcast
from panelkit.plans import boost
from panelkit.plans.folds import purged_folds
from panelkit.session import materialize, shared_dir


def assembled(df: DataFrame, features: list[str], label: str | None) -> DataFrame:
    """Adds the feature vector; rows with a missing feature (or label) drop out, which
    MLlib trees do not accept."""
    need = features + ([label] if label else [])
    clean = df.dropna(subset=need).withColumns({f: F.col(f).cast("double") for f in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(clean)


def regressor(label: str, depth: int = 4, rounds: int = 300, leaf: int = 60) -> GBTRegressor:
    return GBTRegressor(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=0.05, minInstancesPerNode=leaf, seed=42)


def classifier(label: str, depth: int = 4, rounds: int = 250, leaf: int = 120) -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=0.05, minInstancesPerNode=leaf, seed=42)


def probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fitted(est: Estimator, df: DataFrame, width: int) -> Model | boost.Boosted:
    """A model of all rows of a frame with a vector ``features`` of ``width`` values."""
    label = est.getLabelCol()
    return boost.fit_each(df, width, [boost.Wanted(lambda _: est, label)])[0]


def time_split_classifier(panel: DataFrame, features: list[str], label: str, cutoff: str, est: Estimator) -> tuple[Model | boost.Boosted, DataFrame]:
    """Fit before the cutoff date, score from it on. Returns the model and scored rows."""
    df = assembled(materialize(panel, "labelled"), features, label)
    cut = F.lit(cutoff).cast("date")
    model = fitted(est, df.filter(F.col("date") < cut), len(features))
    return model, materialize(probability(model.transform(df.filter(F.col("date") >= cut))).drop("features"), "scores")


def classifier_report(scored: DataFrame, label: str) -> DataFrame:
    """Decile table with the area under the curve and base rate on each row."""
    area = X.auc(scored, "score", label).select("auc").scalar()
    base = scored.select(F.avg(label)).scalar()
    return X.decile_lift(scored, "score", label).withColumns({"auc": area, "base_rate": base})


def split_sizes(panel: DataFrame, label: str, cutoff: str, min_test: int = 200, min_events: int = 30) -> DataFrame:
    """One row: rows and events on both sides of the cutoff, and whether they suffice."""
    late = F.col("date") >= F.lit(cutoff).cast("date")
    g = panel.agg(
        F.count(F.when(~late, 1)).alias("n_train"), F.count(F.when(late, 1)).alias("n_test"),
        F.coalesce(F.sum(F.when(~late, F.col(label))), F.lit(0.0)).alias("train_events"), F.avg(F.when(late, F.col(label))).alias("base_rate"),
    )
    return g.withColumn("sufficient", (F.col("n_test") >= min_test) & (F.col("train_events") >= min_events))


def classifier_verdict(sizes: DataFrame, report: DataFrame) -> DataFrame:
    """One row: the sizes, the area under the curve, the top decile, and the verdict. Small
    samples get no verdict but ``insufficient``."""
    top = report.filter(F.col("decile") == report.select(F.max("decile")).scalar()).select("auc", F.col("rate").alias("top_rate"), F.col("lift").alias("top_lift"))
    values = {c: top.select(c).scalar() for c in ("auc", "top_rate", "top_lift")}
    edge = (F.col("auc") > 0.56) & (F.col("top_lift") > 1.3)
    return sizes.withColumns(values).withColumn("verdict", F.when(~F.col("sufficient"), "insufficient").when(edge, "modest_edge").otherwise("no_edge"))


def current_screen(model: Model | boost.Boosted, panel: DataFrame, features: list[str], k: int = 15, by: str = "date") -> DataFrame:
    """The k best rows of the latest date (or, by="ym", of the latest month)."""
    latest = panel.filter(F.col(by) == panel.select(F.max(by)).scalar())
    return X.top_k(probability(model.transform(assembled(latest, features, None))), "score", k, [by])


def fold_sizes(panel: DataFrame, features: list[str], horizons: tuple[int, ...], min_months: int, min_train: int, min_test: int) -> DataFrame:
    """(H, fold, n_train, n_test, last_train) of all folds of all horizons, over rows with
    complete features."""
    complete = panel.dropna(subset=features)
    each = [purged_folds(complete, f"fwd_{h}", h, min_months, min_train, min_test).select(F.lit(h).alias("H"), "*") for h in horizons]
    return reduce(DataFrame.unionByName, each)


def walk_forward(
    panel: DataFrame, features: list[str], horizons: tuple[int, ...], make: Callable[[str], Estimator], min_months: int,
    min_train: int, min_test: int, carry: tuple[str, ...] = ("symbol",), side_by_side: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(scored, folds). ``scored`` has (H, fold, ym, *carry, score, fwd): every fold month
    of every horizon scored by a model fitted on the labels realised before it. Rows with
    a missing feature take no part, as ``folds`` counts them.

    Folds do not depend on each other: ``boost.fit_each`` fits them side by side. Scores
    of folds fitted in tasks come from one pass over the fold months; a fold that MLlib
    fitted writes its own folder. The training table is laid out by month, so a fold reads
    its months only, and range-partitioned first: a month has as many files as its size
    needs, not one for each part of the panel, which every later fold would open.
    """
    spark = panel.sparkSession
    labels = [f"fwd_{h}" for h in horizons]
    folds = materialize(fold_sizes(panel, features, horizons, min_months, min_train, min_test), "folds")
    table, out = shared_dir(spark, "train"), shared_dir(spark, "walk-forward")
    rows = assembled(panel.select("ym", *carry, *features, *labels), features, None).select("ym", *carry, "features", *labels)
    rows.repartitionByRange("ym", *carry).write.partitionBy("ym").parquet(table)
    df = spark.read.schema(rows.schema).parquet(table)
    at = lambda m: F.lit(f"{(m - 1) // 12:04d}-{(m - 1) % 12 + 1:02d}-01").cast("date")

    # one row per month and horizon: the list is bounded by the calendar
    todo = folds.orderBy("H", "fold").collect()
    wanted = [boost.Wanted(make, f"fwd_{f['H']}", f["fold"] - f["H"], f["n_train"]) for f in todo]
    models = boost.fit_each(df, len(features), wanted, month_index("ym"), lambda m: F.col("ym") <= at(m), side_by_side)
    trees = {(f["H"], f["fold"]): m.trees for f, m in zip(todo, models) if isinstance(m, boost.Boosted)}

    def score(fold: Row, model: Model) -> None:
        h = fold["H"]
        scored = model.transform(df.filter(F.col("ym") == at(fold["fold"])))
        scored.select("ym", *carry, F.col("prediction").alias("score"), F.col(f"fwd_{h}").alias("fwd")).write.parquet(os.path.join(out, f"H={h}", f"fold={fold['fold']}"))

    with ThreadPool(side_by_side) as pool:
        pool.starmap(score, [(f, m) for f, m in zip(todo, models) if (f["H"], f["fold"]) not in trees])
    schema = df.select("ym", *carry, F.lit(0.0).alias("score"), F.col(labels[0]).alias("fwd"), F.lit(0).alias("H"), F.lit(0).alias("fold")).schema
    if trees:
        of_tasks = materialize(boost.fold_scores(df, trees, carry).select(*schema.names), "fold-scores")
    if not todo:
        return spark.createDataFrame([], schema), folds
    if len(trees) == len(todo):
        return of_tasks, folds
    by_folder = spark.read.schema(schema).parquet(out)
    return (by_folder.unionByName(of_tasks) if trees else by_folder), folds


def fold_report(scored: DataFrame, folds: DataFrame, k: int, name: str = "symbol") -> DataFrame:
    """One row per horizon and fold: sizes, rows scored, mean outcome, number of picks."""
    picks = X.top_k(scored, "score", k, ["H", "fold"], tie=name).groupBy("H", "fold").agg(F.count(F.lit(1)).alias("n_picks"))
    rows = scored.groupBy("H", "fold").agg(F.count("score").alias("n_scored"), F.avg("fwd").alias("universe"))
    return folds.join(rows, ["H", "fold"]).join(picks, ["H", "fold"])


def shuffled_copies(df: DataFrame, features: list[str], repeats: int, row_key: list[str], parts: int = 256) -> DataFrame:
    """Copies of the rows, one per (feature, repeat), with that feature permuted.

    For each repeat the rows stand in one seeded random circle, and a shuffled value is
    the next row's. The circle is cut into ``parts`` by a hash; the last row of a part
    takes the first of the next one. Only rows x repeats are shuffled; the copies per
    feature are made afterwards. A retry draws the same circle.
    """
    key = [F.col(k) for k in row_key]
    base = df.withColumn("rep", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    base = base.withColumn("_u", F.xxhash64(*key, F.col("rep"))).withColumn("_part", F.pmod("_u", F.lit(parts)))
    values = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    place = F.struct("_u", *key)
    heads = base.groupBy("rep", "_part").agg(F.min_by(values, place).alias("_head"))
    circle = Window.partitionBy("rep").orderBy("_part")  # ``parts`` rows
    following = F.coalesce(F.lead("_head").over(circle), F.first("_head").over(circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("rep", "_part", following.alias("_follows"))
    inside = F.lead(values).over(Window.partitionBy("rep", "_part").orderBy("_u", *key))
    moved = base.withColumn("_next", inside).join(heads, ["rep", "_part"]).withColumn("_next", F.coalesce("_next", "_follows"))
    copies = moved.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    shuffled = {f: F.when(F.col("feature") == f, F.col("_next")[f]).otherwise(F.col(f).cast("double")) for f in features}
    return copies.withColumns(shuffled).drop("_u", "_part", "_next", "_follows")


def permutation_importance(model: Model | boost.Boosted, test: DataFrame, features: list[str], label: str, repeats: int, row_key: list[str], metric: str = "r2") -> DataFrame:
    """(feature, importance): fall of R squared (metric "r2"), or of the area under the
    curve of a classifier (metric "auc"), when a feature is shuffled, averaged over
    repeats. All copies are scored in one pass; ``test`` must be complete."""
    test = test.dropna(subset=[*features, label])
    y, p = F.col(label), F.col("prediction")
    mean = test.select(F.avg(label)).scalar()

    def r2(df: DataFrame, *keys: str) -> DataFrame:
        err = F.sum((y - p) * (y - p))
        return df.groupBy(*keys).agg((1 - F.try_divide(err, F.sum((y - mean) * (y - mean)))).alias("value"))

    def area(df: DataFrame, *keys: str) -> DataFrame:
        scores = probability(df).select(*keys, F.col("score"), y.cast("double").alias("_y"))
        ranked = ranks.averaged(scores, list(keys), {"score": "_r"})
        g = ranked.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_y")).alias("_s"), F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q"))
        return g.select(*keys, F.try_divide(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q")).alias("value"))

    measure = {"r2": r2, "auc": area}[metric]
    vectors = VectorAssembler(inputCols=features, outputCol="features")
    base = measure(model.transform(vectors.transform(test.withColumns({f: F.col(f).cast("double") for f in features})))).select("value").scalar()
    copies = shuffled_copies(test.select(*row_key, *features, label), features, repeats, row_key)
    per_copy = measure(model.transform(vectors.transform(copies)), "feature", "rep")
    return per_copy.groupBy("feature").agg((base - F.avg("value")).alias("importance"))


def embargoed_split(panel: DataFrame, label: str, h: int, test_months: int = 18) -> tuple[DataFrame, DataFrame]:
    """The last ``test_months`` for testing; training ends h months before them, so no
    training label reaches into the test."""
    m = panel.filter(F.col(label).isNotNull()).withColumn("_m", month_index("ym"))
    months = m.select("_m").distinct().orderBy(F.desc("_m")).limit(test_months)
    cut = months.select(F.min("_m")).scalar()
    return m.filter(F.col("_m") < cut - h).drop("_m"), m.filter(F.col("_m") >= cut).drop("_m")


def current_picks(panel: DataFrame, features: list[str], horizons: tuple[int, ...], make: Callable[[str], Estimator], k: int, name: str = "symbol", ym=None, min_train: int = 300) -> DataFrame:
    """(H, ym, name, rank, score): per horizon, fit on all labels realised before the
    chosen month (the latest by default), score that month, keep the k best. A horizon
    with fewer than ``min_train`` training rows or k candidates has no picks."""
    df = materialize(panel.dropna(subset=features).select("ym", name, *features, *[f"fwd_{h}" for h in horizons]), "current")
    df = assembled(df, features, None).withColumn("_m", month_index("ym"))
    entry = df.select(F.max("ym")).scalar() if ym is None else ym
    at = df.select(month_index(F.max("ym"))).scalar() if ym is None else month_index(ym)
    current = df.filter(F.col("ym") == entry)
    out = df.sparkSession.createDataFrame([], df.select(F.lit(1).alias("H"), "ym", name, F.lit(1).alias("rank"), F.lit(0.0).alias("score")).schema)
    if current.count() < k:
        return out
    sizes = df.select(*[F.count_if((F.col("_m") <= at - h) & F.col(f"fwd_{h}").isNotNull()).alias(f"n_{h}") for h in horizons], F.any_value(at).alias("at")).first()
    enough = [h for h in horizons if sizes[f"n_{h}"] >= min_train]
    wanted = [boost.Wanted(make, f"fwd_{h}", sizes["at"] - h, sizes[f"n_{h}"]) for h in enough]
    for h, model in zip(enough, boost.fit_each(df, len(features), wanted, F.col("_m"), lambda m: F.col("_m") <= m)):
        scored = model.transform(current)
        scored = scored.select("ym", name, F.col("prediction").alias("score"), F.lit(h).alias("H"))
        out = out.unionByName(X.top_k(scored, "score", k, ["H", "ym"], tie=name))
    return out
