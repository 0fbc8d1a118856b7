"""Boosted trees of the fitted rankings: equal to MLlib's, and with all their rounds."""

import datetime as dt
from functools import partial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelkit.plans import boost, models

NAMES = ["a", "b", "ties", "flat"]


def frame(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(float(np.float32(a)), float(np.float32(b)), float(t), 2.0, float(0.3 * a + (b > 0.5) * t + rng.normal() * 0.3)) for a, b, t in zip(rng.normal(size=n), rng.normal(size=n), rng.integers(0, 6, n))]
    df = spark.createDataFrame(rows, "a double, b double, ties double, flat double, y double").withColumn("event", (F.col("y") > 1.5).cast("double"))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df.repartition(3))


@pytest.mark.parametrize("rows", [1500, boost.PAIRED_ROWS])
def test_trees_equal_those_of_mllib(spark, monkeypatch, rows):
    monkeypatch.setattr(boost, "PAIRED_ROWS", 1500 if rows > 1500 else 10**9)  # both layouts of the histograms
    df = frame(spark).cache()
    for est in (models.regressor("y", 4, 15, 20), models.classifier("event", 3, 15, 20)):
        fit = models.fitted(est, df, len(NAMES))
        assert isinstance(fit, boost.Boosted) and len(fit.trees.value) == 15
        new = frame(spark, 300, 4)
        for rows in (df, new):
            mine, theirs = fit.transform(rows), est.fit(df).transform(rows)
            if "event" == est.getLabelCol():
                mine, theirs = models.probability(mine).withColumnRenamed("score", "prediction"), models.probability(theirs).withColumnRenamed("score", "prediction")
            keys = ["a", "b", "ties"]
            got, want = ({tuple(r[k] for k in keys): r.prediction for r in x.collect()} for x in (mine, theirs))
            assert got.keys() == want.keys() and [got[k] for k in got] == pytest.approx([want[k] for k in got], abs=1e-9)
    df.unpersist()


def test_split_points_are_those_of_mllib(spark):
    rng = np.random.default_rng(5)
    for x in (rng.integers(0, 70, 900), rng.normal(size=500), rng.geometric(0.05, 2000), np.repeat([1, 2], 9), np.ones(5)):
        x = x.astype(np.float32)
        values, counts = np.unique(x, return_counts=True)
        middle = (values[:-1].astype(float) + values[1:].astype(float)) / 2
        want, seen, target = [], counts[0], len(x) / 32
        for i in range(1, len(values)):
            if abs(seen - target) < abs(seen + counts[i] - target):
                want.append(middle[i - 1])
                target += len(x) / 32
            seen += counts[i]
        assert list(boost.split_points(x)) == (list(middle) if len(middle) < 32 else want)


def panel(spark, n=60):
    rng = np.random.default_rng(9)
    months = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(9)]
    rows = [(m, f"s{i:02d}", float(np.float32(x)), float(0.1 * x + rng.normal() * 0.1), float(rng.normal()) if rng.random() > 0.1 else None) for m in months for i, x in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(rows, "ym date, symbol string, x double, fwd_1 double, fwd_2 double"), months


def test_walk_forward_in_tasks_and_over_the_cluster(spark, monkeypatch):
    df, _ = panel(spark)
    make = partial(models.regressor, depth=2, rounds=3, leaf=5)
    of = lambda scored: {(r.H, r.fold, r.symbol): (r.score, r.fwd, r.ym) for r in scored.collect()}
    walk = lambda: models.walk_forward(df, ["x"], (1, 2), make, 6, 100, 10)
    scored, folds = walk()
    inside = of(scored)
    assert folds.count() == 6 and len(inside) == 6 * 60 == scored.count()
    monkeypatch.setattr(boost, "TASK_CELLS", 380)  # the largest folds are left to MLlib
    mixed, _ = walk()
    assert mixed.columns == scored.columns
    mixed = of(mixed)
    assert mixed.keys() == inside.keys()
    for k in inside:
        assert mixed[k][1:] == inside[k][1:] and mixed[k][0] == pytest.approx(inside[k][0], abs=1e-9)


def test_no_later_row_enters_a_model(spark):
    df, months = panel(spark)
    make = partial(models.regressor, depth=2, rounds=5, leaf=5)
    cut = months[7]
    later = df.withColumn("x", F.when(F.col("ym") > cut, -40.0).otherwise(F.col("x"))).withColumn("fwd_1", F.when(F.col("ym") >= cut, 9.0).otherwise(F.col("fwd_1")))
    at = lambda d: {(r.fold, r.symbol): r.score for r in models.walk_forward(d, ["x"], (1,), make, 5, 100, 10)[0].filter(F.col("ym") <= cut).collect()}
    assert at(df) == at(later) and len(at(df)) == 180


def test_work_is_dealt_evenly():
    wanted = [boost.Wanted(None, f"fwd_{h}", m, 20_000 * m) for h in (1, 2, 3) for m in range(1, 49)]
    own = boost.dealt(wanted, 8)
    assert sorted(i for o in own for i in o) == list(range(len(wanted))) and len(own) == 8
    work = [sum(wanted[i].n + boost.TREE_ROWS for i in o) for o in own]
    assert max(work) < 1.15 * min(work)
    assert boost.dealt(wanted[:1], 8) == [[0]]


class Wanted(Exception):
    pass


@pytest.mark.parametrize("name, where, depth, rounds", [
    ("h10_current_picks", "current_picks", 4, 300),
    ("h10_sector_picks", "current_picks", 3, 250),
    ("h8_walk_forward_folds", "walk_forward", 4, 300),
    ("h8_sector_walk_forward", "walk_forward", 3, 250),
    ("h7_time_split_classifier", "time_split_classifier", 4, 250),
    ("h9_auc_importance", "time_split_classifier", 4, 250),
    ("h9_permutation_importance", "fitted", 4, 300),
])
def test_registered_queries_fit_all_rounds(market, monkeypatch, name, where, depth, rounds):
    """The estimator that a query hands over has the rounds and depth of the library."""
    from catalog import all_queries, registry

    seen = []

    def stop(*given, **named):
        for x in given:
            if callable(x) and not hasattr(x, "getMaxIter"):
                x = x("y")
            if hasattr(x, "getMaxIter"):
                seen.append((x.getMaxDepth(), x.getMaxIter()))
        raise Wanted

    monkeypatch.setattr(models, where, stop)
    c = registry.Context(market.prices.sparkSession, "none")
    c.__dict__["m"] = market
    monkeypatch.setattr(registry, "context", lambda spark, sf_dir: c)
    with pytest.raises(Wanted):
        all_queries()[name](market.prices.sparkSession, "none")
    assert seen == [(depth, rounds)]


def test_surge_rows_of_fit_and_screen_are_written_once(market, monkeypatch):
    from catalog import registry, strategies
    from panelkit.plans import panels

    written, plain = [], panels.materialize
    monkeypatch.setattr(panels, "materialize", lambda df, purpose, *rest: written.append(purpose) or plain(df, purpose, *rest))
    monkeypatch.setattr(models, "time_split_classifier", lambda panel, *rest: panel)
    c = registry.Context(market.prices.sparkSession, "none")
    c.__dict__["m"] = market
    labelled, every = strategies.surge_fit(c), strategies.surge_candidates(c)
    assert written.count("surge-rows") == 1
    want = panels.surge_panel(market.prices, 40_000.0, 0.25)
    keys = lambda df: sorted((r.ym, r.symbol, r.surge) for r in df.select("ym", "symbol", "surge").collect())
    assert labelled.columns == want.columns and keys(labelled) == keys(want) and every.count() > labelled.count()
