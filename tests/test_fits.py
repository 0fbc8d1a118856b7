"""Selection by counts, walk-forward ridge, filled live rows, pick positions, spacing."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import episodes, selection
from panelkit.plans import drivers, impute, models, panels, ridge
from panelkit.plans.folds import purged_folds

FEATURES = ["a", "b", "flat"]


def months(n):
    return [dt.date(2000 + m // 12, m % 12 + 1, 1) for m in range(n)]


def panel(spark, n_months=14, n_symbols=30, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for m in months(n_months):
        for s in range(n_symbols):
            a, b = rng.normal(), rng.normal(5, 2)
            y = 0.1 * a - 0.05 * b + rng.normal() * 0.1
            rows.append((m, f"s{s:02d}", float(a) if rng.random() > 0.05 else None, float(b), 3.0, float(y), float(y) / 2 if rng.random() > 0.1 else None))
    return spark.createDataFrame(rows, "ym date, symbol string, a double, b double, flat double, fwd_1 double, fwd_2 double"), rows


# ---- selection
def test_quantiles_agree_with_numpy_and_keep_null_keys(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k in ("x", "y", None) for v in rng.integers(0, 9, 101)] + [("z", 1.0), ("none", None), ("w", 1.0), ("w", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.m for r in selection.quantiles(df, ["k"], "v", q, "m").collect()}
        assert set(got) == {"x", "y", None, "z", "w"}
        for k in got:
            assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k], q), abs=1e-12)
    every = [v for _, v in rows if v is not None]
    assert selection.medians(df, [], "v", "m").first().m == np.median(every)
    assert [r.m for r in selection.medians(df.limit(0), [], "v", "m").collect()] == [None]
    assert selection.medians(df.limit(0), ["k"], "v", "m").count() == 0


def test_a_large_group_is_split(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    want = float(np.median((np.arange(1_000_000) * 7919) % 1_000_003))
    from panelkit.operators.ranks import prefix_sums

    placed = prefix_sums(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g"], [F.col("v")], "test", before=F.col("n"))
    assert placed.filter("before < 0 or before >= 1000000").count() == 0 and placed.select("before").distinct().count() == 1_000_000
    assert selection.medians(df, ["g"], "v", "m").first().m == want
    plan = selection.medians(df, ["g"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan
    parts = df.groupBy("g", "v").count().repartitionByRange("g", "v").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 400_000


# ---- spacing
def test_spacing_of_very_many_candidates(spark):
    df = spark.range(100_000).select(F.lit("s").alias("k"), F.col("id").cast("int").alias("p"), (F.col("id") * 2).alias("x"))
    kept = episodes.greedy_spacing(df, ["k"], "p", 61)
    assert [r.p for r in kept.orderBy("p").collect()] == list(range(0, 100_000, 61))
    assert kept.columns == ["k", "p", "x"] and kept.filter("x <> 2 * p").count() == 0
    assert episodes.greedy_spacing(df.limit(0), ["k"], "p", 3).count() == 0


# ---- pick positions
def test_pick_windows_stop_at_the_ends(spark):
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    r = [0.0, 0.1, 0.3, 0.3, 0.2, 0.0]
    prices = spark.createDataFrame([("s", i + 1, d(i * 20), x, 10.0 * (i + 1)) for i, x in enumerate(r)] + [("t", 1, d(0), 9.0, 1.0)], "symbol string, pos int, date date, r1 double, value double")
    picks = prices.filter("symbol = 's' and pos in (1, 2, 6)").select("symbol", "date", "pos")
    got = {x.date: x for x in drivers.pick_windows(picks, prices, 3, 2).collect()}
    first, second, last = got[d(0)], got[d(20)], got[d(100)]
    assert (first.maxday, first.n_after, first.volspike, first.peak_month) == (0.3, 3, None, 2)
    assert second.maxday == 0.3 and second.volspike == pytest.approx(40.0 / 10.0) and second.peak_month == 2
    assert (last.maxday, last.n_after, last.peak_month) == (None, 0, None)


def test_one_window_serves_the_whole_feature_panel(market):
    for rows in (panels.feature_rows(market.prices, 40_000.0), panels.surge_rows(market.prices, 40_000.0, 0.25, 60)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        long = plan.split("BroadcastExchange")[0]
        assert "Exchange" not in long and long.count("Window [") == 1


# ---- ridge
def dense_fit(rows, h, last):
    col = 5 if h == 1 else 6
    use = [r for r in rows if r[2] is not None and r[col] is not None and r[0] <= last]
    x, y = np.array([r[2:5] for r in use]), np.array([r[col] for r in use])
    mean, sd = x.mean(0), x.std(0)
    sd[sd < 1e-9] = 0
    z = np.divide(x - mean, sd, out=np.zeros_like(x), where=sd > 0)
    w = np.linalg.solve(z.T @ z / len(z) + ridge.LAMBDA * np.eye(3), z.T @ y / len(z))
    return len(use), mean, sd, w, y.mean()


def test_every_fold_equals_a_fit_on_its_own_rows(spark):
    df, rows = panel(spark)
    fits = ridge.walk_forward_fits(df, FEATURES, (1, 2), 4, 50, 5)
    got = {(r.H, r.fold): r for r in fits.collect()}
    folds = {(h, f.fold): f for h in (1, 2) for f in purged_folds(df.dropna(subset=FEATURES), f"fwd_{h}", h, 4, 50, 5).collect()}
    assert set(got) == set(folds) and len(got) > 15
    for (h, fold), r in got.items():
        last = fold - h
        n, mean, sd, w, base = dense_fit(rows, h, dt.date((last - 1) // 12, (last - 1) % 12 + 1, 1))
        assert r.n == n and r.base == pytest.approx(base)
        assert [f.weight for f in r.features] == pytest.approx(list(w), abs=1e-9) and r.features[2].weight == 0
        assert [f.sd for f in r.features] == pytest.approx(list(sd), abs=1e-9)
    scored = ridge.scored(df, fits, FEATURES, (1, 2)).collect()
    for s in scored[:50]:
        r = got[s.H, s.fold]
        x = next(x for x in rows if x[0] == s.ym and x[1] == s.symbol)
        want = r.base + sum(f.weight * (v - f.mean) / f.sd for f, v in zip(r.features, x[2:5]) if f.sd > 0)
        assert s.score == pytest.approx(want) and s.fwd == x[4 + s.H]
    assert {(s.H, s.fold) for s in scored} == set(got)


def test_no_later_outcome_enters_a_fold(spark):
    df, _ = panel(spark)
    cut = months(14)[9]
    changed = df.withColumn("fwd_1", F.when(F.col("ym") >= cut, 99.0).otherwise(F.col("fwd_1"))).withColumn("a", F.when(F.col("ym") > cut, -50.0).otherwise(F.col("a")))
    fold = cut.year * 12 + cut.month
    of = lambda d: ridge.walk_forward_fits(d, FEATURES, (1,), 4, 50, 5).filter(F.col("fold") <= fold).orderBy("fold").collect()
    assert [r.base for r in of(df)] == [r.base for r in of(changed)] and of(df)[-1].fold == fold


def test_expected_importance_is_the_mean_over_permutations(spark):
    df, rows = panel(spark, 20, 40)
    fits, test = ridge.held_out_fit(df, FEATURES, 1, 4)
    got = {r.feature: r.importance for r in ridge.expected_importance(fits, test).collect()}
    fit = fits.first()
    t = test.collect()
    x, y = np.array([r._x for r in t]), np.array([r.y for r in t])
    assert len({r.ym for r in t}) == 4 and fit.n < len(rows)
    slope = np.array([f.weight / f.sd if f.sd else 0.0 for f in fit.features])
    base = fit.base - sum(s * f.mean for s, f in zip(slope, fit.features))
    r2 = lambda m: 1 - ((y - base - m @ slope) ** 2).mean() / y.var()
    rng = np.random.default_rng(0)
    for i, name in enumerate(FEATURES):
        falls = []
        for _ in range(400):
            z = x.copy()
            z[:, i] = rng.permutation(z[:, i])
            falls.append(r2(x) - r2(z))
        assert got[name] == pytest.approx(np.mean(falls), abs=0.05)


def test_ridge_of_nothing(spark):
    df, _ = panel(spark)
    assert ridge.walk_forward_fits(df.limit(0), FEATURES, (1,), 4, 50, 5).count() == 0
    assert ridge.walk_forward_fits(df, FEATURES, (1,), 4, 10**6, 5).count() == 0


# ---- filled live rows
def test_no_later_month_enters_a_median_and_no_candidate_is_lost(spark):
    df, rows = panel(spark)
    at = months(14)[10]
    live = impute.live_rows(df, FEATURES, (1, 2), F.lit(at))
    medians = {(r.H, r.feature): r.median for r in impute.fitted_medians(live, FEATURES).collect()}
    for h in (1, 2):
        use = [r for r in rows if r[0] <= months(14)[10 - h] and r[4 + h] is not None]
        assert medians[h, "a"] == pytest.approx(np.median([r[2] for r in use if r[2] is not None]))
    later = df.withColumn("a", F.when(F.col("ym") >= at, 1000.0 + F.col("a")).otherwise(F.col("a")))
    again = {(r.H, r.feature): r.median for r in impute.fitted_medians(impute.live_rows(later, FEATURES, (1, 2), F.lit(at)), FEATURES).collect()}
    assert medians == again
    done = impute.filled(live, impute.fitted_medians(live, FEATURES), FEATURES)
    now = [r for r in rows if r[0] == at]
    got = done.filter("not is_train").collect()
    assert len(got) == 2 * len(now) and all(None not in (r.a, r.b, r.flat) for r in got)
    assert sum(r.a_missing for r in got) == 2 * sum(r[2] is None for r in now)
    counts = {r.H: r for r in impute.candidate_counts(live, FEATURES, 5, 200).collect()}
    assert counts[1].n_candidates == len(now) and counts[1].n_incomplete == sum(r[2] is None for r in now) and counts[1].sufficient
    assert not impute.candidate_counts(live, FEATURES, 5, 10**6).first().sufficient


def test_a_feature_that_training_never_has_is_filled_with_zero(spark):
    df, _ = panel(spark)
    live = impute.live_rows(df.withColumn("a", F.lit(None).cast("double")), FEATURES, (1,))
    done = impute.filled(live, impute.fitted_medians(live, FEATURES), FEATURES)
    assert done.filter("a <> 0 or a_missing <> 1").count() == 0 and done.count() == live.count()


def test_live_picks_keep_names_with_gaps(spark):
    df, _ = panel(spark)
    at = df.select(F.max("ym")).first()[0]
    # the best candidate of the last month has no value of the other feature
    df = df.withColumn("b", F.when((F.col("ym") == at) & (F.col("symbol") == "s07"), None).otherwise(F.col("b"))).withColumn("a", F.when((F.col("ym") == at) & (F.col("symbol") == "s07"), 4.0).otherwise(F.col("a")))
    make = lambda label: models.regressor(label, depth=2, rounds=5, leaf=5)
    picks = impute.live_picks(df, FEATURES, (1, 2), make, 5).collect()
    assert {r.H for r in picks} == {1, 2} and all(r.ym == at for r in picks)
    assert len(picks) == 10 and any(r.symbol == "s07" for r in picks)
    assert impute.live_picks(df, FEATURES, (1,), make, 5, min_train=10**6).count() == 0


# ---- events and marks
def test_equal_events_with_different_keys_stay_apart(spark):
    from panelkit.operators import eventstudy

    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    market = spark.createDataFrame([(d(i), 0.01) for i in range(120)], "date date, mkt_r double")
    events = spark.createDataFrame([(1, d(50), "shock", "x", "a"), (1, d(50), "shock", "x", "b"), (2, d(50), "shock", "x", "a")], "id int, date date, type string, title string, sector string")
    assert eventstudy.shock_response(events, market, ["shock"]).count() == 1
    assert eventstudy.shock_response(events, market, ["shock"], key="id").count() == 2


def test_marks_as_of_a_date(spark):
    from panelkit.plans import rules

    prices = spark.createDataFrame([("s", dt.date(2020, m, 1), 0.1 * m, 10.0 * m) for m in (1, 2, 3)], "symbol string, date date, cumlog double, close double")
    picks = spark.createDataFrame([("s", dt.date(2020, 1, 1))], "symbol string, entry_date date")
    row = rules.mark_to_latest(picks, prices, as_of="2020-02-15").first()
    assert (row.as_of, row.last_close) == (dt.date(2020, 2, 1), 20.0) and row.ret == pytest.approx(np.expm1(0.1))
    assert rules.mark_to_latest(picks, prices).first().as_of == dt.date(2020, 3, 1)


def test_pairs_of_symbols_are_refused(spark):
    from panelkit.operators import corr

    df = spark.range(600).select(F.lit("2020-01-01").cast("date").alias("ym"), F.col("id").cast("string").alias("sector"), F.lit(0.1).alias("ret"))
    for fn in (corr.cross_sector_corr, corr.lead_lag):
        with pytest.raises(ValueError, match="taxonomy"):
            fn(df)
    assert corr.lead_lag(df.filter("sector < '2'")).count() == 0
