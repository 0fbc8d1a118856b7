"""Properties on the derived tables: no look-ahead, brute-force agreement, purging."""

import bisect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.registry import MIN_ADV
from panelkit.functions import fixed_values as fv
from panelkit.operators import asof, baskets, episodes, ranks
from panelkit.operators import xsection as X
from panelkit.plans import folds, models, panels, rules


def test_features_ignore_later_rows(market):
    cut = "1998-06-15"
    ctx = baskets.market_index(market.prices, MIN_ADV)
    cols = ["symbol", "date", "mom_3m", "vol_3m", "dist_252h", "beta_60", "amihud", "upday_frac"]
    full = panels.symbol_features(market.prices, ctx).filter(F.col("date") <= cut).select(cols)
    early = market.prices.filter(F.col("date") <= cut)
    short = panels.symbol_features(early, baskets.market_index(early, MIN_ADV)).select(cols)
    r6 = [F.round(c, 6).alias(c) for c in cols[2:]]
    assert full.select("symbol", "date", *r6).exceptAll(short.select("symbol", "date", *r6)).count() == 0


def test_asof_equals_brute_force(market):
    rates = sorted((r["date"], r["rate"]) for r in market.rates.collect())
    dates = [d for d, _ in rates]
    got = asof.backward_asof(market.market.select("date"), market.rates.select("date", "rate"), "rate").collect()
    for r in got:
        i = bisect.bisect_right(dates, r["date"])
        assert r["rate"] == (rates[i - 1][1] if i else None)


def test_episodes_never_overlap(market):
    pos = market.prices.filter(F.col("adv_20") > MIN_ADV).select("symbol", "date").toPandas().sort_values(["symbol", "date"])
    pos["pos"] = pos.groupby("symbol").cumcount()
    ep = episodes.surge_episodes(market.prices, 0.25, 20, MIN_ADV).toPandas().merge(pos, on=["symbol", "date"])
    gaps = ep.sort_values(["symbol", "pos"]).groupby("symbol")["pos"].diff().dropna()
    assert len(gaps) and gaps.min() >= 21


def test_split_ranks_equal_pandas(market):
    pdf = market.panel.select("ym", "symbol", "amihud", "upday_frac", "mom_3m").toPandas()
    for c in ("amihud", "upday_frac", "mom_3m"):
        df = market.panel.filter(F.col(c).isNotNull()).select("ym", "symbol", F.round(c, 12).alias("x"))
        got = ranks.averaged(df, ["ym"], {"x": "r"}).toPandas().merge(pdf, on=["ym", "symbol"])
        want = got["x"].groupby(got["ym"]).rank()
        assert (got["r"] == want).all()


def test_first_come_ranks_are_a_permutation(market):
    df = market.panel.filter("upday_frac is not null").select("ym", "symbol", "upday_frac")
    out = ranks.first_come(df, ["ym"], "upday_frac", "symbol").toPandas()
    for _, g in out.groupby("ym"):
        assert sorted(g["rank_up"]) == list(range(1, len(g) + 1)) == sorted(g["rank_down"])


def test_rank_ic_matches_pandas_spearman(market):
    one = X.spearman(market.eligible.select("ym", "mom_3m", "fwd_1"), ["ym"], "mom_3m", "fwd_1").toPandas().set_index("ym")["ic"]
    pdf = market.eligible.select("ym", "mom_3m", "fwd_1").toPandas().dropna()
    for ym, g in pdf.groupby("ym"):
        if len(g) > 3:
            a, b = g["mom_3m"].rank(), g["fwd_1"].rank()
            assert one[ym] == pytest.approx(a.corr(b), abs=1e-9)


def test_folds_are_purged(market):
    p = market.eligible.dropna(subset=fv.PANEL_FEATURES)
    for h in (1, 2, 3):
        out = folds.purged_folds(p, f"fwd_{h}", h, 12, 50, 5).collect()
        assert out and all(r["last_train"] <= r["fold"] - h for r in out)


def test_embargoed_split_keeps_labels_apart(market):
    train, test = models.embargoed_split(market.eligible, "fwd_2", 2, 12)
    last, first = train.agg(F.max("ym")).collect()[0][0], test.agg(F.min("ym")).collect()[0][0]
    assert pd.Period(last, "M") + 2 < pd.Period(first, "M")


def test_shuffle_permutes_one_feature_only(spark, market):
    rows = market.eligible.dropna(subset=["mom_3m", "vol_3m"]).select("ym", "symbol", "mom_3m", "vol_3m")
    out = models.shuffled_copies(rows, ["mom_3m", "vol_3m"], 1, ["ym", "symbol"], parts=4)
    src = rows.toPandas()
    got = out.filter("feature = 'mom_3m'").toPandas()
    assert len(got) == len(src)
    assert sorted(got["mom_3m"]) == sorted(src["mom_3m"])
    both = got.merge(src, on=["ym", "symbol"])
    assert (both["vol_3m_x"] == both["vol_3m_y"]).all() and (both["mom_3m_x"] != both["mom_3m_y"]).mean() > 0.9


def test_picks_are_deterministic(market):
    pick = lambda: [(r["symbol"], r["rank"]) for r in rules.picks_for(market.panel, market.market, "1999-06-01").orderBy("rank").collect()]
    assert pick() == pick() and len(pick()) == 5


def test_windows_on_the_written_panel_need_no_exchange(market):
    plan = panels.symbol_features(market.prices, baskets.market_index(market.prices, MIN_ADV))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in main and main.count("Window [") == 1


def test_rank_ic_with_shared_and_own_sets_of_labels(spark):
    """Complete features, two that miss the same rows, one that misses others, a constant;
    labels and values with ties."""
    rng = np.random.default_rng(8)
    n = 7 * 30
    pdf = pd.DataFrame({"ym": np.repeat(np.arange(7), 30), "y": rng.integers(0, 9, n) / 4.0, "a": rng.integers(0, 12, n) / 3.0, "b": rng.normal(size=n), "c": rng.normal(size=n), "d": rng.normal(size=n), "e": rng.normal(size=n), "same": 1.0})
    pdf.loc[pdf.index % 3 == 0, ["c", "d"]] = None
    pdf.loc[pdf.index % 3 == 1, "e"] = None
    pdf.loc[pdf.index % 10 == 0, "y"] = None
    names = ["a", "b", "c", "d", "e", "same"]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    df = spark.createDataFrame(rows, "ym int, y double, a double, b double, c double, d double, e double, same double")
    got = {r.feature: (r.mean_ic, r.hit, r.n_months) for r in X.rank_ic(df, names, "y").collect()}
    assert set(got) == set(names) - {"same"}
    for f in got:
        ics = [g[f].rank().corr(g["y"].rank()) for _, g in pdf.dropna(subset=[f, "y"]).groupby("ym")]
        assert got[f][2] == 7 and np.isclose(got[f][0], np.mean(ics), atol=1e-12) and np.isclose(got[f][1], np.mean(np.array(ics) > 0))
