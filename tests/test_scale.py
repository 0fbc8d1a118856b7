"""What grows with the panel: frames of sampled rows, medians, buckets, pick windows."""

import datetime as dt
import glob
import threading
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.registry import MIN_ADV
from panelkit.functions import rolling as R
from panelkit.operators import baskets, frames, selection
from panelkit.operators.trend import market_momentum
from panelkit.plans import drivers, market as market_plan, models, panels, report, views
from panelkit.sources import sinks


def test_pick_windows_copy_no_rows(spark):
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    values = [10.0, None, 30.0, 40.0]
    prices = spark.createDataFrame([("s", i + 1, d(i), 0.1 * i if i != 2 else None, v) for i, v in enumerate(values)], "symbol string, pos int, date date, r1 double, value double")
    out = drivers.pick_windows(prices.select("symbol", "date", "pos"), prices, 2, 2)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x.date: (x.maxday, x.volspike, x.n_after) for x in out.collect()}
    assert got[d(0)] == (0.1, None, 2) and got[d(1)] == (pytest.approx(0.3), pytest.approx(3.5), 2)
    assert got[d(2)] == (pytest.approx(0.3), pytest.approx(4.0), 1) and got[d(3)] == (None, None, 0)


def test_frames_of_a_history_equal_sliding_frames(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i + 1, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if s == "gaps" and rng.random() < 0.3 else 0.1 if s == "flat" else float(rng.normal())) for s in ("gaps", "full", "flat") for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, pos int, date date, x double")
    w = R.symbol_window()
    names = {"mean": F.avg, "sd": F.stddev_samp, "top": F.max}
    want = df.withColumns({f"want_{n}": R.rolling(f, "x", 12, 9, w) for n, f in names.items()})
    both = want.join(R.histories(df, {"_x": F.col("x")}), "symbol").withColumn("_f", R.last_of("_x", 12)).withColumn("_a", R.array_mean(F.col("_f")))
    got = both.select(
        "*", R.filled_frame(R.array_mean, "_f", 9).alias("mean"), R.filled_frame(lambda x: R.array_deviation(x, F.col("_a")), "_f", 9).alias("sd"),
        R.filled_frame(F.array_max, "_f", 9).alias("top"),
    ).collect()
    assert sum(r.mean is None for r in got) > 24
    for r in got:
        for n in names:
            assert (r[n] is None and r[f"want_{n}"] is None) or r[n] == pytest.approx(r[f"want_{n}"], rel=1e-12)
    assert {r.sd for r in got if r.symbol == "flat"} == {None, 0.0}


def test_month_end_features_equal_the_daily_ones(market):
    context = market_momentum(baskets.market_index(market.prices, MIN_ADV), 63, "mkt_mom_3m").select("date", "mkt_r", "mkt_mom_3m")
    names = ["mom_12m", "rev_1w", "vol_1m", "vol_3m", "dist_252h", "dist_20h", "dist_6mlow", "dd_6m", "maxup_1m", "upday_frac", "amihud", "beta_60", "vol_ratio", "mom_accel"]
    shown = lambda df: df.select("symbol", "date", *[F.round(F.col(c) * (1e6 if c == "amihud" else 1), 8).alias(c) for c in names])
    rows = panels.feature_rows(market.prices, MIN_ADV)
    assert "stddev_samp" not in rows._jdf.queryExecution().optimizedPlan().toString()
    want = shown(panels.symbol_features(market.prices, context).filter("is_month_end")).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    got = shown(rows).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    assert len(got) == len(want) and (got[["symbol", "date"]] == want[["symbol", "date"]]).all().all()
    for c in names:
        assert (got[c].isna() == want[c].isna()).all() and np.allclose(got[c].dropna(), want[c].dropna(), rtol=1e-6, atol=2e-8), c


def test_bins_follow_the_order_of_values(spark):
    values = [float("-inf"), -1e308, -2.0, -1.0, -1e-300, -5e-324, 0.0, 5e-324, 1e-9, 1.0, 1.005, 2.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r.b for r in df.orderBy("v").select(selection.value_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins) and bins[-1] > bins[-2] and len(set(bins)) >= 11


def test_only_rows_near_the_middle_are_ranked(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = {g: rng.normal(1.0, 2.0, 20_001) for g in ("a", "b")}
    df = spark.createDataFrame([(g, float(v)) for g in x for v in x[g]], "g string, v double")
    seen, plain = [], selection.prefix_sums

    def counting(rows, *args, **kwargs):
        seen.append(rows.count())
        return plain(rows, *args, **kwargs)

    monkeypatch.setattr(selection, "prefix_sums", counting)
    assert {r.g: r.m for r in selection.medians(df, ["g"], "v", "m").collect()} == {g: np.median(x[g]) for g in x}
    assert sum(seen) < 2_000


def test_buckets_grow_with_the_lines(spark, sf_dir, monkeypatch):
    lines = views.table(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(market_plan, "LINES_PER_BUCKET", 200)
    assert market_plan.from_tables(spark, sf_dir, MIN_ADV, None).buckets == -(-lines // 200) > 8


def test_sections_are_planned_and_written_side_by_side(monkeypatch):
    meet = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(sinks, "write_counted", lambda df, path, fmt: {"rows": df, "place": meet.wait()})
    assert {n: w["rows"] for n, w in sinks.write_bundle({"a": 1, "b": 2}, "nowhere").items()} == {"a": 1, "b": 2}

    class Shared:
        built = []

        def __getattr__(self, name):
            self.built.append(name)

    def group(name):
        assert "panel" in Shared.built
        meet.wait()
        return {name: name}

    assert list(report.side_by_side(Shared(), [lambda: group("a"), lambda: group("b")])) == ["a", "b"]


def test_surge_rows_are_written_once(market, monkeypatch):
    written, plain = [], panels.materialize
    monkeypatch.setattr(panels, "materialize", lambda df, purpose, *rest: written.append(purpose) or plain(df, purpose, *rest))
    plan = panels.surge_panel(market.prices, MIN_ADV, 0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(written) == ["daily-moves", "surge-rows"] and "collect_list" not in plan


def test_statistics_of_month_ends(spark):
    rng = np.random.default_rng(7)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=2 * i)
    x = {s: [None if s == "gaps" and rng.random() < 0.3 else 0.1 if s == "flat" else float(rng.normal()) for _ in range(60)] for s in ("gaps", "full", "flat", "none")}
    x["none"] = [None] * 60
    df = spark.createDataFrame([(s, i + 1, day(i), v) for s in x for i, v in enumerate(x[s])], "symbol string, pos int, date date, x double")
    wanted = {"sd": ("deviation", "_x", 12, 9), "top": ("top", "_x", 40, 1), "low": ("low", "_x", 40, 1), "mean": ("mean", "_x", 12, 9), "mid": ("median", "_x", 12, 9)}
    got = frames.at_rows(df, frames.month_end_statistics(df.repartition(3), {"_x": F.col("x")}, wanted)).collect()
    ends = [i for i in range(60) if i == 59 or day(i).month != day(i + 1).month]
    plain = {"sd": lambda v: np.std(v, ddof=1) if min(v) < max(v) else 0.0, "top": max, "low": min, "mean": np.mean, "mid": np.median}
    assert len(got) == 240
    for r in got:
        for name, (_, _, n, least) in wanted.items():
            seen = [v for v in x[r.symbol][max(0, r.pos - n):r.pos] if v is not None]
            if r.pos - 1 not in ends or len(seen) < least:
                assert r[name] is None
            else:
                assert r[name] == pytest.approx(plain[name](seen), rel=1e-12)


def test_rows_of_one_month_end_date_all_have_statistics(spark):
    d = dt.date(2020, 1, 31)
    df = spark.createDataFrame([("s", 1, d, 1.0), ("s", 2, d, 3.0), ("s", 3, dt.date(2020, 2, 3), 5.0)], "symbol string, pos int, date date, x double")
    got = frames.at_rows(df, frames.month_end_statistics(df, {"_x": F.col("x")}, {"top": ("top", "_x", 5, 1)})).collect()
    assert {r.pos: r.top for r in got} == {1: 1.0, 2: 3.0, 3: 5.0}


def test_no_daily_history_is_gathered_for_the_panel(market):
    plan = panels.feature_rows(market.prices, MIN_ADV)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_training_files_do_not_grow_with_the_parts_of_the_panel(spark, tmp_path, monkeypatch):
    months = [dt.date(2020, 1 + m, 1) for m in range(6)]
    rows = [(m, f"s{i:03d}", float(i), float(i % 7)) for m in months for i in range(120)]
    panel = spark.createDataFrame(rows, "ym date, symbol string, x double, fwd_1 double").repartition(24)
    where = lambda spark, purpose: str(tmp_path / purpose)
    monkeypatch.setattr(models, "shared_dir", where)
    scored, folds = models.walk_forward(panel, ["x"], (1,), partial(models.regressor, depth=1, rounds=1, leaf=5), 3, 100, 10)
    files = glob.glob(str(tmp_path / "train" / "*" / "*.parquet"))
    assert len(files) <= 6 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert folds.count() == 3 and scored.count() == 360
