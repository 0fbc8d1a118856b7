"""Hand-computed toy panels for the rules that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelkit.functions import rolling as R
from panelkit.functions import scalar as X
from panelkit.functions import stats as S
from panelkit.operators import asof, clean, corr, dims, episodes, eventstudy, months, text, trend
from panelkit.operators import xsection
from panelkit.plans import evaluate, panels

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def series(spark, values, name="x"):
    return spark.createDataFrame([(day(i), v) for i, v in enumerate(values)], f"date date, {name} double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (9.0,), (-5.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(X.clip("x", -1, 1)).collect()] == [None, 1.0, -1.0, 0.5]


def test_band_edges_differ(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (40.0,), (100.0,)], "x double")
    rows = df.select(X.mood_label("x"), X.mood_band("x")).collect()
    assert [r[0] for r in rows] == ["Extreme Fear", "Fear", "Neutral", "Extreme Greed"]
    assert [r[1] for r in rows] == ["Extreme Fear", "Extreme Fear", "Fear", "Extreme Greed"]


def test_sign_agreement_ignores_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, -2.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(X.same_sign("a", "b")).collect()] == [True, False, None, None]


def test_rolling_needs_minimum_of_non_null(spark):
    df = series(spark, [1.0, None, 3.0, 5.0])
    framed = df.withColumn("v", R.frame_values("x", 3, R.series_window()))
    out = column(R.add_medians(framed, {"m": ("v", 2)}), "m")
    assert out == [None, None, 2.0, 4.0]


def test_trend_flag_is_zero_before_a_full_window(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    assert column(df.withColumn("f", R.ma_flag("x", 3, R.series_window())), "f") == [0.0, 0.0, 1.0]


def test_percentile_rank_counts_missing_rows(spark):
    df = series(spark, [None, 1.0, 2.0, None])
    out = column(df.withColumn("p", R.trailing_pct_rank("x", 4, 2, R.series_window())), "p")
    assert out[:2] == [None, None]
    assert out[2] == pytest.approx(200 / 3)  # two of three rows, the missing one counts
    assert out[3] == 0.0


def test_pct_change_pads_gaps_and_diff_does_not(spark):
    df = series(spark, [100.0, None, 110.0])
    w = R.series_window()
    df = df.withColumn("p", R.padded("x", w)).select("date", R.pct_change("p", 1, w).alias("c"), R.change("x", 1, w).alias("d"))
    assert column(df, "c") == [None, 0.0, pytest.approx(0.1)]
    assert column(df, "d") == [None, None, None]


def test_empty_sector_month_is_zero(spark):
    rows = [(dt.date(2020, 1, 5), "a", 0.1), (dt.date(2020, 2, 5), "b", 0.2)]
    out = months.monthly_sectors(spark.createDataFrame(rows, "date date, sector string, r double"))
    got = {(r["ym"].month, r["sector"]): round(r["ret"], 9) for r in out.collect()}
    assert got == {(1, "a"): 0.1, (2, "a"): 0.0, (1, "b"): 0.0, (2, "b"): 0.2}


def test_timed_return_lags_and_pays_for_switches(spark):
    df = series(spark, [0.01, 0.02, 0.03], "mkt_r").withColumn("s", F.lit(1.0))
    out = column(trend.timed_returns(df, "s", cost=0.003, cash_annual=0.0), "ret")
    assert out == [0.0, pytest.approx(0.02 - 0.003), pytest.approx(0.03)]


def test_drawdown_and_multiple(spark):
    df = series(spark, [0.1, -0.5, 0.2], "ret").withColumn("k", F.lit(1))
    row = trend.perf_stats(df, ["k"], ppy=3).collect()[0]
    assert row["max_dd"] == pytest.approx(-0.5)
    assert row["cagr"] == pytest.approx(1.1 * 0.5 * 1.2 - 1)


def test_asof_both_ways_and_early_fill(spark):
    steps = spark.createDataFrame([(day(2), 1.0), (day(5), 2.0)], "date date, v double")
    pts = spark.createDataFrame([(day(i),) for i in range(7)], "date date")
    assert column(asof.backward_asof(pts, steps, "v"), "v") == [None, None, 1.0, 1.0, 1.0, 2.0, 2.0]
    assert column(asof.backward_asof(pts, steps, "v", fill_early=True), "v") == [1.0] * 5 + [2.0] * 2
    assert column(asof.forward_asof(pts, steps, "v"), "v") == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0, None]


def test_latest_per_date_keeps_the_later_decision(spark):
    steps = spark.createDataFrame([(day(0), 5.0, 1), (day(0), 4.0, 2)], "date date, rate double, seq int")
    assert asof.latest_per_date(steps, "rate", "seq").collect()[0]["rate"] == 4.0


def test_event_window_outside_calendar_is_null_and_missing_days_count_zero(spark):
    days = eventstudy.trading_days(series(spark, [0.0] * 30, "mkt_r"))
    abn = spark.createDataFrame([(day(10), "a", 0.5), (day(12), "a", None)], "date date, sector string, abn double")
    ev = spark.createDataFrame([(day(10), "t", "x", "a", 1.0), (day(2), "t", "y", "a", 1.0), (day(10), "t", "z", "b", 1.0)], "date date, type string, title string, sector string, expected_sign double")
    got = {r["title"]: r for r in eventstudy.event_study(ev, abn, days).collect()}
    assert (got["x"]["pre"], got["x"]["event"], got["x"]["post"]) == (0.0, 0.5, 0.0)
    assert got["x"]["drift"] is None or got["x"]["drift"] == 0.0
    assert got["y"]["pre"] is None and got["y"]["event"] == 0.0
    assert got["z"]["event"] is None  # no basket of that name


def test_greedy_spacing_skips_until_the_gap(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 3, 21, 22, 23, 50)], "k string, p int")
    kept = [r["p"] for r in episodes.greedy_spacing(df, ["k"], "p", 21).orderBy("p").collect()]
    assert kept == [1, 22, 50]


def test_episode_forward_move_stops_at_the_end(spark):
    level = [0.0] * 25 + [0.5, 0.6]
    rows = [("s", "x", day(i), c, 1e9) for i, c in enumerate(level)]
    p = spark.createDataFrame(rows, "symbol string, sector_name string, date date, cumlog double, adv_20 double")
    ep = episodes.surge_episodes(p, 0.25, 20, 1.0).collect()
    assert len(ep) == 1 and ep[0]["date"] == day(25)
    assert ep[0]["fwd"] == pytest.approx(math.expm1(0.1))


def test_forward_label_needs_the_calendar_month(spark):
    rows = [("a", dt.date(2020, m, 10), c) for m, c in ((1, 0.0), (2, 0.1), (4, 0.3))] + [("b", dt.date(2020, m, 10), 0.0) for m in (1, 2, 3, 4)]
    ends = panels.month_end_rows(spark.createDataFrame(rows, "symbol string, date date, cumlog double"))
    out = panels.forward_labels(ends, ends).filter("symbol = 'a'").orderBy("ym").collect()
    assert [r["fwd_1"] for r in out] == [pytest.approx(math.expm1(0.1)), None, None]  # March is absent for a
    assert [r["fwd_2"] for r in out] == [None, pytest.approx(math.expm1(0.2)), None]


def test_correlation_needs_eight_pairs_and_variance(spark):
    rows = [("ok", float(i), 2.0 * i) for i in range(8)] + [("few", 1.0, 2.0)] + [("flat", float(i), 1.0) for i in range(9)]
    out = S.corr_table(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()
    assert [(r["k"], round(r["corr"], 6), r["n"]) for r in out] == [("ok", 1.0, 8)]


def test_average_ranks_and_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 1.0), (1, 2.0, 0.0), (1, 3.0, 1.0)], "g int, x double, y double")
    from panelkit.operators import ranks

    out = sorted(r["r"] for r in ranks.averaged(df, ["g"], {"x": "r"}).collect())
    assert out == [1.0, 2.5, 2.5, 4.0]
    assert xsection.auc(df, "x", "y").collect()[0]["auc"] == pytest.approx(0.875)


def test_top_k_over_scored_rows_universe_over_outcomes(spark):
    rows = [(1, D0, f"s{i:02d}", float(i), 0.01 * i if i < 11 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "H int, ym date, symbol string, score double, fwd double")
    r = evaluate.scored_months(df, k=3, min_extra=5).collect()[0]
    assert r["top"] == pytest.approx((0.10 + 0.09) / 2)  # the best-scored row has no outcome
    assert r["uni"] == pytest.approx(0.05)
    assert r["prec"] == pytest.approx(2 / 3)


def test_volatility_match_is_null_when_the_universe_lost(spark):
    legs = spark.createDataFrame([(1, leg, day(31 * i), r + 0.01 * (i % 2)) for leg, r in (("top", 0.02), ("universe", 0.01), ("bottom", 0.0)) for i in range(6)], "H int, leg string, ym date, ret double")
    won = evaluate.volatility_matched(evaluate.leg_perf(legs), legs).collect()[0]
    assert won["lever_to_uni_vol"] == pytest.approx(1.0, rel=1e-6) and won["beats_universe"]
    lost = legs.withColumn("ret", F.col("ret") - F.when(F.col("leg") == "universe", 0.05).otherwise(0.0))
    assert evaluate.volatility_matched(evaluate.leg_perf(lost), lost).collect()[0]["lever_to_uni_vol"] is None


def test_equity_filter(spark):
    rows = [("ABC", "Abc", 1.0), ("ABC-JAN", "x", 1.0), ("ABCR1", "x", 1.0), ("ABCR", "Abc (R)", 1.0), ("TWOR", "Two", 1.0), ("P05X", "x", 1.0), ("XTFC1", "x", 1.0), ("ABD", "x", 0.0)]
    kept = clean.drop_non_equity(spark.createDataFrame(rows, "symbol string, name string, ldcp double"))
    assert sorted(r["symbol"] for r in kept.collect()) == ["ABC", "TWOR"]


def test_sector_lookup_and_flags(spark):
    dim = dims.standard_sectors(spark)
    got = {r["code"]: r for r in dim.collect()}
    assert len(got) == 38 and got["0837"]["is_equity"] and not got["0837"]["is_operating"]
    out = dims.add_sector(spark.createDataFrame([(" 0804 ",), ("99",)], "sector string"), dim).collect()
    assert {(r["sector_name"], r["is_equity"]) for r in out} == {("Cement", True), ("[99]", False)}


def test_headline_links_are_word_prefixes(spark):
    from panelkit.functions import fixed_values as fv

    rows = [("Cement dispatches rise; e&p names flat",), ("replacement of nothing",), ("Écement",)]
    out = text.link_sectors(spark.createDataFrame(rows, "headline string"), fv.SECTOR_KEYWORDS)
    assert [sorted(r["linked"]) for r in out.collect()] == [["Cement", "Oil & Gas Exploration"], [], []]


def test_macro_lag_moves_the_sector_side(spark):
    ms = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(20)]
    xs = [((i * 7) % 5) / 10 for i in range(20)]
    deltas = spark.createDataFrame([(m, *([x] * 6)) for m, x in zip(ms, xs)], "ym date, " + ", ".join(f"{c} double" for c in corr.DELTAS))
    sector = spark.createDataFrame([(ms[i + 1], "a", xs[i]) for i in range(19)], "ym date, sector string, ret double")
    assert corr.sector_macro_corr(sector, deltas, lag=1).filter("factor = 'oil_ret'").collect()[0]["corr"] == pytest.approx(1.0)


# ---- corrections of round 1
def test_later_decision_of_a_date_holds(spark):
    steps = spark.createDataFrame([("2020-01-02", 9.0, 1), ("2020-01-02", 8.0, 2)], "d string, rate double, seq int").selectExpr("cast(d as date) as date", "rate", "seq")
    asked = spark.sql("select date'2020-01-05' as date")
    assert asof.backward_asof(asked, steps, "rate", order="seq").first()["rate"] == 8.0
    assert asof.forward_asof(spark.sql("select date'2020-01-01' as date"), steps, "rate", order="seq").first()["rate"] == 8.0
    with pytest.raises(Exception, match="several values of rate"):
        asof.backward_asof(asked, steps, "rate").collect()
    same = steps.withColumn("rate", F.lit(9.0))
    assert asof.backward_asof(asked, same, "rate").first()["rate"] == 9.0


def test_total_loss_stays_lost(spark):
    from panelkit.functions import stats
    from panelkit.operators import trend

    df = spark.createDataFrame([("a", i, r) for i, r in enumerate([0.1, -1.0, 0.1])] + [("b", 0, None), ("c", 0, -0.5), ("c", 1, 1.0)], "k string, date int, ret double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(stats.multiple("ret").alias("m")).collect()}
    assert got["a"] == 0.0 and got["b"] is None and got["c"] == pytest.approx(1.0)
    rows = trend.drawdowns(df.filter("ret is not null"), ["k"]).orderBy("k", "date").collect()
    assert [round(r["equity"], 9) for r in rows] == [1.1, 0.0, 0.0, 0.5, 1.0] and [r["drawdown"] for r in rows][:3] == [0.0, -1.0, -1.0]


def test_prefix_sums_split_a_constant_group_and_a_heavy_value(spark):
    from panelkit.operators import ranks

    rows = [("flat", 1.0)] * 500 + [("heavy", 2.0)] * 400 + [("heavy", float(i)) for i in range(100)] + [("wide", i / 7) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = ranks.averaged(df, ["g"], {"x": "r"}).toPandas()
    want = got.groupby("g")["x"].rank()
    assert len(got) == len(rows) and (got["r"] == want).all()
    parts = ranks.prefix_sums(df.groupBy("g", "x").count(), ["g"], [F.col("x")], "t", before=F.col("count"))
    assert parts.count() == 1 + 100 + 900


def test_shared_location_is_required_beyond_one_process(monkeypatch):
    from panelkit import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(), "x")


def test_release_leaves_nothing_behind(spark):
    import os

    from panelkit import session

    held = session._written.pop(spark.sparkContext.applicationId, [])
    try:
        a = session.materialize(spark.range(5).toDF("k"), "gone", "k", ())
        assert a.count() == 5
        path, name = session._written[spark.sparkContext.applicationId][-1]
        assert session.release(spark) == 2 and not os.path.exists(path) and not spark.catalog.tableExists(name)
    finally:
        session._written[spark.sparkContext.applicationId] = held
