"""Readers, sinks, and the resume-safe ingest, on files written by the tests."""

import datetime as dt
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from panelkit.sources import context as ctx
from panelkit.sources import feeds, sinks
from panelkit.streaming.ingest import ingest_new, staged_panel

LINE = "05JAN2020| AAA |0804|Aaa Ltd|1|2|1|{close}|{volume}|10.0|extra"


@pytest.fixture
def archives(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    lines = [LINE.format(close="11.0", volume="100"), "too|short", LINE.format(close="", volume="1").replace("AAA", "BBB"), LINE.format(close="0", volume="1").replace("AAA", "CCC")]
    (folder / "2020-01-05.Z").write_bytes(gzip.compress("\n".join(lines).encode()))
    with zipfile.ZipFile(folder / "2020-01-06.Z", "w") as z:
        z.writestr("note.txt", "no feed")
        z.writestr("CLOSE.LIS", LINE.format(close="12.5", volume="x") + "\r\n" + LINE.format(close="3", volume="7").replace("AAA", "DDD\xff"))
    (folder / "2020-01-07.Z").write_bytes(b"neither of both")
    (folder / "2020-01-08.Z").write_bytes(gzip.compress(b"cut short")[:12])
    return str(folder)


def test_archives_to_panel(spark, archives):
    rows = {r["symbol"]: r for r in feeds.parse_feed(feeds.read_archives(spark, archives)).collect()}
    assert rows["AAA"]["close"] == 12.5 and rows["AAA"]["volume"] == 0  # the later file wins
    assert rows["AAA"]["date"] == dt.date(2020, 1, 5) and rows["AAA"]["ldcp"] == 10.0
    assert len(rows) == 2 and {s[:3] for s in rows} == {"AAA", "DDD"}


def test_bad_date_is_an_error(spark):
    df = spark.createDataFrame([("f", 0, LINE.format(close="1", volume="1").replace("JAN", "XXX"))], feeds.LINES_SCHEMA)
    with pytest.raises(Exception):
        feeds.type_feed(feeds.split_feed_lines(df)).collect()


def test_ingest_resumes(spark, archives, tmp_path):
    staged, checkpoint = str(tmp_path / "staged"), str(tmp_path / "checkpoint")
    ingest_new(spark, archives, staged, checkpoint, max_files=1)
    first = staged_panel(spark, staged).count()
    ingest_new(spark, archives, staged, checkpoint)
    assert staged_panel(spark, staged).count() == first == 2
    (tmp_path / "raw" / "2020-01-09.Z").write_bytes(gzip.compress(LINE.format(close="15", volume="5").encode()))
    ingest_new(spark, archives, staged, checkpoint)
    rows = {r["symbol"]: r["close"] for r in staged_panel(spark, staged).collect()}
    assert rows["AAA"] == 15.0 and len(rows) == 2


def test_missing_days(spark):
    day = lambda s: F.lit(s).cast("date")
    held = spark.createDataFrame([(dt.date(2020, 1, 6),)], "date date")
    holidays = spark.createDataFrame([(dt.date(2020, 1, 8),)], "date date")
    out = feeds.missing_trading_days(day("2020-01-03"), day("2020-01-09"), held, holidays)
    assert sorted(r[0].day for r in out.collect()) == [3, 7, 9]


def test_absent_files_are_empty_and_typed(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert ctx.read_macro_monthly(spark, gone).count() == 0
    assert ctx.read_rate_events(spark, gone).columns == ["date", "rate", "change_bps", "source", "seq"]
    assert ctx.read_events(spark, gone).count() == 0
    assert ctx.graph_sectors(ctx.read_json(spark, gone, ctx.GRAPH_SCHEMA)).count() == 0


def test_single_json_documents(spark, tmp_path):
    ev = {"events": [{"date": "2020-01-05", "type": "policy", "title": "t", "sectors": ["a", "b"], "expected_sign": 0.5}]}
    (tmp_path / "events.json").write_text(json.dumps(ev, indent=1))
    rows = ctx.event_sectors(ctx.read_events(spark, str(tmp_path / "events.json"))).collect()
    assert {(r["sector"], r["expected_sign"]) for r in rows} == {("a", 0.5), ("b", 0.5)}
    fl = {"client_week": {"window": "w", "net_usd": {"X": 5, "Y": -2}}, "daily": {"days": ["2020-01-05", "2020-01-06"], "fipi": [1, 2], "lipi": [-1, -2]}}
    (tmp_path / "flows.json").write_text(json.dumps(fl))
    flows = ctx.read_json(spark, str(tmp_path / "flows.json"), ctx.FLOWS_SCHEMA)
    assert [(r["date"].day, r["fipi"], r["lipi"]) for r in ctx.flow_days(flows).orderBy("date").collect()] == [(5, 1.0, -1.0), (6, 2.0, -2.0)]
    assert {r["client"]: r["net"] for r in ctx.client_week(flows).collect()} == {"X": 5, "Y": -2}


def test_baked_macro_has_fixed_columns(spark):
    months = spark.createDataFrame([("2020-01", 3.0), ("2020-02", 4.0)], "month string, cpi_yoy double")
    rates = spark.createDataFrame([(dt.date(2020, 1, 10), 9.0, 1), (dt.date(2020, 2, 20), 8.0, 2)], "date date, rate double, seq int")
    out = ctx.bake_macro(months, rates).orderBy("date")
    assert [(r["date"].day, r["policy_rate"], r["brent_usd"]) for r in out.collect()] == [(31, 9.0, None), (29, 8.0, None)]


def test_panel_is_written_sorted(spark, archives, tmp_path):
    out = str(tmp_path / "panel")
    sinks.write_panel(feeds.parse_feed(feeds.read_archives(spark, archives)), out)
    keys = [(r["symbol"], r["date"]) for r in spark.read.parquet(out).collect()]
    assert keys == sorted(keys)


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text("kse100,date,cpi_yoy, Policy_Rate \n40000,2020-01-31,11.0,13.25\n1,x,NaN,\n")
    rows = ctx.read_macro_monthly(spark, str(tmp_path / "m.csv")).collect()
    assert (str(rows[0]["date"]), rows[0]["policy_rate"], rows[0]["cpi_yoy"], rows[0]["fx_reserves_sbp_bn"]) == ("2020-01-31", 13.25, 11.0, None)
    assert rows[1]["date"] is None and rows[1]["cpi_yoy"] is None


def test_holidays_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "h.txt").write_text("2024-01-01\n# none\n\"2024-02-05\",\n2024-01-01\n2024-13-01\n")
    assert sorted(str(r["date"]) for r in ctx.read_holidays(spark, str(tmp_path / "h.txt")).collect()) == ["2024-01-01", "2024-02-05"]


def test_keep_last_goes_by_file_name_then_folder(spark):
    rows = [("/b/2020.gz", 1, "old"), ("/a/2021.gz", 1, "new"), ("/a/2020.gz", 9, "older")]
    df = spark.createDataFrame([("d", "s", *r) for r in rows], "date string, symbol string, file string, pos long, v string")
    assert feeds.dedup_keep_last(df).first()["v"] == "new"


def test_zip_and_damaged_archives(spark, tmp_path):
    import gzip
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/readme.txt", "no")
        z.writestr("x/Day.LIS", "one\r\ntwo\n")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"three\nfour")[:-6])
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"five"))
    (tmp_path / "d.zip").write_bytes(b"PK nothing")
    assert sorted(r["line"] for r in feeds.read_archives(spark, str(tmp_path)).collect()) == ["five", "one", "two"]


def test_wider_macro_files_and_sector_spellings(spark, tmp_path):
    (tmp_path / "w.csv").write_text("us_10y,date,kse100\n4.1,2020-01-31,40000\n")
    row = ctx.read_macro_wide(spark, str(tmp_path / "w.csv")).first()
    assert (row["us_10y"], row["kse100"], row["trade_balance_mn"]) == (4.1, 40000.0, None)
    events = spark.createDataFrame([("d", "t", "x", ["Banks", "fertilizer", "Other"], 1.0)], "date string, type string, title string, sectors array<string>, expected_sign double")
    names = spark.createDataFrame([("Commercial Banks",), ("Fertilizer",)], "name string")
    assert sorted(r["sector"] for r in ctx.event_sectors(events, names).collect()) == ["Commercial Banks", "Fertilizer", "Other"]
