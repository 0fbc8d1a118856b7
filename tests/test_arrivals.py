"""Archives as a data source, upserts by month, gaps, provenance, documents."""

import datetime as dt
import gzip
import json
import os
import resource
import subprocess
import sys
import zipfile

from pyspark.sql import functions as F

from panelkit.operators import gaps
from panelkit.sources import archives, feeds, sinks
from panelkit.sources import context as ctx
from panelkit.streaming.ingest import staged_panel
from panelkit.streaming.upsert import drop_old, finished_versions, held_rows, panel_rows, upsert, upsert_new


def feed(day, symbol, close):
    return f"{day:%d%b%Y}|{symbol}|0804|{symbol} Ltd|1|2|1|{close}|100|10.0".upper()


D = dt.date


# ---- archives
def test_archives_of_every_kind(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/readme.txt", "no")
        z.writestr("x/Day.LIS", "one\r\ntwo\n")
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("x/readme.txt", "no")
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "c.gz").write_bytes(gzip.compress("five\xff\n\n sechs".encode("latin-1")))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"three\nfour\n" * 90_000)[:-6])
    (tmp_path / "d.zip").write_bytes(b"PK nothing")
    (tmp_path / "e.gz").write_bytes(b"")
    (tmp_path / "_hidden.gz").write_bytes(gzip.compress(b"hidden"))
    rows = archives.read_lines(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(os.path.basename(r.file), r.pos, r.line) for r in rows] == [("a.zip", 0, "one"), ("a.zip", 1, "two"), ("c.gz", 0, "five�"), ("c.gz", 1, ""), ("c.gz", 2, " sechs")]
    assert archives.read_lines(spark, str(tmp_path / "gone")).count() == 0
    both = feeds.read_archives(spark, str(tmp_path)).filter("not file like '%hidden%'")
    assert sorted(r.line for r in both.collect()) == sorted(r.line for r in rows)


def test_small_archives_share_a_task_and_large_ones_do_not():
    files = [(f"f{i}", n) for i, n in enumerate([5, 5, 5, 100, 1, 1])]
    assert [p.paths for p in archives.packed(files, 12)] == [["f0", "f1"], ["f2"], ["f3"], ["f4", "f5"]]
    assert archives.packed([]) == []


def test_a_large_listing_needs_little_memory(tmp_path):
    line = b"05JAN2020|AAA|0804|Aaa Ltd|1|2|1|11.0|100|10.0\n"
    path = tmp_path / "large.gz"
    with gzip.open(path, "wb", compresslevel=1) as out:
        for _ in range(300):
            out.write(line * 20_000)  # 290 MB
    code = f"""
import resource, sys
sys.path.insert(0, {os.getcwd()!r})
from panelkit.sources import archives
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in archives.line_batches({str(path)!r}))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    n, grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(n) == 6_000_000 and int(grown) < 150_000  # KB
    assert resource.getpagesize()


# ---- upserts
def files_of(panel, month):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(panel) for f in names if f"month={month}" in d and f.endswith(".parquet")}


def test_three_arrivals_a_late_correction_and_an_empty_start(spark, tmp_path):
    raw, panel, checkpoint = tmp_path / "raw", str(tmp_path / "panel"), str(tmp_path / "cp")
    raw.mkdir()
    assert panel_rows(spark, panel).count() == 0 and panel_rows(spark, panel).columns[:2] == ["date", "symbol"]
    assert finished_versions(spark, panel) == [] and drop_old(spark, panel) == 0

    def arrive(name, *lines):
        (raw / f"{name}.Z").write_bytes(gzip.compress("\n".join(lines).encode()))
        upsert_new(spark, str(raw), panel, checkpoint)
        return {(r.date, r.symbol): r.close for r in panel_rows(spark, panel).collect()}

    assert arrive("2020-01-05", feed(D(2020, 1, 5), "AAA", 11), feed(D(2020, 1, 5), "BBB", 5)) == {(D(2020, 1, 5), "AAA"): 11, (D(2020, 1, 5), "BBB"): 5}
    january = files_of(panel, "2020-01-01")
    assert len(arrive("2020-02-03", feed(D(2020, 2, 3), "AAA", 12))) == 3
    assert files_of(panel, "2020-01-01") == january and len(january) == 1  # untouched months keep their files
    late = arrive("2020-02-09", feed(D(2020, 1, 5), "AAA", 13), feed(D(2020, 2, 9), "AAA", 14))
    assert late[D(2020, 1, 5), "AAA"] == 13 and len(late) == 4 and late[D(2020, 1, 5), "BBB"] == 5
    # an older file that arrives later doesn't win
    assert arrive("2020-01-06", feed(D(2020, 1, 5), "AAA", 99))[D(2020, 1, 5), "AAA"] == 13
    upsert_new(spark, str(raw), panel, checkpoint)  # nothing new
    before = panel_rows(spark, panel).collect()
    assert drop_old(spark, panel) == 3 and sorted(panel_rows(spark, panel).collect()) == sorted(before)
    assert drop_old(spark, panel) == 0


def test_a_repeated_or_unfinished_batch_changes_nothing(spark, tmp_path):
    panel = str(tmp_path / "panel")
    typed = lambda *lines: feeds.type_feed(feeds.split_feed_lines(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], feeds.LINES_SCHEMA)))
    upsert(spark, typed(feed(D(2020, 1, 5), "AAA", 11)), panel, 0)
    second = typed(feed(D(2020, 1, 5), "AAA", 10), feed(D(2020, 1, 6), "AAA", 12), feed(D(2020, 1, 6), "AAA", 13))
    upsert(spark, second, panel, 1)
    once = sorted(held_rows(spark, panel).collect())
    upsert(spark, second, panel, 1)
    assert sorted(held_rows(spark, panel).collect()) == once and len(once) == 2 and finished_versions(spark, panel) == [0, 1]
    upsert(spark, typed(feed(D(2020, 1, 7), "AAA", 50)), panel, 2)
    os.remove(os.path.join(panel, "version=2", "_SUCCESS"))  # as if it had been lost half way
    assert sorted(held_rows(spark, panel).collect()) == once
    upsert(spark, typed(feed(D(2020, 1, 7), "AAA", 51)), panel, 2)
    assert {r.close for r in panel_rows(spark, panel).collect()} >= {51.0} and panel_rows(spark, panel).count() == 3
    upsert(spark, second.limit(0), panel, 3)
    assert panel_rows(spark, panel).count() == 3


def test_nothing_staged_gives_no_rows(spark, tmp_path):
    assert staged_panel(spark, str(tmp_path / "gone")).count() == 0


# ---- gaps
def test_ranges_of_missing_days(spark):
    day = lambda s: F.lit(s).cast("date")
    holidays = spark.createDataFrame([(D(2020, 1, 8),), (D(2020, 1, 8),), (D(2020, 1, 11),)], "date date")
    calendar = gaps.trading_calendar(spark, day("2020-01-01"), day("2020-01-14"), holidays)
    assert calendar.count() == 9  # ten weekdays and a holiday on one of them
    held = [("a", 1), ("a", 2), ("a", 7), ("a", 7), ("a", 14), ("b", 9), ("b", 11), ("c", 4)] + [("d", i) for i in range(1, 15)]
    rows = spark.createDataFrame([(s, D(2020, 1, i)) for s, i in held], "symbol string, date date")
    got = sorted((r.symbol, r.first_missing.day, r.last_missing.day, r.n_days) for r in gaps.missing_ranges(rows, calendar).collect())
    # c has only a Saturday
    assert got == [("a", 3, 6, 2), ("a", 9, 13, 3), ("b", 1, 7, 5), ("b", 10, 14, 3)]
    assert gaps.missing_ranges(rows.limit(0), calendar).count() == 0


# ---- counts taken in the write
def test_counts_come_from_the_write(spark, tmp_path):
    df = spark.createDataFrame([(D(2020, 1, 1), 1.0, None), (D(2020, 3, 1), None, None)], "date date, x double, `y z` string")
    side = {r.column: r for r in sinks.write_with_provenance(df, str(tmp_path / "m"), "date", {"x": "orders"}).collect()}
    assert {c: (r.rows, r.filled, r.source) for c, r in side.items()} == {"date": (2, 2, None), "x": (2, 1, "orders"), "y z": (2, 0, None)}
    assert side["x"].first == D(2020, 1, 1) and side["x"].last == D(2020, 3, 1)
    assert spark.read.parquet(str(tmp_path / "m" / "data")).count() == 2
    got = sinks.write_bundle({"one": df, "none": df.limit(0)}, str(tmp_path / "b"))
    assert got["one"]["rows"] == 2 and got["none"]["rows"] == 0 and got["none"]["filled"] == {"date": 0, "x": 0, "y z": 0}


# ---- documents
def test_sovereign_and_company_documents(spark, tmp_path):
    doc = {
        "ratings": [{"date": "2020-01-02", "agency": "M", "rating": "B3", "outlook": "Stable"}, {"date": "2021-01-02", "agency": "M", "rating": "B2", "outlook": "Stable"}, {"date": "2020-05-01", "agency": "S", "rating": "B", "outlook": "Neg"}],
        "external_debt": [{"year": 2019, "total_usd_bn": 106.9, "pct_of_gdp": 38}], "imf_programs": [],
    }
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    tables = ctx.sovereign_tables(ctx.read_json(spark, str(tmp_path / "s.json"), ctx.SOVEREIGN_SCHEMA))
    assert {n: t.count() for n, t in tables.items()} == {"ratings": 3, "external_debt": 1, "imf_programs": 0, "macro_annual": 0}
    assert tables["external_debt"].first().pct_of_gdp == 38.0
    spells = {(r.agency, r.rating): r.until for r in ctx.rating_spells(tables["ratings"]).collect()}
    assert spells == {("M", "B3"): D(2021, 1, 2), ("M", "B2"): None, ("S", "B"): None}
    gone = ctx.sovereign_tables(ctx.read_json(spark, str(tmp_path / "gone"), ctx.SOVEREIGN_SCHEMA))
    assert all(t.count() == 0 for t in gone.values())
    (tmp_path / "f.json").write_text(json.dumps({"as_of": "x", "companies": [{"ticker": "T", "name": "N", "pe": 8.1, "eps_history": [{"period": "FY22", "eps": 3}]}]}))
    firms = ctx.read_json(spark, str(tmp_path / "f.json"), ctx.FUNDAMENTALS_SCHEMA)
    assert ctx.companies(firms).first().pe == 8.1 and ctx.eps_history(firms).first().eps == 3.0
    (tmp_path / "d.json").write_text(json.dumps({"sources": [{"name": "n", "url": "u"}]}))
    assert ctx.data_sources(ctx.read_json(spark, str(tmp_path / "d.json"), ctx.SOURCES_SCHEMA)).first().url == "u"
