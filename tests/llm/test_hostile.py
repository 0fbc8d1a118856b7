"""Texts and pages made to hurt: time, recursion, header fields; and a brute-force pseudonymiser."""

import re
import time

import duckdb
import pytest

from panelkit.llm import pii, warc
from panelkit.llm.queries import QUERIES
from tests.llm import brute


def renamed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymised(df).orderBy("doc_id").collect()]


REPEATS = ["a.", "x@a.", "a@b.c.", "1234 ", "4111 1111 1111 1111 ", "+1 ", "+49 151 12345678 ", "12.", "1.2.3.4 ", "2020-01-01 ", "DE89 3704 0044 0532 0130 00 ", "DE89", "123-45-6789 ", "(555) ", "a@", "7", "1.1.2000 ", "AB12 "]


@pytest.mark.parametrize("repeat", REPEATS)
def test_a_megabyte_of_any_repeat(spark, repeat):
    text = "x@" + repeat * (1_000_000 // len(repeat)) + "com"
    start = time.time()
    (out,) = renamed(spark, text)
    assert re.sub("[A-Za-z0-9]+", "#", out) == re.sub("[A-Za-z0-9]+", "#", text) and time.time() - start < 90


def test_spellings_of_a_number_share_a_pseudonym(spark):
    digits = lambda s: re.sub("[^0-9+]", "", s)
    a, b, c, d = renamed(spark, "+49 151 12345678", "+4915112345678", "+49.151.1234.5678", "+49-1511-234-5678")
    assert len({digits(x) for x in (a, b, c, d)}) == 1 and a.startswith("+49 ") and digits(a) != "+4915112345678"
    us = renamed(spark, "(555) 123-4567", "+1 555 123 4567", "555-123-4567", "+15551234567", "+1 (555) 123-4567")
    assert len({digits(x).removeprefix("+1") for x in us}) == 1
    assert renamed(spark, "+351 912 345 678")[0].startswith("+351 ")


def test_short_and_long_names_are_permuted_as_a_whole(spark):
    ones = [x[0] for x in renamed(spark, *[f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz"])]
    assert sorted(ones) == sorted("abcdefghijklmnopqrstuvwxyz")
    assert len({(ord(y) - ord(x)) % 26 for x, y in zip("abcdefghijklmnopqrstuvwxyz", ones)}) > 8  # no shift
    tens = [x[0] for x in renamed(spark, *[f"{c}@x.com" for c in "0123456789"])]
    assert sorted(tens) == list("0123456789")
    p, q, r, s = renamed(spark, "abcdefghijklmnopq@x.com", "abcdefghijklmnopr@x.com", "a.b@x.com", "ab@x.com")
    assert sum(x == y for x, y in zip(p.split("@")[0], q.split("@")[0])) < 8
    assert r[1] == "." and r[0] + r[2] == s[:2]
    pairs = renamed(spark, *[f"{a}{b}@x.com" for a in "abc" for b in "0123456789"])
    assert len(set(pairs)) == 30


def test_all_documents_as_value_by_value(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = {r.doc_id: r.text for r in QUERIES["op2_pii"](spark, sf_dir).collect()}
    want = {i: brute.pseudonymised(t) for i, t in docs}
    assert got == want and sum(want[i] != t for i, t in docs) > 5
    said = "4041894974608795, 4041-8949-7460-8795; DE89370400440532013000 1.2.3.4 (555) 123-4567 +4420 7946 0958 3/5/2020 25.03.2020 2020-02-29 123-45-6789 x.y_z+1@m.example.org 4041894974608796"
    assert renamed(spark, said) == [brute.pseudonymised(said)]


# ---- pages
def blocks(spark, html, url="http://x/"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return {r.record_type: r.block for r in warc.derivatives(warc.responses_from_pages(df)).collect()}


@pytest.mark.parametrize("opener", ["<a ", "<title ", "<title>", "<!--", "<!-- - ", "<p ", "<script>", "<script ", "<style><script>", "<head>", "<", "&#1;", "&amp", "<a href='x", "<script></"])
def test_a_megabyte_of_openers(spark, opener):
    start = time.time()
    assert set(blocks(spark, opener * (1_000_000 // len(opener)))) == {"metadata", "conversion"}
    assert time.time() - start < 30


def test_entities_of_all_kinds(spark):
    text = blocks(spark, "caf&eacute; &#8217; &#xE9;&#XE9; &uuml;ber &amp;lt; &bogus; &#0;&#55296;&#1114112;&#9999999; &#128512; A&nbsp;B &Yuml;&yuml; &frac12;")["conversion"]
    assert text == "café ’ éé über &lt; &bogus; \ufffd\ufffd\ufffd\ufffd 😀 A B Ÿÿ ½"
    assert len(warc.LATIN_1) == 96 and warc.ENTITIES["szlig"] == "ß" and warc.ENTITIES["divide"] == "÷"


def test_unclosed_and_nested_parts(spark):
    text = blocks(spark, "<script>var a = '<b>x</b>';</script>seen <!-- a -- b --> too <script>never closed <p>shown")["conversion"]
    assert text == "seen too never closed\nshown"


def test_line_breaks_end_no_header_field(spark, tmp_path):
    html = '<html lang="e\nn"><a href="x\r\nWARC-Type: fake">l</a></html>'
    df = spark.createDataFrame([(1, "http://x/\r\nWARC-Type: fake", html)], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses_from_pages(df))
    meta = next(r.block for r in records.collect() if r.record_type == "metadata")
    assert "outlink: x%0D%0AWARC-Type: fake\r\n" in meta and "language: e%0An" in meta
    warc.write(records, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert {r.headers["WARC-Type"] for r in back} == {"metadata", "conversion"} and all(r.whole for r in back)
    assert all(r.headers["WARC-Target-URI"] == "http://x/%0D%0AWARC-Type: fake" for r in back)


def test_records_are_read_by_their_length():
    block = b"text\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    one = b"WARC/1.1\r\nWARC-Type: conversion\r\nX: a\r\nX: b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    got = list(warc.records_of(one + one[:-12]))
    assert [w for _, _, w in got] == [True, False] and got[0][1].encode() == block and got[0][0]["X"] == "a; b"
    assert list(warc.records_of(b"")) == [] and list(warc.records_of(b"WARC/1.1\r\nno end")) == []
