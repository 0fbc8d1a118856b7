"""Periodic runs against a scan of every lag at every word."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelkit.llm import periodic
from panelkit.llm.queries import QUERIES
from tests.llm import brute

DOCS = "doc_id long, text string"


def made_up(r, n):
    w = [r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 3, 5, 26])]) for _ in range(n)]
    for _ in range(r.randint(0, 2)):
        if w:
            a = r.randrange(len(w))
            p, b = 1 + (len(w) - a) // r.randint(2, 9), r.randint(a, len(w))
            w[a:b] = [w[a + i % p] for i in range(b - a)]
    return w


def test_runs_of_random_words():
    r = random.Random(7)
    for _ in range(400):
        texts = [made_up(r, r.randint(0, 90)) for _ in range(r.randint(1, 6))]
        words = pa.array([" ".join(t) for t in texts])
        flat, starts = periodic.word_lists(words)
        ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        rows, kept = periodic.runs_of(ids, starts)
        for i, t in enumerate(texts):
            want = brute.periodic_runs(t)
            assert [tuple(x[1:]) for x in rows.tolist() if x[0] == i] == want, t
            left = [not any(s + q <= k < s + n for s, n, q in want) for k in range(len(t))]
            assert kept[starts[i] : starts[i + 1]].tolist() == left


def test_splitting_leaves_repeats_only():
    prose = np.random.default_rng(1).zipf(1.3, 20_000)  # many words once, few often
    assert len(periodic.surviving(prose, np.zeros(20_000, np.int64), 12)[0]) == 0
    at, segment = periodic.surviving(np.concatenate([np.arange(50), np.arange(20) % 5, np.arange(60, 90)]), np.zeros(100, np.int64), 12)
    assert at.tolist() == list(range(50, 70)) and len(set(segment)) == 1


def test_places_in_steps(monkeypatch):
    monkeypatch.setattr(periodic, "PLACES", 7)
    size = np.array([30, 12, 45])
    begin = np.cumsum(size) - size
    got = [x for i, q, s in periodic.places(begin, size) for x in zip(i.tolist(), q.tolist(), s.tolist())]
    want = [(b + j * q, q, k) for k, (b, m) in enumerate(zip(begin.tolist(), size.tolist())) for q in range(1, m // 2 + 1) for j in range((m - 1) // q)]
    assert got == want
    w = [i % 3 for i in range(60)] + [i % 5 for i in range(60)]
    rows, _ = periodic.runs_of(np.array(w), np.array([0, 120]))
    assert [tuple(x[1:]) for x in rows.tolist()] == brute.periodic_runs(w)


def test_long_repetitive_texts_take_seconds():
    t = time.time()
    for ids in (np.zeros(300_000, np.int64), np.arange(300_000) % 1000, np.random.default_rng(2).integers(0, 2, 100_000)):
        rows, _ = periodic.runs_of(ids, np.array([0, len(ids)]))
        assert len(rows)
    assert time.time() - t < 60


def test_odd_texts_repeats_and_clashing_columns(spark):
    texts = [None, "", " \t\n", "a", "a " * 11, "a\x0b" * 12, "é\x85é " * 30, "x y z " * 8 + "x y", "the quick word " * 30_000, "A a " * 9, "a b " * 6 + "c " + "a b " * 6, "日本 " * 13]
    data = [(k, t) for k, t in enumerate(texts)] + [(3, "p q " * 20)] * 2 + [(None, "r s " * 20)]
    df = spark.createDataFrame(data, DOCS).withColumn("runs", F.lit("own")).withColumn("start", F.lit(1)).withColumn("_b", F.lit(2))
    out = periodic.with_runs(df)
    assert out.columns == ["doc_id", "text", "start", "_b", "runs", "collapsed"] and out.count() == len(data)
    for r in out.collect():
        w = (r.text or "").encode().split()
        want = brute.periodic_runs(w) if len(w) < 5000 else [(0, 90_000, 3)]
        assert [tuple(x) for x in r.runs] == want
        if len(w) < 5000:
            got = periodic.digests(spark.createDataFrame([r], out.schema), "doc_id").first()
            assert tuple(got)[1:] == brute.run_row(w)
        else:
            assert r.collapsed == "the quick word"
    assert periodic.digests(periodic.with_runs(df.limit(0)), "doc_id").count() == 0


def test_planted_tails(spark):
    data = [(i, f"w{i} a b c d e f g h i j") for i in range(300)] + [(None, "x y"), (4, None), (5, ""), (5, " \n")]
    out = periodic.with_planted_tails(spark.createDataFrame(data, DOCS)).collect()
    assert [tuple(r)[0] for r in out] == [i for i, _ in data]
    assert all((r.text or "").encode().split() == brute.planted_tail(i, t) for r, (i, t) in zip(out, data))
    assert sum(r.text != t for r, (_, t) in zip(out, data)) > 10


def test_query_agrees_on_all_documents(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    short = [(i, t) for i, t in docs if len((t or "").split()) < 1500]
    assert len(short) > 0.9 * len(docs) and sum(got[i][0] > 0 for i, _ in docs) > 0
    assert all(got[i] == brute.run_row(brute.planted_tail(i, t)) for i, t in short)
