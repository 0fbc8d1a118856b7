"""The source audit against term-by-term sums, and its tree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import divergence
from panelkit.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle_compare import compare, connect

DOCS = "text string, lang string, source string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def made_up(seed, n=120, words=40, sources=6):
    r = random.Random(seed)
    vocabulary = [w for k in range(words) for w in (f"w{chr(97 + k % 26)}{'x' * (k // 26)}", f"É{chr(97 + k % 26)}")]
    return [(" ".join(r.choices(vocabulary, k=r.randint(0, 30))) + r.choice(["", ".", "\0 1", " ÄÖ"]), r.choice(["en", "de"]), f"s{r.randrange(sources)}") for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agrees_with_sums_over_all_terms(spark, seed):
    docs = made_up(seed)
    got = rows(divergence.audit(spark.createDataFrame(docs, DOCS)))
    assert len(got) == len(set(got)) and set(got) == brute.divergences(docs)


def test_nulls_lonely_sources_empty_vocabularies_and_clashing_columns(spark):
    docs = [("a b", "en", "x"), ("A-b", "en", "y"), ("a1b", "en", None), (None, "en", "z"), ("", None, "x"), (None, None, None), ("only", "de", "x"), ("q Q q", "fr", "x"), ("q", "fr", "x"), ("q", "fr", "x"), ("q " * 400_000, "fr", "y"), ("x" * 2_500_000 + " q", "fr", "y")]
    df = spark.createDataFrame(docs, DOCS).withColumn("p", F.lit("own")).withColumn("n", F.lit(1)).withColumn("term", F.lit(2))
    got = rows(divergence.audit(df))
    assert set(got) == brute.divergences(docs) and len(got) == len(set(got))
    assert ("", "", "pair", "x", 0, 1) in got and not [r for r in got if r[0] == "de"]
    assert rows(divergence.audit(df.limit(0))) == []


def test_small_trees_and_flushes_add_up(spark, monkeypatch):
    docs = made_up(4, 200, 60, 9)
    paths = [("en", [("a", 5, 1), ("b", 7, 2), ("c", 3, 3)], 2), ("en", [("a", 5, 1), ("b", 7, 2)], 1), ("en", [("b", 7, 2)], 4), ("de", [("a", 9, 1), ("c", 1, 3)], 1)]
    tree = divergence.Tree()
    for p in paths:
        tree.insert(*p)
    assert len(tree.parent) == 6 and tree.count == [3, 3, 2, 4, 1, 1]
    want: dict = {}
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, items, times in paths:
        for a in items:
            for b in items:
                if a[0] != b[0]:
                    change = f(a[1], b[1]) - f(a[1], b[2]) - f(a[2], b[1]) + f(a[2], b[2])
                    want[lang, a[0], b[0]] = want.get((lang, a[0], b[0]), 0) + times * change
    assert {(x, a, b): int(v) for x, a, b, v in tree.corrections()} == want
    monkeypatch.setattr(divergence, "NODES", 5)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert set(rows(divergence.audit(spark.createDataFrame(docs, DOCS).repartition(3)))) == brute.divergences(docs)


def test_shares_of_large_counts_are_exact(spark):
    n = [0, 1, 10**10, 3 * 10**18]
    df = spark.createDataFrame([(x, x + 5, 7) for x in n], "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).cast("long")).collect()]
    assert got == [1 + 10**9 * (x + 1) // (x + 12) for x in n]
    p, q = np.array([10**9 + 1, 1]), np.array([1, 10**9 + 1])
    assert divergence.f(p, q).tolist() == [(10**9) ** 2, (10**9) ** 2 // (10**9 + 1)]


def test_oracle(spark, sf_dir):
    n, diff = compare(spark, connect(sf_dir), sf_dir, QUERIES["op12_source_audit"], ORACLES["op12_source_audit"])
    assert n > 1000 and not diff, diff
