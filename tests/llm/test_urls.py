"""URL rules against trying every rule, and the digest array itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import urlfilter
from panelkit.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle_compare import compare, connect

ODD = [
    None, "", "net", "://", "http://", "http://NET/", "http://net", "http://net?x=/", "http://a.b.net/", "http://xnet/", "https://www.example.net/en/1?x://y.net/", "https://example.net/en", "https://example.net/EN/x",
    "HTTP://WWW.EXAMPLE.COM/de/x#y", "http://example.com.net/de/", "http://example.com:80/de/", "http://.net/", "http://net./", "http://..net/", "http://ÄX.org/fr/é", "http://org/fr/", "http://u@org/fr/\n?", "a://b://c.net/", "http://" + "a." * 3000 + "net/" + "x" * 50_000,
]


def rules_frame(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_odd_urls_clashing_columns_and_ties(spark):
    rows = [(i, u, "own") for i, u in enumerate([*ODD, *ODD])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumn("host", F.lit(7)).withColumn("n", F.lit(1))
    out = urlfilter.judged(df, urlfilter.standard_rules(spark))
    assert out.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        assert got[i] == brute.url_verdict(u, urlfilter.RULES), u and u[:60]
    assert urlfilter.judged(df.limit(0), urlfilter.standard_rules(spark)).count() == 0


def random_rules(n, seed):
    r = random.Random(seed)
    hosts = ["net", "org", "com", "a.net", "b.a.net", "b.org", "c.com", "xn.c.com", "é.org"]
    paths = ["/", "/en/", "/en", "/e", "/de/x", "/é/", "en", "/en/a/b"]
    return list({(r.choice(hosts), r.choice(paths)): r.choice(["allow", "block"]) for _ in range(n)}.items())


@pytest.mark.parametrize("most_bytes", [10**9, 0])
def test_both_ways_agree_with_trying_every_rule(spark, most_bytes):
    rules = [(h, p, v) for (h, p), v in random_rules(30, 5)]
    r = random.Random(6)
    urls = ["http://" + ".".join(r.choices(["a", "b", "c", "xn", "é"], k=r.randint(0, 3)) + [r.choice(["net", "org", "com", "xyz"])]) + r.choice(["", "/", "/en/a/b?x", "/en#", "/e", "/de/x/y", "/é/1"]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate([*urls, None, *ODD])), "page_id long, url string")
    odd = [(None, "/", "block"), ("", "/", "block"), ("net", None, "block"), ("net", "/", None), ("net", "", "block")]
    out = urlfilter.judged(df, rules_frame(spark, rules + rules + odd), default="block", most_bytes=most_bytes).collect()
    assert len(out) == df.count()
    assert all((x.host, x.path, x.rule, x.verdict) == brute.url_verdict(x.url, rules, "block") for x in out)


def test_equal_rules_block_and_an_empty_list_gives_the_default(spark):
    df = spark.createDataFrame([(1, "http://A.net/x")], "page_id long, url string")
    both = rules_frame(spark, [("a.NET", "/", "allow"), ("a.net", "/", "block")])
    assert urlfilter.judged(df, both).first().verdict == "block"
    none = urlfilter.judged(df, both.limit(0)).first()
    assert (none.rule, none.verdict) == (None, "allow")


def test_digests_are_sorted_and_collisions_are_compared(spark, tmp_path):
    rules = [(f"h{i}.net", f"/{i % 7}/", "block") for i in range(3000)]
    sorted_entries = urlfilter.entries(urlfilter.usable_rules(rules_frame(spark, rules)))
    array = urlfilter.DigestArray(urlfilter.write_digests(sorted_entries, spark).removeprefix("file:"))
    assert len(array.digests) == 6000 and (np.diff(array.digests.astype(object)) >= 0).all()
    keys = [f"h{i}.net\0/{i % 7}/".encode() for i in range(3000)]
    assert array.probe(keys) == dict.fromkeys(keys, "block") and array.probe([b"h1.net\0/2/", b"h1.ne", b""]) == {}
    # equal digests: three entries and a stranger under one number
    crowd = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string").withColumn("digest", F.lit(-5).cast("long"))
    array = urlfilter.DigestArray(urlfilter.write_digests(crowd, spark).removeprefix("file:"))
    same = np.full(4, 2**64 - 5, np.uint64)
    assert array.probe([b"c", b"x", b"a", b"b"], same) == {b"c": "3", b"a": "1", b"b": "2"}


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    n, diff = compare(spark, connect(sf), sf, QUERIES["op11_url_rules"], ORACLES["op11_url_rules"])
    assert n == 250 and not diff, diff
