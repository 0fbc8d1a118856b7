"""Cuts in text without white space, bounded tables, bounded fitting rows, tile neighbours."""

import numpy as np
from pyspark.sql import functions as F

from panelkit.llm import bpe, common, gam, tiles, toxicity


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path())


def test_text_of_any_script_falls_into_many_fragments():
    c, t = bpe.Codec(bpe.public_path()), library()
    r = np.random.default_rng(5)
    for text in ("".join(map(chr, r.integers(0x4E00, 0x9FA5, 16_000))), "ab," * 5000, "日本語のテキストです。" * 900, "мама" * 2000, "x=1;y='it's'll\"" * 900, "한국어텍스트" * 1500, "a'b'c's't" * 900, "qz" * 4000, "ñandú,¿qué?" * 600):
        found = c.cut(text)
        assert "".join(found) == text
        assert np.frombuffer(c.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:20]
        if text[0] not in "xa'":
            assert len(found) > len(text) / 50, text[:20]


def test_inner_cuts_hold_for_random_mixtures():
    c, t = bpe.Codec(bpe.public_path()), library()
    r = np.random.default_rng(9)
    signs = list("abqzxjvkéñüЯж日本语한국,.;!?()=+-_0123456789'´`°²½€’") + ["'s", "'re", "'ll", "don't", "qz", "日本", "...", "ア", "ก", "ي", "ß", "µ", "ª", "e\u0301"]
    for _ in range(150):
        text = "".join(r.choice(signs, r.integers(80, 400)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(c.encode(text), "<u4").tolist() == ids, repr(text)
        parts = [i for p in c.inner_cuts(text) for i in t.encode(p, add_special_tokens=False).ids]
        assert parts == ids, repr(text)


def test_long_fragments_are_not_remembered():
    c = bpe.Codec(bpe.public_path())
    c.encode_all(["\u2028" * 5000, "\u0301" * 3000, "short words here", "’" * 900])
    assert max(map(len, c.known)) <= bpe.KEPT and " words" in c.known


def labels_and_docs(spark, n=60):
    docs = [(i, f"text number {i} of words") for i in range(n)] + [(3, "z again")] * 500 + [(None, "none"), (5, None)]
    labels = [(i, i % 2, i % 2) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_repeated_ids_reach_the_driver_once(spark):
    docs, labels = labels_and_docs(spark)
    sample = common.labelled_sample(labels, "quality", 4, 2, 1000)
    rows = common.fitting_rows(docs, sample, 10**6, "t").collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) == sample.count()
    assert all(r.text == f"text number {r.doc_id} of words" for r in rows)  # the smallest of each id
    few = common.fitting_rows(docs, sample, 100, "t")
    assert 0 < few.count() < len(ids) and few.agg(F.sum(F.octet_length("text"))).first()[0] <= 100
    assert common.fitting_rows(docs.limit(0), sample, 100, "t").count() == 0
    once = docs.dropDuplicates(["doc_id", "text"])
    a, b = gam.train(docs, labels), gam.train(once, labels)
    assert gam.score(once, a).orderBy("doc_id", "text").collect() == gam.score(once, b).orderBy("doc_id", "text").collect()
    x, y = toxicity.train(docs, labels), toxicity.train(once, labels)
    assert toxicity.score(once, x).orderBy("doc_id", "text").collect() == toxicity.score(once, y).orderBy("doc_id", "text").collect()


def test_thresholds_come_from_rows_that_were_not_fitted(monkeypatch):
    seen = {"learned": 0, "order": []}
    learn, calibrate = toxicity.TextCnn.learn, toxicity.TextCnn.calibrate
    monkeypatch.setattr(toxicity.TextCnn, "learn", lambda self, docs, y, *a: seen["order"].append(("learn", len(y))) or learn(self, docs, y, *a))
    monkeypatch.setattr(toxicity.TextCnn, "calibrate", lambda self, z, y, langs, *a: seen["order"].append(("calibrate", len(y))) or calibrate(self, z, y, langs, *a))
    r = np.random.default_rng(1)
    ids = [r.integers(0, 10**9, 30) for _ in range(100)]
    toxicity.TextCnn().fit(ids, np.arange(100) // 50)
    assert seen["order"] == [("learn", 80), ("calibrate", 20)]


def test_tiles_of_uneven_cells_find_all_links(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**62, 40)
    rows = [(i, int(i % 3 == 0), int(base[i % 40]) ^ (1 << int(r.integers(0, 60))) * int(r.integers(0, 2))) for i in range(400)]
    rows = [(i, 5 if i < 300 else 6 if i < 390 else 9, f) for i, _, f in rows]
    df = spark.createDataFrame(rows, "id long, cell long, f0 long")
    found = tiles.links(df, 1, 2, [0, 1, 3], 16, "uneven").collect()
    cells = {i: c for i, c, _ in rows}
    prints = {i: f for i, _, f in rows}
    from tests.llm import brute

    near = [(a, b) for a in prints for b in prints if a < b and abs(cells[a] - cells[b]) in (0, 1, 3) and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert brute.components(prints, [(x.u, x.v) for x in found]) == brute.components(prints, near)
