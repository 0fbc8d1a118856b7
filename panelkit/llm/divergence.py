"""How the term distributions of sources differ: exact chi-square-like divergences by a
frequent-pattern tree of term rows.

For each language, terms that occur in enough of its documents are kept. A source of the
language gives a kept term, with count >= 0 there, the share ``p`` (in billionths, smoothed
by one); the divergence of shares p from q is ``f = floor((p - q)^2 / q)``, and that of two
sources is the sum of f over all kept terms. Most terms are absent from most sources, where
p is one constant of the source, so the sum over all V terms splits into

- V times f of the two constants,
- for every term of one source, what its p changes against the other's constant; equal
  counts change the same, so they are counted first,
- for every term of both, what the two p change beyond that.

Only the last part needs the terms together. A term is a row of its sources' shares, in the
order of the sources. Rows are inserted into a tree, one node an item, so rows that begin
alike share nodes that carry multiplicities. A pair of a node and an ancestor stands for
all rows through the node: its correction is taken once, times the node's count.

On Spark: tasks count terms of their documents and send one row per (language, source,
term); term rows meet by (language, term), hold an entry per source, and equal rows are
counted. Rows are sorted by range over (language, row), so that shared beginnings stand in
one task; each task builds a tree of bounded size, adds up its corrections by pair of
sources and starts the next. Trees can be cut anywhere: multiplicities add up. A hot source
or language is many rows dealt by their content. Pairs of sources are the result itself.
All arithmetic is exact: integers, and decimals where they are added up.

Defined cases: null texts, languages and sources are read as empty; every row of the input
is a document, also where ids repeat; a (language, source) without kept terms has p of
count zero, and value 0 everywhere in a language without any; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import needed, size_bounded
from panelkit.session import materialize

#: Documents of the language in which a kept term occurs, at least.
LEAST_DOCUMENTS = 3
#: Ranks of the term part.
TERM_RANKS = 200
#: Entries of a task's counting table, and nodes of a task's tree, before it sends and starts anew.
ENTRIES, NODES = 300_000, 300_000
#: Bytes of text that are cut into terms at once.
PIECE = 1_000_000
#: Groups (language, source) up to which their totals are broadcast.
GROUPS = 100_000
#: A-Z to a-z; other ASCII characters than letters to blanks; bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BILLION = 1_000_000_000
EXACT = "decimal(38,0)"


def pieces(text: str | None, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time, cut between terms."""
    raw = (text or "").encode().translate(LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + most)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and of documents, one
    row per task and flush of its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: defaultdict = defaultdict(Counter)
        docs_of: defaultdict = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                d, terms = docs_of[lang, source], list(counts)
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            n.clear()
            docs_of.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                distinct: set[bytes] = set()
                for words in pieces(text):
                    n[lang, source].update(words)
                    distinct.update(words)
                docs_of[lang, source].update(distinct)
            if sum(map(len, n.values())) > ENTRIES:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def term_rows(docs: DataFrame, least_documents: int) -> DataFrame:
    """(lang, term, n, sources): the kept terms, with an entry (source, n) per source that
    has the term. One shuffle, by (lang, term), of counts that tasks have added up."""
    dealt = term_counts(docs).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = by_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return rows.filter(F.col("docs") >= least_documents).drop("docs")


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a count: 1 + floor(10^9 (n + 1) / (total + kept)); null where nothing is kept."""
    top = F.lit(BILLION).cast(EXACT) * (n + 1).cast("decimal(19,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, (total + kept).cast(EXACT)))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares; at most 10^18 + 2 10^9, so a bigint holds it."""
    return F.call_function("div", (p - q) * (p - q), q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tree:
    """Term rows by shared beginnings. A node is (parent, source, p); sources are numbered
    per language, so numbers of different languages never meet under one root."""

    def __init__(self) -> None:
        self.child: dict[tuple, int] = {}
        self.parent: list[int] = []
        self.source: list[int] = []
        self.p: list[int] = []
        self.absent: list[int] = []
        self.count: list[int] = []
        self.names: dict[tuple[str, str], int] = {}

    def insert(self, lang: str, path: list[tuple[str, int, int]], times: int) -> None:
        """``path``: (source, p, p of an absent term) in the order of the sources."""
        node = -1
        for name, p, absent in path:
            source = self.names.setdefault((lang, name), len(self.names))
            new = self.child.setdefault((node, source, p), len(self.parent))
            if new == len(self.parent):
                self.parent.append(node)
                self.source.append(source)
                self.p.append(p)
                self.absent.append(absent)
                self.count.append(0)
            self.count[new] += times
            node = new

    def corrections(self) -> Iterator[tuple[str, str, str, Decimal]]:
        """(lang, source, other, correction) of all pairs of a node and an ancestor, both
        ways, added up. One step of the loop takes every node and its k-th ancestor."""
        parent, source, p, absent, count = (np.array(x, np.int64) for x in (self.parent, self.source, self.p, self.absent, self.count))
        node, above, k = np.arange(len(parent)), parent, len(self.names)
        sums: Counter = Counter()
        while True:
            node, above = node[above >= 0], above[above >= 0]
            if not len(node):
                break
            for a, b in ((above, node), (node, above)):
                change = f(p[a], p[b]) - f(p[a], absent[b]) - f(absent[a], p[b]) + f(absent[a], absent[b])
                pair, at = np.unique(source[a] * k + source[b], return_inverse=True)
                # two halves, so that no sum of products leaves 64 bits
                high, low = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
                np.add.at(high, at, (change >> 31) * count[node])
                np.add.at(low, at, (change & (2**31 - 1)) * count[node])
                for x, h, r in zip(pair.tolist(), high.tolist(), low.tolist()):
                    sums[x] += (h << 31) + r
            above = parent[above]
        named = list(self.names)
        for x, total in sums.items():
            (lang, a), (_, b) = named[x // k], named[x % k]
            yield lang, a, b, Decimal(total)


def tree_corrections(paths: DataFrame) -> DataFrame:
    """(lang, source, item, change) from rows (lang, path, times): what terms of both
    sources add, by trees over ranges of rows that begin alike."""

    def out(tree: Tree) -> pa.RecordBatch:
        rows = list(zip(*tree.corrections())) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in rows[:3]], pa.array(rows[3], pa.decimal128(38, 0))], names=["lang", "source", "item", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree()
        for batch in batches:
            path = batch.column(1)
            ends, items = path.offsets.to_pylist(), path.values
            entries = list(zip(*(items.field(c).to_pylist() for c in range(3))))
            for lang, a, b, times in zip(batch.column(0).to_pylist(), ends, ends[1:], batch.column(2).to_pylist()):
                tree.insert(lang, entries[a:b], times)
                if len(tree.parent) > NODES:
                    yield out(tree)
                    tree = Tree()
        yield out(tree)

    dealt = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return dealt.mapInArrow(run, f"lang string, source string, item string, change {EXACT}")


def ranked(values: DataFrame) -> DataFrame:
    """With ``rank``: greatest value first, then the item in the order of its UTF-8 bytes."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return values.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the divergence of each
    source from each other source of its language. Part ``term``: the ``term_ranks`` terms
    that the source uses most above its language."""
    blank = needed(docs, text=text, lang=lang, source=source).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = materialize(term_rows(blank, least_documents), "term-rows")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    entries = rows.select("lang", "term", F.col("n").alias("lang_n"), F.inline("sources"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = blank.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")])
    groups = materialize(groups.withColumn("absent", share(zero, F.col("total"), F.col("kept"))), "term-groups")
    small = size_bounded(groups, GROUPS)

    items = entries.join(small, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = items.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = ranked(above).filter(F.col("rank") <= term_ranks)

    path = F.sort_array(F.collect_list(F.struct("source", "p", "absent")))
    paths = materialize(items.groupBy("lang", "term").agg(path.alias("path")).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")), "term-paths")
    # what one source's own terms change: equal shares of a source are one row
    alone = paths.select("lang", F.inline("path"), "times").groupBy("lang", "source", "p", "absent").agg(F.sum("times").alias("times"))
    other = small.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"))
    p, mine, its = F.col("p"), F.col("absent"), F.col("other")
    away, back = divergence(p, its) - divergence(mine, its), divergence(its, p) - divergence(its, mine)
    times = F.col("times").cast(EXACT)
    ways = F.array(F.struct("source", "item", (away * times).cast(EXACT).alias("change")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (back * times).cast(EXACT).alias("change")))
    single = alone.join(other, "lang").filter("source <> item").select("lang", F.inline(ways))
    # all terms absent from both
    pairs = groups.join(other, "lang").filter("source <> item")
    none = F.when(F.col("kept") > 0, F.col("kept").cast("decimal(19,0)") * divergence(mine, its).cast("decimal(19,0)")).otherwise(0)
    base = pairs.select("lang", "source", "item", none.cast(EXACT).alias("change"))
    value = base.unionByName(single).unionByName(tree_corrections(paths)).groupBy("lang", "source", "item").agg(F.sum("change").cast("long").alias("value"))
    parts = [("pair", ranked(value)), ("term", terms)]
    named = [d.select("lang", "source", F.lit(n).alias("part"), "item", "value", "rank") for n, d in parts]
    return named[0].unionByName(named[1])


AUDIT_SQL = r"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row_no from documents),
words as (select row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from words group by lang, term having count(distinct row_no) >= 3),
n as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
total as (select lang, source, sum(n) as t from n group by lang, source),
p as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 1)) // (coalesce(t.t, 0) + v.v) as p
  from groups g join kept k using (lang) join v using (lang) left join total t using (lang, source) left join n using (lang, source, term)
),
whole as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // ((select sum(t) from total where total.lang = n.lang) + (select v from v where v.lang = n.lang)) as q
  from n group by lang, term
),
pairs as (
  select g.lang, g.source, o.source as item, coalesce(s.value, 0) as value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) s
    on s.lang = g.lang and s.source = g.source and s.item = o.source
),
terms as (select p.lang, p.source, p.term as item, (p.p - q) * (p.p - q) // q as value from p join whole using (lang, term) where p.n > 0 and p.p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 200
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
"""
