"""Helpers that several operators share: tables, written intermediates, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelkit.session import materialize

#: What the contracts call a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def needed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names; whatever else the
    input holds, also under clashing names, stays out of the plan."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def wrapped(df: DataFrame, name: str = "_row") -> DataFrame:
    """All columns as one struct, so that an operator's own columns clash with none."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unwrapped(df: DataFrame, columns: list[str], name: str = "_row", **changed: Column) -> DataFrame:
    """The columns of ``wrapped`` rows again, with some of them changed."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(name)[c].alias(c) for c in columns])


def extended(df: DataFrame, keep: list[str] | tuple[str, ...], more: str) -> StructType:
    """The schema of the columns ``keep`` followed by those of a DDL string."""
    return StructType([*[df.schema[c] for c in keep], *StructType.fromDDL(more).fields])


def size_bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marks a frame for broadcast once its row count is known to be at most ``rows``;
    a larger frame is left to Spark's own choice of join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the split of the labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def labelled_sample(labels: DataFrame, label: str, divisor: int, left_out: int, bound: int) -> DataFrame:
    """(doc_id, y) of at most ``bound`` labelled documents that the split leaves for
    fitting, chosen by a hash of the id. Null ids or labels and ids labelled both ways
    take no part; repeated rows count once."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().filter(remainder("doc_id", divisor) != left_out)
    one = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_hi")).filter("y = _hi and y in (0, 1)").drop("_hi")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def balanced_sample(labels: DataFrame, label: str, divisor: int, left_out: int, bound: int) -> DataFrame:
    """As ``labelled_sample``, with at most half of the bound for either class."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y"))
    halves = [labelled_sample(rows.filter(F.col("y") == y).join(rows.filter(F.col("y") == 1 - y).select("doc_id"), "doc_id", "left_anti"), "y", divisor, left_out, bound // 2) for y in (0, 1)]
    return halves[0].unionByName(halves[1])


def fitting_rows(documents: DataFrame, sample: DataFrame, bytes_bound: int, purpose: str, text: str = "text") -> DataFrame:
    """(doc_id, y, text) of a bounded labelled sample, as a written table: one row per id
    (of repeated ids the smallest text, before anything is gathered), and texts of at most
    ``bytes_bound`` bytes together, taken in the order of the ids' hashes."""
    docs = needed(documents, doc_id="doc_id", text=text).join(F.broadcast(sample), "doc_id")
    rows = materialize(docs.groupBy("doc_id", "y").agg(F.min("text").alias("text")), f"{purpose}-rows")
    # a window over the sample's ids and sizes, which the sample's bound bounds
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_n")).withColumn("_sum", F.sum("_n").over(before))
    return rows.join(F.broadcast(sizes.filter(F.col("_sum") <= bytes_bound).select("doc_id")), "doc_id", "left_semi")


def _fingerprint_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) of every node that has a link to another; component is the
    smallest node reachable. ``edges`` has bigint columns u and v in any order.

    Alternating large and small stars: each round connects neighbours to the smallest
    node seen around a node, until only stars are left (a logarithmic number of rounds
    in practice). Minima are pre-aggregated; every round is a written table, so a hub's
    rows can be split by a skewed join and lost executors cost one round.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = materialize(edges.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct(), f"{purpose}-0")
    seen, k = _fingerprint_of(now), 0
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{purpose}-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), f"{purpose}-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{purpose}-least")
        to_min = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        now = materialize(to_min.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{purpose}-{k}")
        after = _fingerprint_of(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
