"""Embedding near-dedup: random-hyperplane signs, exact cosines, connected components.

Equal vectors collapse first. The others get one signature of ``bits`` hyperplane signs in
each of several tables; vectors that share a bucket are compared exactly in double
precision. The number of bits follows the number of vectors, and the number of tables the
bits, so that a pair at the threshold is missed with probability ``miss`` at any size.

A bucket compares its rows in numpy and returns how many new links each vector has and a
spanning forest of them, never the pairs: a pair counts in the first table where it meets.
Buckets above ``part`` rows are cut, and their parts meet in pairs.

Defined cases: vectors null, zero or with null or non-finite components link with nothing
and are their own component; vectors of another length never share a bucket with the rest;
of repeated ids the smallest usable vector counts; rows without id are returned with no links, no
component and kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import connected_components, extended, size_bounded
from panelkit.llm.tiles import merge
from panelkit.llm.vectors import common_size, matrix, one_per_id, usable
from panelkit.session import materialize

#: Bucket rows compared at once against a whole bucket.
ROWS = 1024
#: Copies above which a vector's rows stay where they are in the last join.
MANY = 100_000


def layout(vectors: int, cosine: float, miss: float, bucket: int = 256) -> tuple[int, int]:
    """(bits, tables)."""
    bits = max(8, math.ceil(math.log2(max(vectors, 1) / bucket)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def compared(x: np.ndarray, weight: np.ndarray, signs: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, list]:
    """New links per row and forest links among pairs (left, right) of a bucket's rows;
    with left and right the same, every pair once."""
    same = left is right
    label, links, forest = np.arange(len(x)), np.zeros(len(x)), []
    for a in range(0, len(left), ROWS):
        rows = left[a : a + ROWS]
        for b in range(a if same else 0, len(right), 4 * ROWS):
            cols = right[b : b + 4 * ROWS]
            r, c = np.nonzero(x[rows] @ x[cols].T >= cosine)
            i, j = rows[r], cols[c]
            if same:
                once = np.arange(len(x))[i] < j if a == b else i < j
                i, j = i[once], j[once]
            for k in range(0, len(i), 1_000_000):
                p, q = i[k : k + 1_000_000], j[k : k + 1_000_000]
                fresh = np.ones(len(p), bool)
                for t in range(table):
                    fresh &= signs[p, t] != signs[q, t]
                p, q = p[fresh], q[fresh]
                links += np.bincount(p, weight[q], len(x)) + np.bincount(q, weight[p], len(x))
                forest.append(merge(label, p, q))
    return links, forest


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, miss: float = 1e-3, part: int = 4096, bundle: int = 20_000, many: int = MANY, seed: int = 23) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector: links are pairs with at least
    this cosine; component_id is the smallest id reachable; kept marks those."""
    every = materialize(one_per_id(embeddings), "lsh-rows")
    good = every.filter(usable("embedding"))
    dim = common_size(good)
    groups = good.filter(F.size("embedding") == dim).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups, "lsh-groups")
    n = groups.count()
    bits, tables = layout(n, cosine, miss)
    planes = np.random.default_rng(seed).normal(size=(max(dim, 1), tables * bits))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("embedding"), dim)
            s = ((m @ planes > 0).reshape(len(m), tables, bits) @ powers).astype(np.int32)
            packed = [r.tobytes() for r in s]
            yield pa.RecordBatch.from_arrays([b.column("embedding"), b.column("rep"), b.column("copies"), pa.array(packed, pa.binary()), pa.array(list(s), pa.list_(pa.int32()))], names=["embedding", "rep", "copies", "signs", "buckets"])

    signed = materialize(groups.mapInArrow(sign, extended(groups, groups.columns, "signs binary, buckets array<int>")), "lsh-signs")
    spread = signed.select("*", F.posexplode("buckets").alias("t", "bucket")).drop("buckets")
    sizes = signed.select(F.posexplode("buckets").alias("t", "bucket")).groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    sizes = materialize(sizes.filter("parts > 1"), "lsh-sizes")
    cut = spread.join(size_bounded(sizes, 1_000_000), ["t", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumns({"low": F.least("own", "mate"), "high": F.greatest("own", "mate")})
    # small buckets share a group, parts of large ones have their own
    bundles = max(1, n * tables // bundle)
    shared = F.pmod(F.xxhash64("t", "bucket"), F.lit(bundles))
    cut = cut.withColumn("g", F.when(F.col("parts") == 1, shared).otherwise(F.xxhash64("t", "bucket", "low", "high", F.lit(1))))

    def compare(t: pa.Table) -> pa.Table:
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy().astype(float)
        x = matrix(t.column("embedding"), dim)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        signs = np.frombuffer(b"".join(t.column("signs").to_pylist()), np.int32).reshape(-1, tables)
        keys = np.stack([t.column(c).to_numpy() for c in ("t", "bucket", "low", "high")], axis=1)
        own = t.column("own").to_numpy()
        order = np.lexsort(keys.T)
        edges = np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(1)) + 1
        us, vs, ns = [], [], []
        for rows in np.split(order, edges):
            if len(rows) < 2:
                continue
            table, _, low, high = keys[rows[0]]
            side = np.arange(len(rows))
            left, right = (side, side) if low == high else (side[own[rows] == low], side[own[rows] == high])
            links, forest = compared(x[rows], copies[rows], signs[rows], int(table), left, left if low == high else right, cosine)
            some = np.flatnonzero(links)
            us.append(rep[rows][some])
            vs.append(rep[rows][some])
            ns.append(links[some])
            for i, j in forest:
                us.append(rep[rows][i])
                vs.append(rep[rows][j])
                ns.append(np.zeros(len(i)))
        join = lambda p, k: np.concatenate(p).astype(k) if p else np.zeros(0, k)
        return pa.table({"u": join(us, np.int64), "v": join(vs, np.int64), "n": join(ns, np.int64)})

    columns = ["g", "t", "bucket", "low", "high", "own", "rep", "copies", "signs", "embedding"]
    found = materialize(cut.select(*columns).groupBy("g").applyInArrow(compare, "u long, v long, n long"), "lsh-found")
    linked = found.filter("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    joined = connected_components(found.filter("u <> v").select("u", "v"), "lsh-cc").withColumnRenamed("node", "rep")
    named = groups.join(linked, "rep", "left").join(joined, "rep", "left")
    named = named.select(F.col("embedding").alias("_e"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, "lsh-named")
    # a very common vector would be one task of the join; there are at most rows / MANY of them
    hot = size_bounded(named.filter(F.col("copies") > many), 10_000)
    same = F.col("embedding") == F.col("_e")
    rare = every.join(hot, same, "left_anti").join(named.filter(F.col("copies") <= many), same, "left")
    out = every.join(hot, same).unionByName(rare)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    nameless = embeddings.filter("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)
