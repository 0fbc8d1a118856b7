"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each with its own codebook; a row belongs to the cell of
its two nearest centroids. A query visits cells in the order of its summed nearness to both
centroids, taken from a heap, until the cells hold ``share`` of all rows, and reranks every
entry of the visited cells by the exact inner product. Codebooks are fitted on a bounded
sample; every row is indexed.

The number of cells follows the square root of the rows (``codewords``). Where the visit
stops is measured, not guessed: ``needed_share`` finds on the bounded sample which share of
the rows holds ``recall`` of the true neighbours. Clustered vectors need a small share,
uniform ones most rows. True neighbours in the whole table lie nearer than those in the
sample, so the share errs to the large side.

Entries lie in blocks of neighbouring cells with at most ``block`` rows (larger cells are
cut by a hash of the id); queries meet them in tiles of ``tile`` rows, so one group holds a
block and a tile and never more. A query goes to a block with those of its cells that lie
there, so all its cells are sent once.

Defined cases: vectors null, zero or with null or non-finite components, and vectors of
another length than most, take no part; of repeated ids the smallest usable vector counts; null
ids are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import extended
from panelkit.llm.vectors import common_size, matrix, one_per_id, usable
from panelkit.session import materialize

RESULT = "query_id long, rank int, vec_id long, score double"


def codebook(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """At most ``k`` centroids by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(rows, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, rows)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * rows @ c.T).argmin(1)


def codewords(rows: int, most: int = 256) -> int:
    """Centroids of each half for so many rows: 16 at ten thousand, growing so that the
    cells follow the square root of the rows."""
    return int(min(most, max(4, round(1.6 * rows**0.25))))


def needed_share(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], half: int, neighbours: int, recall: float, asked: int = 400) -> float:
    """The share of rows that a visit has to hold so that ``recall`` of the neighbours
    among the sampled rows ``x`` are in it, over ``asked`` of them as queries."""
    n, width = len(x), len(books[1])
    most = min(neighbours, n - 1)
    if most < 1:
        return 1.0
    cell = nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * width)
    shares = []
    for i in range(min(asked, n)):
        score = x @ x[i]
        score[i] = -np.inf
        true = np.argpartition(-score, most - 1)[:most]
        near = ((books[0] @ x[i, :half])[:, None] + (books[1] @ x[i, half:])[None, :]).ravel()
        order = np.argsort(-near, kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(counts[order])
        # a visit that holds less than this stops before the neighbour's cell
        shares.append((held[cell[true]] - counts[cell[true]] + 1) / n)
    return float(np.quantile(np.concatenate(shares), recall, method="higher"))


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells in falling order of first[i] + second[j] until they hold ``enough`` rows.
    ``counts`` [i, j] are rows in a cell."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    fa, fb = first[a], second[b]
    heap, opened = [(-(fa[0] + fb[0]), 0, 0)], {(0, 0)}
    out, rows = [], 0
    while heap and rows < enough:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            out.append(int(a[i]) * counts.shape[1] + int(b[j]))
            rows += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in opened:
                opened.add((x, y))
                heapq.heappush(heap, (-(fa[x] + fb[y]), x, y))
    return out


def best(entries: np.ndarray, ids: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of the candidates with ``rough`` scores (others are
    -inf). Scores are summed row by row, the same way for equal vectors wherever they lie."""
    some = np.isfinite(rough).sum()
    if some == 0:
        return ids[:0], rough[:0]
    edge = np.partition(rough, len(rough) - min(k, some))[len(rough) - min(k, some)]
    near = np.flatnonzero(rough >= edge - 1e-9 * max(1.0, abs(edge)))
    exact = (entries[near] * query).sum(1)
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near][order], exact[order]


def search(embeddings: DataFrame, every: int = 20, neighbours: int = 20, k: int | None = None, share: float | None = None, recall: float = 0.96, sample: int = 8000, block: int = 4096, tile: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``
    its ``neighbours`` nearest other rows by inner product, ties to the smaller id. ``k``
    codewords of each half and the visited ``share`` follow the table unless given."""
    spark = embeddings.sparkSession
    rows = materialize(one_per_id(embeddings).filter(usable("embedding")), "imi-rows")
    dim = common_size(rows)
    rows = rows.filter(F.size("embedding") == dim)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # ``sample`` rows at most
    if not drawn:
        return spark.createDataFrame([], RESULT)
    x = np.array([r["embedding"] for r in drawn], np.float64)
    half = max(1, dim // 2)
    k = k or codewords(rows.count())
    books = (codebook(x[:, :half], k), codebook(x[:, half:], k) if dim > 1 else np.zeros((1, 0)))
    shape = (len(books[0]), len(books[1]))
    share = share or needed_share(x, books, half, neighbours, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("embedding"), dim)
            cell = nearest(m[:, :half], books[0]) * shape[1] + nearest(m[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cell.astype(np.int32))], names=["vec_id", "embedding", "cell"])

    index = materialize(rows.mapInArrow(assign, extended(rows, rows.columns, "cell int")), "imi-index")
    counts = np.zeros(shape[0] * shape[1], np.int64)
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # k * k rows at most
        counts[r["cell"]] = r["n"]
    # blocks: runs of neighbouring cells, large cells in several parts
    first_block, parts, at, held = np.zeros(len(counts), int), np.ones(len(counts), int), 0, 0
    for c, n in enumerate(counts):
        if n > block:
            at, held = at + (held > 0), 0
            first_block[c], parts[c] = at, -(-n // block)
            at += parts[c]
        elif n:
            if held + n > block:
                at, held = at + 1, 0
            first_block[c] = at
            held += n
    enough = max(share * counts.sum(), neighbours + 1)  # the query's own row too
    grid = counts.reshape(shape)
    asked = index.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    tiles = max(1, -(-asked.count() // tile))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("embedding"), dim)
            visits = []
            for f, s in zip(q[:, :half] @ books[0].T, q[:, half:] @ books[1].T):
                there: dict[int, list[int]] = {}
                for c in visit(f, s, grid, enough):
                    for x in range(first_block[c], first_block[c] + parts[c]):
                        there.setdefault(int(x), []).append(c)
                visits.append([{"block": x, "cells": v} for x, v in there.items()])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(visits, of_visit)], names=["vec_id", "embedding", "visits"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, part = b.column("cell").to_numpy(), b.column("part").to_numpy()
            block = first_block[cell] + part % parts[cell]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), b.column("cell"), pa.array(block.astype(np.int32))], names=["vec_id", "embedding", "cell", "block"])

    of_visit = pa.list_(pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))]))
    planned = asked.mapInArrow(plan, extended(asked, asked.columns, "visits array<struct<block: int, cells: array<int>>>"))
    planned = materialize(planned.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")), "imi-queries")
    asks = planned.select("vec_id", "embedding", "tile", F.explode("visits").alias("_v")).select("vec_id", "embedding", "tile", "_v.cells", "_v.block")
    numbered = index.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(2**31 - 1)))
    placed = numbered.mapInArrow(place, extended(index, index.columns, "block int"))
    met = materialize(asks.select("block", "tile").distinct(), "imi-met")  # a block meets the tiles that visit it
    placed = placed.join(met, "block")

    def rerank(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if entries.num_rows and queries.num_rows:
            m, q = matrix(entries.column("embedding"), dim), matrix(queries.column("embedding"), dim)
            ids, cell = entries.column("vec_id").to_numpy(), entries.column("cell").to_numpy()
            rough = q @ m.T
            for i, (qid, cells) in enumerate(zip(queries.column("vec_id").to_pylist(), queries.column("cells").to_pylist())):
                seen = np.zeros(len(counts), bool)
                seen[cells] = True
                v, s = best(m, ids, q[i], np.where(seen[cell] & (ids != qid), rough[i], -np.inf), neighbours)
                out_q.append(np.full(len(v), qid))
                out_v.append(v)
                out_s.append(s)
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    found = placed.groupBy("block", "tile").cogroup(asks.groupBy("block", "tile")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
