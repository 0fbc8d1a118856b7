"""Tiled exact comparison of binary fingerprints.

Rows (id, cell, f0, f1, ...) fall into cells such that only rows of cells a fixed offset
apart can be near each other; a cell is cut by a hash of the id into tiles of bounded
size. A group of the comparison holds one tile and the tiles near it, as packed arrays.
Within a group numpy forms exclusive-ors and counts bits, block by block, and skips blocks
whose population counts differ beyond the radius. Found pairs are not written: a group
returns a spanning forest of its links, at most one row for each row it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import materialize

BLOCK = 4_000_000


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the sets of i and j in ``label`` (updated in place); returns the links used.
    In every round each set hooks at most once, to a smaller one."""
    used_i, used_j = [], []
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        high, first = np.unique(np.maximum(a, b), return_index=True)
        used_i.append(i[first])
        used_j.append(j[first])
        label[high] = np.minimum(a, b)[first]
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
    empty = np.zeros(0, np.int64)
    return (np.concatenate(used_i), np.concatenate(used_j)) if used_i else (empty, empty)


def closest(i: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest d for every value of i."""
    order = np.lexsort((d, i))
    start = np.r_[0, np.flatnonzero(np.diff(i[order])) + 1]
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < k]


def near(own: np.ndarray, other: np.ndarray, radius: int, inner: bool = True, nearest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs within ``radius`` bits: of ``own`` [n, w] with
    ``other`` [m, w] and, if ``inner``, with own. Nearest pairs first within a block.
    Indexes run over own, then other. ``nearest`` adds that many closest pairs of each row
    of a block, for links that are checked again later."""
    every = np.concatenate([own, other])
    bits = np.bitwise_count(every).sum(1, dtype=np.int32)
    n = len(own)
    mine = np.argsort(bits[:n], kind="stable")
    order = np.argsort(bits, kind="stable") if inner else n + np.argsort(bits[n:], kind="stable")
    ranked = bits[order]
    label = np.arange(len(every))
    out = []
    rows = max(16, BLOCK // max(1, len(order)))
    for a in range(0, n, rows):
        block = mine[a : a + rows]
        lo, hi = np.searchsorted(ranked, bits[block[0]] - radius), np.searchsorted(ranked, bits[block[-1]] + radius, side="right")
        for c in range(lo, hi, BLOCK // 16):
            cols = order[c : min(hi, c + BLOCK // 16)]
            far = np.bitwise_count(every[block, 0][:, None] ^ every[cols, 0][None, :])
            for k in range(1, every.shape[1]):
                far = far + np.bitwise_count(every[block, k][:, None] ^ every[cols, k][None, :])
            r, s = np.nonzero(far <= radius)
            i, j, d = block[r], cols[s], far[r, s]
            if nearest:
                other_row = i != j
                i, j, d = i[other_row], j[other_row], d[other_row]
                if len(i):
                    some = np.union1d(closest(i, d, nearest), closest(j, d, nearest))
                    out.append((i[some], j[some]))
            apart = label[i] != label[j]
            i, j, d = i[apart], j[apart], d[apart]
            for level in np.unique(d):
                at = d == level
                out.append(merge(label, i[at], j[at]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def links(rows: DataFrame, words: int, radius: int, offsets: list[int], tile: int, purpose: str, nearest: int = 0) -> DataFrame:
    """(u, v): links whose components are those of all pairs within ``radius``. ``rows``
    has id (bigint, unique), cell (bigint) and f0..f{words-1} (bigint). ``offsets`` holds 0
    and one of each pair of opposite cell offsets."""
    fs = [f"f{k}" for k in range(words)]
    sizes = materialize(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), f"{purpose}-cells")
    # cells are combinations of a few small counts: their number is bounded by the layout
    own = F.broadcast(sizes)
    tiled = rows.join(own, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiled = tiled.groupBy("cell", "part").agg(F.collect_list(F.struct("id", *fs)).alias("_rows"))
    tiled = tiled.select("cell", "part", F.col("_rows.id").alias("id"), *[F.col(f"_rows.{f}").alias(f) for f in fs])
    tiled = materialize(tiled, f"{purpose}-tiles")
    # a group: a target tile, and of the cells near it the tiles of one part number
    away = tiled.withColumn("_off", F.explode(F.array(*[F.lit(o).cast("long") for o in offsets])))
    away = away.withColumn("target", F.col("cell") + F.col("_off"))
    away = away.join(F.broadcast(sizes.select(F.col("cell").alias("target"), "tiles")), "target")
    away = away.withColumn("tpart", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    away = away.filter((F.col("_off") != 0) | (F.col("part") < F.col("tpart")))
    cols = ["target", "tpart", "with", "own", "id", *fs]
    away = away.select("target", "tpart", F.col("part").alias("with"), F.lit(False).alias("own"), "id", *fs)
    # a tile waits for as many parts as the largest cell that is compared with its own has
    spread = sizes.select("cell", "tiles", F.explode(F.array(*[F.lit(o).cast("long") for o in offsets])).alias("_o"))
    near_by = spread.groupBy((F.col("cell") + F.col("_o")).alias("cell")).agg(F.max("tiles").alias("_w"))
    home = tiled.join(F.broadcast(near_by), "cell").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
    home = home.select(F.col("cell").alias("target"), F.col("part").alias("tpart"), "with", F.lit(True).alias("own"), "id", *fs)

    def compare(t: pa.Table) -> pa.Table:
        mine = np.array(t.column("own").to_pylist(), bool)

        def gather(c, rows):
            parts = [x.values.to_numpy(zero_copy_only=False) for x, r in zip(t.column(c).combine_chunks(), mine) if r == rows]
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        ids = np.concatenate([gather("id", True), gather("id", False)])
        own = np.stack([gather(f, True) for f in fs], axis=1).view(np.uint64)
        other = np.stack([gather(f, False) for f in fs], axis=1).view(np.uint64)
        i, j = near(own, other, radius, t.column("with")[0].as_py() == 0, nearest)
        return pa.table({"u": ids[i], "v": ids[j]})

    both = home.select(*cols).unionByName(away.select(*cols))
    return both.groupBy("target", "tpart", "with").applyInArrow(compare, "u long, v long")
