"""SimHash near-dedup by tiled exact comparison (numpy exclusive-or and bit counts).

A fingerprint bit is set where over half of the shingle hashes have it. Equal fingerprints
collapse first, by a pre-aggregated group; the distinct ones are compared in tiles.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any
other; fewer words than a shingle give one shingle of them all; rows that share a doc_id
count by their fingerprints; rows without doc_id take their group's id but name none (null if no other
does); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import tiles
from panelkit.llm.common import connected_components, size_bounded, unwrapped, wrapped
from panelkit.session import materialize

SEED = 42
#: Ids up to which a decision table is broadcast (16 bytes a row).
BROADCAST_IDS = 2_000_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of all k-word shingles of the whole text, ASCII lower-cased, repeats included."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if n else [], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64, n - k + 1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits from a hash; k = 0 gives the hash itself."""
    if k == 0:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> list[int]:
    """``words`` 64-bit parts, as signed integers."""
    out = []
    for k in range(words):
        counts = np.zeros(64, np.int64)
        for a in range(0, len(h), 255 * 256):
            part = _mixed(h[a : a + 255 * 256], k)
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            whole = len(bits) // 255 * 255
            # 255 ones fit into a byte, so bytes are added first
            counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big", signed=True))
    return out


def exact_copy(text: str | None) -> int:
    """A hash of the normalised words."""
    return int.from_bytes(hashlib.blake2b(b" ".join((text or "").encode().lower().split()), digest_size=8).digest(), "big", signed=True)


def fingerprints(df: DataFrame, k: int, words: int = 1, text: str = "text", repeats: bool = True) -> DataFrame:
    """(doc_id, f0.., n_shingles distinct, same): ``same`` hashes the normalised words, so
    equal values are exact copies. ``repeats`` tells whether a repeated shingle counts
    each time or once. One pass over whole texts."""
    fs = [f"f{i}" for i in range(words)]
    schema = "doc_id long, " + "".join(f"{f} long, " for f in fs) + "n_shingles long, same long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, n, same = [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, k)
                once = np.unique(h)
                prints.append(fingerprint(h if repeats else once, words))
                n.append(len(once))
                same.append(exact_copy(t))
            cols = [b.column("doc_id"), *[pa.array([p[i] for p in prints], pa.int64()) for i in range(words)], pa.array(n, pa.int64()), pa.array(same, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *fs, "n_shingles", "same"])

    return df.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, schema)


def quarter_cells(radius: int) -> list[int]:
    """Offsets between cells of four 16-bit population counts (five bits each) whose
    counts differ by ``radius`` in sum at most; one of each opposite pair."""
    steps = range(-radius, radius + 1)
    near = (d for d in product(steps, repeat=4) if sum(map(abs, d)) <= radius)
    return sorted({o for d in near if (o := sum(x << 5 * i for i, x in enumerate(d))) >= 0})


def components(documents: DataFrame, k: int = 3, radius: int = 3, tile: int = 16_384) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints at most ``radius`` bits apart are
    linked; component_id is the smallest doc_id reachable, itself included."""
    own = materialize(fingerprints(documents, k).select("doc_id", "f0"), "simhash")
    groups = materialize(own.groupBy("f0").agg(F.min("doc_id").alias("id")), "simhash-groups")
    quarters = [F.bit_count(F.shiftrightunsigned("f0", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    cell = sum((F.shiftleft(q.cast("long"), 5 * i) for i, q in enumerate(quarters)), F.lit(0).cast("long"))
    # rows that share a doc_id: the first of their fingerprints names the node, links join the others
    rows = groups.filter("id is not null").select("id", cell.alias("cell"), "f0")
    found = tiles.links(rows, 1, radius, quarter_cells(radius), tile, "simhash")
    joined = connected_components(found, "simhash-cc")
    named = groups.join(joined, groups["id"] == joined["node"], "left").select("f0", F.coalesce("component", "id").alias("component_id"))
    named = materialize(named, "simhash-named")
    return own.join(named, "f0", "left").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar_links(own: list[np.ndarray], other: list[np.ndarray], prints: np.ndarray, radius: int, similarity: float, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs whose fingerprints (``prints`` [n + m, w], own first) lie
    within ``radius`` bits and whose sets have at least this Jaccard similarity: of own
    with own if ``inner``, else of own with other. Every such pair is compared exactly;
    indexes run over own, then other."""
    sets, n = own + other, len(own)
    size = np.array([len(x) for x in sets], np.int64)
    close = np.arange(len(sets)), []  # components of the pairs within the radius, and the pairs
    cols = np.arange(n) if inner else np.arange(n, len(sets))
    for i in range(n):
        to = cols[cols > i]
        far = np.bitwise_count(prints[i] ^ prints[to]).sum(1, dtype=np.int32)
        allowed = np.minimum(size[i], size[to]) >= similarity * np.maximum(size[i], size[to])
        j = to[(far <= radius) & allowed]
        if len(j):
            close[1].append((np.full(len(j), i), j))
    if not close[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*close[1]))
    tiles.merge(close[0], i, j)
    order = np.argsort(close[0][i], kind="stable")
    i, j = i[order], j[order]
    both = np.zeros(len(i), np.int64)
    starts = np.r_[0, np.flatnonzero(np.diff(close[0][i])) + 1, len(i)]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a == 1:
            both[a] = len(np.intersect1d(sets[i[a]], sets[j[a]], assume_unique=True))
        else:
            rows, at = np.unique(np.r_[i[a:b], j[a:b]], return_inverse=True)
            both[a:b] = _shared([sets[r] for r in rows], at[: b - a], at[b - a :])
    holds = both >= similarity * (size[i] + size[j] - both)
    return tiles.merge(np.arange(len(sets)), i[holds], j[holds])


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, wide: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets i and j. Hashes that the same sets hold count as
    one with a weight; the sums are products of the membership matrix."""
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    first = np.r_[True, h[1:] != h[:-1]]
    token = np.cumsum(first) - 1
    sign = np.add.reduceat(_mixed(row.astype(np.uint64), 1), np.flatnonzero(first))
    _, column, weight = np.unique(sign, return_inverse=True, return_counts=True)
    column = column[token]
    out = np.zeros((len(sets), len(sets)))
    for a in range(0, len(weight), wide):
        at = (column >= a) & (column < a + wide)
        member = np.zeros((len(sets), min(wide, len(weight) - a)))
        member[row[at], column[at] - a] = 1
        out += (member * weight[a : a + wide]) @ member.T
    return np.rint(out[i, j]).astype(np.int64)


def similar(documents: DataFrame, nodes: DataFrame, proposed: DataFrame, k: int, similarity: float, radius: int, tile: int = 512, tile_bytes: int = 16_000_000) -> DataFrame:
    """(u, v): links whose components are those of all pairs of nodes within ``radius``
    bits whose sets of k-word shingles have at least this Jaccard similarity.

    ``nodes`` (doc_id, same, f0, f1, n_shingles) names a text for each node; ``proposed``
    holds a spanning forest of the pairs within the radius. All pairs lie inside its
    components, so the components are dealt to cells by a hash and a cell is cut into
    tiles, bounded in rows and in mean bytes; any two tiles of a cell meet in one group.
    """
    crowds = connected_components(proposed, "similar-crowds")
    rows = materialize(nodes.join(crowds, nodes["same"] == crowds["node"]).drop("node"), "similar-rows")
    cells = max(1, -(-rows.count() // 32))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("component"), F.lit(cells)))
    sizes = rows.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n_shingles") * 8 / tile_bytes), F.lit(1)).cast("int").alias("tiles"))
    placed = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("same"), F.col("tiles")).cast("int"))
    placed = materialize(placed.select("doc_id", F.col("same").alias("node"), "cell", "part", "tiles", "f0", "f1"), "similar-placed")
    kept = ["node", "cell", "part", "tiles", "f0", "f1"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.unique(shingle_hashes(t, k)).tobytes() if exact_copy(t) == s else None for t, s in zip(b.column("text").to_pylist(), b.column("node").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(packed, pa.binary())], names=[*kept, "h"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").join(size_bounded(placed, BROADCAST_IDS), "doc_id").select(*kept, "text")
    one = texts.mapInArrow(sets, "node long, cell long, part int, tiles int, f0 long, f1 long, h binary").filter("h is not null")
    # a node's rows are copies of one text
    one = materialize(one.groupBy(*kept).agg(F.max("h").alias("h")), "similar-sets")
    home = one.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("part")))).withColumn("tpart", F.col("part")).withColumn("own", F.lit(True))
    away = one.filter("part < tiles - 1").withColumn("tpart", F.explode(F.sequence(F.col("part") + 1, F.col("tiles") - 1))).withColumn("with", F.col("part")).withColumn("own", F.lit(False))
    cols = ["cell", "tpart", "with", "own", "node", "f0", "f1", "h"]

    def compare(t: pa.Table) -> pa.Table:
        mine = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        order = np.r_[np.flatnonzero(mine), np.flatnonzero(~mine)]
        h = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
        prints = np.stack([t.column(f).to_numpy() for f in ("f0", "f1")], axis=1).view(np.uint64)[order]
        node, n = t.column("node").to_numpy()[order], int(mine.sum())
        inner = t.column("with")[0].as_py() == t.column("tpart")[0].as_py()
        h = [h[x] for x in order]
        i, j = similar_links(h[:n], h[n:], prints, radius, similarity, inner)
        return pa.table({"u": node[i], "v": node[j]})

    return home.select(*cols).unionByName(away.select(*cols)).groupBy("cell", "tpart", "with").applyInArrow(compare, "u long, v long")


def deduplicated(documents: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 32, tile: int = 2048) -> DataFrame:
    """The documents without near copies: of every group one stays, the smallest doc_id.

    Exact copies (equal words) collapse first. All pairs of 128-bit fingerprints within
    ``radius`` bits whose numbers of distinct shingles allow the similarity are checked
    exactly on the shingle sets; a spanning forest finds where such pairs can be. Rows without
    doc_id can't be named and stay. Of rows that share a doc_id the smallest row stays.
    """
    # `same` names a node: copies share one text, so any of their rows serves
    own = materialize(fingerprints(documents, k, 2, repeats=False).filter("doc_id is not null"), "dedup")
    nodes = materialize(own.groupBy("same").agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("f0", "f1", "n_shingles")]), "dedup-nodes")
    step = F.floor(F.log(F.greatest("n_shingles", F.lit(1))) / F.log(F.lit(1 / similarity)) + 1e-9)
    rows = nodes.select(F.col("same").alias("id"), step.cast("long").alias("cell"), "f0", "f1")
    proposed = materialize(tiles.links(rows, 2, radius, [0, 1], tile, "dedup").distinct(), "dedup-proposed")
    checked = similar(documents, nodes, proposed, k, similarity, radius)
    joined = connected_components(materialize(checked, "dedup-links"), "dedup-cc")
    group = F.coalesce("component", "same")
    kept = nodes.join(joined, nodes["same"] == joined["node"], "left").groupBy(group.alias("g")).agg(F.min("doc_id").alias("_kept"))
    kept = materialize(kept.select("_kept").distinct(), "dedup-kept")
    rows = wrapped(documents).withColumn("_id", F.col("_row")["doc_id"])
    out = rows.join(size_bounded(kept, BROADCAST_IDS), F.col("_id") == F.col("_kept"), "left_semi")
    twice = materialize(own.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice")), "dedup-twice")
    if not twice.isEmpty():
        repeated = out.join(twice, F.col("_id") == F.col("_twice"), "left_semi")
        one = repeated.groupBy("_id").agg(F.min("_row").alias("_row")).select("_row", "_id")
        out = out.join(twice, F.col("_id") == F.col("_twice"), "left_anti").unionByName(one)
    return unwrapped(out.unionByName(rows.filter("_id is null")), documents.columns)
