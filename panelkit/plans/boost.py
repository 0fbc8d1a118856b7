"""Boosted trees fitted side by side: a task fits whole models, many tasks at once.

MLlib grows one tree of one model at a time and starts a few jobs for each of its levels.
A walk-forward has one model per month and horizon and hundreds of trees in each, which is
several hundred thousand jobs, however few the rows. The learner here is the same (loss,
shrinkage, variance gain, split candidates between values, smallest leaf; a test compares
the two), with the loop over trees and levels inside a task. One Spark job fits all models:
rows go to the tasks as 4-byte floats, a task holds the months its models need once, and
work is dealt by training rows. Split candidates come from a model's own training rows,
all of them, so no later month enters one.

A model whose training rows exceed ``TASK_CELLS`` values is fitted by MLlib over the
cluster, as is an estimator with settings that are not known here.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import month_index
from panelkit.operators.months import calendar_broadcast

#: Training rows times features that one task takes: 400 MB as floats.
TASK_CELLS = 100_000_000
#: What the fixed cost of a tree weighs, in rows.
TREE_ROWS = 10_000
#: From so many rows on, two features share a histogram.
PAIRED_ROWS = 20_000
BLOCK = 8_192
BITS = 5
BINS = 1 << BITS


@dataclass(frozen=True)
class Setting:
    """What decides a fit: depth, number of trees, shrinkage, smallest leaf, loss."""

    depth: int
    rounds: int
    step: float
    leaf: int
    classify: bool


@dataclass
class Wanted:
    """A model to fit: rows up to month ``last`` that have the label."""

    make: Callable[[str], Estimator]
    label: str
    last: int = 0
    n: int | None = None


@dataclass
class Trees:
    """Full binary trees: (tree, inner node) split features and values, (tree, leaf) values
    already weighted. A node that was not split sends all rows to the left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees for rows of ``x`` (rows x features, 4-byte floats)."""
        n, width = x.shape
        flat, at, out = np.ascontiguousarray(x).ravel(), np.arange(n) * width, np.zeros(n)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(n, np.int64)
            for d in range(len(value).bit_length() - 1):
                k = node + ((1 << d) - 1)
                node = 2 * node + (flat.take(at + feature.take(k)) > threshold.take(k))
            out += value.take(node)
        return out


def setting(est: Estimator) -> Setting | None:
    """The settings of an MLlib estimator, or None if it has others than are known here."""
    if type(est) not in (GBTRegressor, GBTClassifier):
        return None
    classify = type(est) is GBTClassifier
    known = {"maxBins": BINS, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "lossType": "logistic" if classify else "squared"}
    plain = all(est.getOrDefault(p) == v for p, v in known.items()) and not any(est.isDefined(p) and est.getOrDefault(p) for p in ("weightCol", "validationIndicatorCol"))
    if not plain or est.getMaxDepth() > 8:
        return None
    return Setting(est.getMaxDepth(), est.getMaxIter(), est.getStepSize(), est.getMinInstancesPerNode(), classify)


def split_points(x: np.ndarray) -> np.ndarray:
    """At most BINS - 1 values between values of ``x``, at even counts as far as ties allow."""
    values, counts = np.unique(x, return_counts=True)
    middle = (values[:-1].astype(float) + values[1:].astype(float)) / 2
    if len(middle) < BINS:
        return middle
    stride, chosen, start = len(x) / BINS, [], 1
    until = np.cumsum(counts)
    target = stride
    while start < len(until):
        # the first value whose count would lead further from the target than the one before
        i = max(start, int(np.searchsorted(until, target, "right")) - 1)
        while i < len(until) and not abs(until[i - 1] - target) < abs(until[i] - target):
            i += 1
        if i >= len(until):
            break
        chosen.append(i - 1)
        target += stride
        start = i + 1
    return middle[chosen[: BINS - 1]]


def residuals(target: np.ndarray, margin: np.ndarray, classify: bool) -> np.ndarray:
    """Negative gradient of the squared error, or of 2 log(1 + exp(-2 target margin))."""
    return 4 * target / (1 + np.exp(2 * target * margin)) if classify else 2 * (target - margin)


def histograms(codes: np.ndarray, cells: int, width: int, r: np.ndarray, counts: bool = True, node: np.ndarray | None = None, local: np.ndarray | None = None, nodes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(sums of ``r``, counts) as (nodes, features, BINS), of all rows, or of those whose
    ``local[node]`` is not negative, by that number."""
    k = codes.shape[1]
    size, starts = nodes * k * cells, np.arange(k) * cells
    total = np.zeros((2, size))
    for a in range(0, len(codes), BLOCK):
        c, w = codes[a : a + BLOCK], r[a : a + BLOCK]
        if local is None:
            index = c + starts
        else:
            at = local.take(node[a : a + BLOCK])
            keep = np.flatnonzero(at >= 0)
            index, w = c.take(keep, 0) + starts, w.take(keep)
            index += (at.take(keep) * (k * cells))[:, None]
        index = index.ravel()
        total[0] += np.bincount(index, np.repeat(w, k), size)
        if counts:
            total[1] += np.bincount(index, minlength=size)
    if cells == BINS:
        return tuple(total.reshape(2, nodes, k, BINS))
    both = total.reshape(2, nodes, k, BINS, BINS)
    return tuple(np.stack([both.sum(4), both.sum(3)], 3).reshape(2, nodes, 2 * k, BINS)[:, :, :width])


def best_splits(sums: np.ndarray, counts: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(splits, feature, last bin on the left, rows on the left) for each node."""
    s, n = np.cumsum(sums, 2), np.cumsum(counts, 2)
    all_s, all_n = s[:, :1, -1:], n[:, :1, -1:]
    s, n = s[:, :, :-1], n[:, :, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((n >= leaf) & (all_n - n >= leaf), s * s / n + (all_s - s) ** 2 / (all_n - n), -np.inf).reshape(len(s), -1)
        plain = (all_s * all_s / all_n).ravel()
    best = score.argmax(1)
    top = score[np.arange(len(s)), best]
    return np.isfinite(top) & (top - plain > 1e-12 * top), best // (BINS - 1), best % (BINS - 1), n.reshape(len(s), -1)[np.arange(len(s)), best]


def grow(columns: Callable[[int], np.ndarray], width: int, y: np.ndarray, s: Setting) -> Trees:
    """Fits the trees on rows given by feature (``columns``) and outcomes ``y``."""
    if s.classify and not np.isin(y, (0.0, 1.0)).all():
        raise ValueError("labels of a classifier must be 0 or 1")
    n, pair = len(y), len(y) >= PAIRED_ROWS
    k, cells = ((width + 1) // 2, BINS * BINS) if pair else (width, BINS)
    codes, points = np.zeros((n, k), np.int16), []
    # where a feature's bin stands in the codes
    column, shift = (np.arange(width) // 2, np.where(np.arange(width) % 2 == 0, BITS, 0)) if pair else (np.arange(width), np.zeros(width, np.int64))
    for f in range(width):
        x = columns(f)
        points.append(split_points(x))
        codes[:, column[f]] += (np.searchsorted(points[f], x) << shift[f]).astype(np.int16)
    steps, target = np.arange(BLOCK) * k, (2.0 * y - 1 if s.classify else y.astype(float))
    inner, leaves = (1 << s.depth) - 1, 1 << s.depth
    out = Trees(np.zeros((s.rounds, inner), np.int16), np.full((s.rounds, inner), np.inf), np.zeros((s.rounds, leaves)))
    margin, root = np.zeros(n), histograms(codes, cells, width, target)[1]
    for t in range(s.rounds):
        r = residuals(target, margin, s.classify) if t else target
        node = np.zeros(n, np.uint8)
        sums, counts, alive = histograms(codes, cells, width, r, counts=False)[0], root, np.array([0])
        for d in range(s.depth):
            ok, feature, last, left = best_splits(sums, counts, s.leaf)
            if not ok.any():
                node <<= s.depth - d
                break
            first = (1 << d) - 1
            bound, where, by = np.full(1 << d, BINS, np.int16), np.zeros(1 << d, np.int64), np.zeros(1 << d, np.int16)
            for i in np.flatnonzero(ok):
                f, b = int(feature[i]), int(last[i])
                out.feature[t, first + alive[i]], out.threshold[t, first + alive[i]] = f, points[f][b]
                bound[alive[i]], where[alive[i]], by[alive[i]] = b, column[f], shift[f]
            for a in range(0, n, BLOCK):
                at = node[a : a + BLOCK]
                code = codes[a : a + BLOCK].ravel().take(steps[: len(at)] + where.take(at))
                node[a : a + BLOCK] = 2 * at + ((code >> by.take(at)) & (BINS - 1) > bound.take(at))
            if d + 1 == s.depth:
                break
            # the smaller child is counted, the other one is what remains
            parents, alive = np.flatnonzero(ok), alive[ok]
            all_n = counts[parents, 0].sum(1)
            light = np.where(2 * left[parents] <= all_n, 0, 1)
            local = np.full(2 << d, -1)
            local[2 * alive + light] = np.arange(len(alive))
            small_s, small_n = histograms(codes, cells, width, r, True, node, local, len(alive))
            rest_n = counts[parents] - small_n
            rest_s = np.where(rest_n > 0, sums[parents] - small_s, 0.0)
            right = (light == 1)[:, None, None]
            counts = np.stack([np.where(right, rest_n, small_n), np.where(right, small_n, rest_n)], 1).reshape(-1, width, BINS)
            sums = np.stack([np.where(right, rest_s, small_s), np.where(right, small_s, rest_s)], 1).reshape(-1, width, BINS)
            alive = np.stack([2 * alive, 2 * alive + 1], 1).ravel()
        held = np.bincount(node, minlength=leaves)
        out.value[t] = np.bincount(node, r, leaves) / np.maximum(held, 1) * (s.step if t else 1.0)
        margin += out.value[t].take(node)
    return out


class Boosted:
    """A fitted model with MLlib's output columns, for frames with a vector ``features``."""

    def __init__(self, trees: Trees, classify: bool):
        self.trees, self.classify = trees, classify

    def transform(self, df: DataFrame) -> DataFrame:
        trees = self.trees

        @F.arrow_udf("double")
        def margin(x: pa.Array) -> pa.Array:
            return pa.array(trees.margin(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) if len(x) else [], pa.float64())

        out = margin(vector_to_array("features", "float32"))
        if not self.classify:
            return df.withColumn("prediction", out)
        df = df.withColumn("_margin", out)
        p = 1 / (1 + F.exp(-2 * F.col("_margin")))
        return df.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_margin"), "_margin")), "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (F.col("_margin") > 0).cast("double"),
        }).drop("_margin")


def dealt(wanted: list[Wanted], parts: int) -> list[list[int]]:
    """The models of each task: in the order of their last month, cut at even work, so that
    tasks with early models read few months."""
    order = sorted(range(len(wanted)), key=lambda i: (wanted[i].last, wanted[i].label))
    cost = np.array([wanted[i].n + TREE_ROWS for i in order], float)
    place = ((np.cumsum(cost) - cost / 2) * parts / cost.sum()).astype(int)
    return [own for own in ([i for i, p in zip(order, place) if p == part] for part in range(parts)) if own]


def fit_in_tasks(df: DataFrame, month: Column, width: int, wanted: list[Wanted], settings: list[Setting]) -> list[Trees]:
    """The trees of each wanted model, from one job whose tasks fit several models each."""
    labels = sorted({w.label for w in wanted})
    tasks = dealt(wanted, min(len(wanted), max(df.sparkSession.sparkContext.defaultParallelism, 2)))
    plan = [[(i, wanted[i].label, wanted[i].last, settings[i]) for i in own] for own in tasks]
    until = [max(last for _, _, last, _ in own) for own in plan]
    known = F.lit(False)
    for label in labels:
        known = known | F.col(label).isNotNull()
    rows = df.filter(known).select(month.cast("int").alias("_month"), vector_to_array("features", "float32").alias("_x"), *[F.col(label).cast("double").alias(label) for label in labels])
    takers = F.array_compact(F.array(*[F.when(F.col("_month") <= last, F.lit(i)) for i, last in enumerate(until)]))
    sent = rows.withColumn("_task", F.explode(takers)).repartitionById(len(plan), F.col("_task"))
    # one order of rows, so that a retry adds up in the same order
    sent = sent.sortWithinPartitions("_month", F.xxhash64("_x", *labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, months, x, y = -1, [], [[] for _ in range(width)], {label: [] for label in labels}
        for b in batches:
            if b.num_rows:
                task = b.column("_task")[0].as_py()
                months.append(b.column("_month").to_numpy(zero_copy_only=False))
                values = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
                for f in range(width):
                    x[f].append(values[:, f].copy())
                for label in labels:
                    y[label].append(b.column(label).to_numpy(zero_copy_only=False))
        if task < 0:
            return
        at = np.concatenate(months)
        for f in range(width):
            x[f] = np.concatenate(x[f])
        for label in labels:
            y[label] = np.concatenate(y[label])
        for i, label, last, s in plan[task]:
            use = np.flatnonzero((at <= last) & ~np.isnan(y[label]))
            fit = grow(lambda f: x[f][use], width, y[label][use], s)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps(fit)], pa.binary())], names=["i", "fit"])

    done = {r["i"]: pickle.loads(r["fit"]) for r in sent.mapInArrow(run, "i int, fit binary").collect()}
    return [done[i] for i in range(len(wanted))]


def fit_each(df: DataFrame, width: int, wanted: list[Wanted], month: Column | None = None, until: Callable[[int], Column] | None = None, side_by_side: int = 4) -> list[Model | Boosted]:
    """A model for each of ``wanted``, in that order, from rows with a vector ``features`` of
    ``width`` values. ``month`` is the month index of a row; ``until(m)`` selects rows up to
    month m, for models that MLlib fits."""
    month = F.lit(0) if month is None else month
    mine = lambda w: (month <= w.last) & F.col(w.label).isNotNull()
    if unknown := [w for w in wanted if w.n is None]:
        sizes = df.select(*[F.count_if(mine(w)).alias(f"n{i}") for i, w in enumerate(unknown)]).first()
        for i, w in enumerate(unknown):
            w.n = sizes[i]
    learners = [w.make(w.label) for w in wanted]
    settings = [setting(e) for e in learners]
    within = [i for i, s in enumerate(settings) if s and 0 < wanted[i].n * width <= TASK_CELLS]
    models: dict[int, Model | Boosted] = {}
    if within:
        trees = fit_in_tasks(df, month, width, [wanted[i] for i in within], [settings[i] for i in within])
        models = {i: Boosted(t, settings[i].classify) for i, t in zip(within, trees)}

    def over_cluster(i: int) -> tuple[int, Model]:
        w = wanted[i]
        return i, learners[i].fit(df.filter((until(w.last) if until else mine(w)) & F.col(w.label).isNotNull()))

    with ThreadPool(side_by_side) as pool:
        models |= dict(pool.map(over_cluster, [i for i in range(len(wanted)) if i not in models], chunksize=1))
    return [models[i] for i in range(len(wanted))]


def fold_scores(df: DataFrame, trees: dict[tuple[int, int], Trees], carry: tuple[str, ...]) -> DataFrame:
    """(H, fold, ym, *carry, score, fwd): the rows of every fold month scored by the trees of
    its horizons; ``df`` has ym, *carry, a vector ``features`` and the labels fwd_H."""

    @F.arrow_udf("double")
    def score(h: pa.Array, fold: pa.Array, x: pa.Array) -> pa.Array:
        out, keys = np.zeros(len(x)), np.stack([h.to_numpy(zero_copy_only=False), fold.to_numpy(zero_copy_only=False)], 1)
        values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else None
        for key in np.unique(keys, axis=0):
            rows = np.flatnonzero((keys == key).all(1))
            out[rows] = trees[tuple(key.tolist())].margin(values[rows])
        return pa.array(out)

    listed = df.sparkSession.createDataFrame(sorted(trees), "H int, fold int")
    rows = df.withColumn("fold", month_index("ym").cast("int")).join(calendar_broadcast(listed), "fold")
    outcome = F.coalesce(*[F.when(F.col("H") == h, F.col(f"fwd_{h}")) for h in sorted({h for h, _ in trees})])
    return rows.select("H", "fold", "ym", *carry, score("H", "fold", vector_to_array("features", "float32")).alias("score"), outcome.alias("fwd"))
