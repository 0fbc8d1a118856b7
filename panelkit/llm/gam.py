"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a short row of text statistics. Cyclic boosting visits one feature
after the other and adds a shallow tree's steps to that feature's lookup table; then the
strongest pairs get tables over two binned features in the same way. A score is the sum of
one bin per table, looked up for whole batches at once.

Only a bounded sample of labelled rows is fitted (``bound``); every text is scored whole.

Defined cases: a null or empty text has all-zero statistics and is scored like any other
row; labels that are null or contradict each other take no part; without labels of both
classes the score is the share of label 1 seen (one half if none was seen).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import extended, fitting_rows, labelled_sample

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "space", "comma_stop", "exclaim", "symbol", "high", "lines",
    "distinct", "adjacent_same", "top_word", "symbol_end", "no_letter", "same_lines",
)
#: Byte classes behind the shares, in the order of the features from "lower" to "lines".
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b",.;:", b"!?", b"#$%&*+/<=>@\\^_`{|}~()[]\"'-", bytes(range(128, 256)), b"\n"]
_MASK = np.array([[b in c for c in CLASSES] for b in range(256)], float)
_SYMBOLS = "#$%&*+/<=>@\\^_`{|}~!"


def statistics(text: str | None) -> list[float]:
    """The features of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MASK / len(raw)
    words = text.split()
    n = len(words)
    if not n:
        return [np.log1p(len(raw)), 0.0, 0.0, *shares.tolist(), *[0.0] * 6]
    counts = Counter(words)
    marked = bare = 0
    for w, c in counts.items():
        if w[-1] in _SYMBOLS:
            marked += c
        if not w[0].isalpha() and not any(map(str.isalpha, w)):
            bare += c
    lines = text.split("\n")
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), len(raw) / n, *shares.tolist(), len(counts) / n ** 0.8, sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n, marked / n, bare / n, 1 - len(set(lines)) / len(lines),
    ]


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, x array<double>) of every whole text."""
    schema = extended(df, keep, "x array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column(b.schema.get_field_index("_text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keep], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


class Additive:
    """Lookup tables of single features and of pairs."""

    def __init__(self, edges, base, tables, coarse, pairs):
        self.edges, self.base, self.tables, self.coarse, self.pairs = edges, base, tables, coarse, pairs

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x) and self.tables:
            fine, wide = self.bins(x, self.edges), self.bins(x, self.coarse)
            for j, t in enumerate(self.tables):
                out += t[fine[:, j]]
            for (a, b), t in self.pairs.items():
                out += t[wide[:, a], wide[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _steps(g: np.ndarray, h: np.ndarray, cuts: int, leaf: float, ridge: float) -> np.ndarray:
    """Values per bin of a tree with at most ``cuts`` cuts along one feature."""
    bounds = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(sg, sh):
        return sg * sg / (sh + ridge)

    for _ in range(cuts):
        best, at = 1e-9, 0
        for a, b in zip(bounds, bounds[1:]):
            k = np.arange(a + 1, b)
            lg, lh = cg[k] - cg[a], ch[k] - ch[a]
            rg, rh = cg[b] - cg[k], ch[b] - ch[k]
            gain = np.where((lh >= leaf) & (rh >= leaf), worth(lg, lh) + worth(rg, rh) - worth(cg[b] - cg[a], ch[b] - ch[a]), 0)
            if len(k) and gain.max() > best:
                best, at = gain.max(), int(k[gain.argmax()])
        if not at:
            break
        bounds = sorted([*bounds, at])
    out = np.zeros(len(g))
    if len(bounds) > 2:
        for a, b in zip(bounds, bounds[1:]):
            out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, leaf: float, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts, one along each axis."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]

    def parts(c):
        a = c[i, j]
        b, d = c[i, -1] - a, c[-1, j] - a
        return np.stack([a, b, d, c[-1, -1] - a - b - d])

    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)
    pg, ph = parts(cg), parts(ch)
    gain = np.where((ph >= leaf).all(0), (pg**2 / (ph + ridge)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge), 0)
    k = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    if gain[k] > 0:
        v = -pg[(slice(None), *k)] / (ph[(slice(None), *k)] + ridge)
        a, b = k[0] + 1, k[1] + 1
        out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v[0], v[1], v[2], v[3]
    return float(gain[k]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, n_pairs: int = 8, leaf: float = 2.0, ridge: float = 1.0) -> Additive:
    """Cyclic boosting on rows x (features) and labels y (0 or 1)."""
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, float)
    share = y.mean() if len(y) else 0.5
    base = float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))) if len(y) else 0.0
    if len(np.unique(y)) < 2:
        return Additive([], base, [], [], {})

    def edges(n):
        return [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]

    model = Additive(edges(bins), base, [], edges(8), {})
    fine, wide = model.bins(x, model.edges), model.bins(x, model.coarse)
    tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(tables):
            g, h = slopes()
            step = rate * _steps(np.bincount(fine[:, j], g, len(t)), np.bincount(fine[:, j], h, len(t)), 2, leaf, ridge)
            t += step
            z += step[fine[:, j]]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(a, b, v):
        return np.bincount(wide[:, a] * sizes[b] + wide[:, b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = {(a, b): _quadrants(grid(a, b, g), grid(a, b, h), leaf, ridge)[0] for a, b in combinations(range(len(sizes)), 2)}
    chosen = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in sorted(gains, key=gains.get, reverse=True)[:n_pairs]}
    for _ in range(rounds // 4):
        for (a, b), t in chosen.items():
            g, h = slopes()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h), leaf, ridge)[1]
            t += step
            z += step[wide[:, a], wide[:, b]]
    model.tables, model.pairs = tables, chosen
    return model


def train(documents: DataFrame, labels: DataFrame, bound: int = 8000, divisor: int = 4, left_out: int = 2, bytes_bound: int = 256_000_000) -> Additive:
    """Fits on at most ``bound`` labelled documents outside the held-out split, one row per
    id and ``bytes_bound`` bytes of text. Only their statistics (``bound`` short rows)
    reach the driver."""
    sample = labelled_sample(labels, "quality", divisor, left_out, bound)
    docs = fitting_rows(documents, sample, bytes_bound, "quality")
    rows = features(docs, keep=("doc_id", "y")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))


def score(documents: DataFrame, model: Additive, threshold: float = 0.7, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The input with a score and a prediction; input columns of these names are replaced.
    One pass, no shuffle."""
    keep = [c for c in documents.columns if c not in (score, predicted)]
    schema = extended(documents, keep, f"`{score}` double, `{predicted}` int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]).reshape(-1, len(FEATURES))
            s = model.score(x)
            cols = [*[b.column(b.schema.get_field_index(k)) for k in keep], pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, score, predicted])

    return documents.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
