"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of three hashed embeddings: two of the word, so that words are
mixed up only where both hashes meet, and one of its first letters, so that rare forms of
a stem share what was learned. Filters of several widths slide over the word vectors; the largest answer
of each filter feeds a logistic unit. Embeddings start from the smoothed log-odds of their
bucket, then all weights are trained by gradient steps. The decision threshold on the
logit is calibrated for each language, which is guessed from the text's own function words
(never from a column), and the score is shifted so that 0.7 stands at that threshold.

Only a bounded sample of labelled rows is fitted; every text is scored whole.

Defined cases: a null or empty text has no words and gets the score of pure padding; labels
that are null or contradict each other take no part; without labels of both classes every
score is the share of label 1 (one half if none was seen).
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import balanced_sample, extended, fitting_rows

BITS, DIM, FILTERS, WIDTHS = 17, 8, 4, (1, 2, 3)
BUCKETS = 1 << BITS
#: Tables: two hashes of the word, and one of its first STEM characters.
TABLES, STEM = 3, 5
_SHIFT = TABLES * BITS
#: Words a worker remembers at most.
REMEMBERED = 400_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|_-"
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with on are this from by an it".split(),
    "de": "der die das und ist nicht ein eine mit von zu den dem auf für im".split(),
    "fr": "le les et des du une dans est que pour qui sur au avec pas aux".split(),
    "es": "el los las y del una por con no su para es lo como más se".split(),
}
LANGUAGES = ("", *FUNCTION_WORDS)
_LANG = {w: i + 1 for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}


class Words(dict):
    """word -> three bucket numbers, with the language of function words above them."""

    def __missing__(self, word: str) -> int:
        w = word.strip(_EDGE)
        if len(self) >= REMEMBERED:
            self.clear()
        stem = xxhash.xxh64_intdigest(b"<" + w[:STEM].encode()) >> (64 - BITS)
        self[word] = v = xxhash.xxh64_intdigest(w.encode()) >> (64 - 2 * BITS) | stem << 2 * BITS | _LANG.get(w, 0) << _SHIFT
        return v


_WORDS = Words()


def word_ids(text: str | None) -> np.ndarray:
    """One int64 per word of the whole text."""
    words = (text or "").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))


def language(ids: np.ndarray) -> int:
    """Index into LANGUAGES of the text's most frequent function words, 0 if none."""
    seen = np.bincount(ids >> _SHIFT, minlength=len(LANGUAGES))[1:]
    return int(seen.argmax()) + 1 if seen.any() else 0


class TextCnn:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (TABLES, BUCKETS + 1, DIM)).astype(np.float32)
        self.w = {k: rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            self.w[k][:, 0, : FILTERS // 2] = 0.7  # half of the filters begin on the log-odds
        self.b = {k: np.full(FILTERS, -0.1, np.float32) for k in WIDTHS}
        self.v = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.c = np.float32(-1.0)
        self.limits = np.zeros(len(LANGUAGES))
        self.slope, self.constant = 1.0, None
        self.tables = None

    # ---- fitting
    @staticmethod
    def hashed(ids: np.ndarray) -> np.ndarray:
        """(tables, n + padding) bucket numbers; the last bucket is padding and stays zero."""
        h = np.full((TABLES, len(ids) + WIDTHS[-1] - 1 + (not len(ids))), BUCKETS, np.int32)
        for t in range(TABLES):
            h[t, : len(ids)] = (ids >> t * BITS) & (BUCKETS - 1)
        return h

    def start(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        for k in range(TABLES):
            seen = np.zeros((2, BUCKETS + 1))
            for d, t in zip(docs, y):
                seen[int(t), np.unique(d[k])] += 1
            n = np.bincount(y.astype(int), minlength=2)
            odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
            firm = seen.sum(0) / (seen.sum(0) + 3)
            self.e[k, :, 0] = np.clip(odds * firm, -3, 3) / 2
            self.e[k, BUCKETS] = 0

    def forward(self, h: np.ndarray):
        x = sum(e[i] for e, i in zip(self.e, h))
        tops, at = [], []
        n = len(x) - WIDTHS[-1] + 1
        for k in WIDTHS:
            c = sum(x[j : j + n] @ self.w[k][j] for j in range(k)) + self.b[k]
            i = c.argmax(0)
            at.append(i)
            tops.append(np.maximum(c[i, np.arange(FILTERS)], 0))
        return x, np.concatenate(tops), at

    def learn(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        sums: dict = {}

        def step(name, param, grad):
            s = sums.setdefault(name, np.full(param.shape, 1e-3, np.float32))
            s += grad * grad
            param -= rate * grad / np.sqrt(s)

        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), 32):
                batch = order[a : a + 32]
                gw, gb = {k: np.zeros_like(self.w[k]) for k in WIDTHS}, {k: np.zeros_like(self.b[k]) for k in WIDTHS}
                gv, gc, rows, slots, grads = np.zeros_like(self.v), np.float32(0), [], [], []
                for d in batch:
                    h = docs[d]
                    x, m, at = self.forward(h)
                    z = float(m @ self.v + self.c)
                    dz = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) / len(batch))
                    gv += dz * m
                    gc += dz
                    dm = dz * self.v * (m > 0)
                    for q, k in enumerate(WIDTHS):
                        part = dm[q * FILTERS : (q + 1) * FILTERS]
                        gb[k] += part
                        for j in range(k):
                            pos = at[q] + j
                            gw[k][j] += x[pos].T * part
                            g = self.w[k][j].T * part[:, None]
                            for s in range(TABLES):
                                rows.append(h[s][pos])
                                slots.append(np.full(FILTERS, s))
                                grads.append(g)
                for k in WIDTHS:
                    step(("w", k), self.w[k], gw[k])
                    step(("b", k), self.b[k], gb[k])
                step("v", self.v, gv)
                self.c -= np.float32(rate * 0.1) * gc
                flat = np.concatenate(slots) * (BUCKETS + 1) + np.concatenate(rows)
                keys, inverse = np.unique(flat, return_inverse=True)
                g = np.zeros((len(keys), DIM), np.float32)
                np.add.at(g, inverse, np.concatenate(grads))
                e, s = self.e.reshape(-1, DIM), sums.setdefault("e", np.full((TABLES * (BUCKETS + 1), DIM), 1e-3, np.float32))
                s[keys] += g * g
                e[keys] -= rate * 0.3 * g / np.sqrt(s[keys])
                self.e[:, BUCKETS] = 0

    def fit(self, ids: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.05) -> "TextCnn":
        """Four of five rows train the weights, and the fifth, which they have not seen, the
        thresholds. Of copies and
        near copies (their three smallest word hashes agree) one is fitted: a group of
        copies would make its rare words look like a cause."""
        seen: dict = {}
        for i, (d, t) in enumerate(zip(ids, y, strict=True)):
            seen.setdefault((int(t), *np.unique(d)[:3].tolist()), i)
        ids, y = [ids[i] for i in seen.values()], np.asarray([y[i] for i in seen.values()], float)
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        fit, held = np.arange(len(y)) % 5 != 4, np.arange(len(y)) % 5 == 4
        if len(np.unique(y[fit])) < 2 or len(np.unique(y[held])) < 2:
            fit = held = np.ones(len(y), bool)
        docs = [self.hashed(d) for d, f in zip(ids, fit) if f]
        self.start(docs, y[fit])
        self.learn(docs, y[fit], epochs, rate)
        self.prepare()
        z, langs = np.array([self.logit(d) for d, f in zip(ids, held) if f]), np.array([language(d) for d, f in zip(ids, held) if f])
        self.calibrate(z, y[held], langs)
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, langs: np.ndarray, least: int = 20) -> None:
        """A threshold for every language with ``least`` rows of either class, one for
        the others: the middle of the gap with the fewest errors."""

        def limit(rows):
            v, t = z[rows], y[rows]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            wrong = np.concatenate([[0], np.cumsum(t)]) + (len(t) - t.sum()) - np.concatenate([[0], np.cumsum(1 - t)])
            ends = np.concatenate([[v[0] - 2], v, [v[-1] + 2]])
            best = np.flatnonzero(wrong == wrong.min())
            best = best[np.argmax(ends[best + 1] - ends[best])]  # the widest gap among the best
            return (ends[best] + ends[best + 1]) / 2

        every = np.ones(len(z), bool)
        self.limits[:] = limit(every)
        for k in range(1, len(LANGUAGES)):
            rows = langs == k
            if min(y[rows].sum(), (1 - y[rows]).sum()) >= least:
                self.limits[k] = limit(rows)
        self.slope = float(np.clip(4 / max(1e-6, abs(np.median(z[y == 1]) - self.limits[0])), 0.2, 8))

    # ---- scoring
    def prepare(self) -> "TextCnn":
        """Embedding times filter for every bucket: a word then costs a look-up in each."""
        if self.tables is None and self.constant is None:
            cols = np.concatenate([self.w[k][j] for k in WIDTHS for j in range(k)], axis=1)
            self.tables = [e.astype(np.float32) @ cols for e in self.e]
        return self

    def light(self) -> "TextCnn":
        """A copy to send to the workers: half-precision embeddings, no tables."""
        other = copy.copy(self)
        other.e, other.tables = (None if self.constant is not None else self.e.astype(np.float16)), None
        return other

    def logit(self, ids: np.ndarray) -> float:
        h = self.hashed(ids)
        tops = np.full(len(self.v), -np.inf, np.float32)
        n = h.shape[1] - WIDTHS[-1] + 1
        for a in range(0, n, 20_000):  # long texts in overlapping windows, all of them
            part = h[:, a : a + 20_000 + WIDTHS[-1] - 1]
            x = sum(t[i] for t, i in zip(self.tables, part))
            m, at, best = len(x) - WIDTHS[-1] + 1, 0, []
            for k in WIDTHS:
                c = sum(x[j : j + m, at + j * FILTERS : at + (j + 1) * FILTERS] for j in range(k))
                at += k * FILTERS
                best.append(c.max(0) + self.b[k])
            tops = np.maximum(tops, np.concatenate(best))
        return float(np.maximum(tops, 0) @ self.v + self.c)

    def score(self, ids: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * (self.logit(ids) - self.limits[language(ids)]) + np.log(0.7 / 0.3)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(documents: DataFrame, labels: DataFrame, bound: int = 6000, divisor: int = 3, left_out: int = 1, bytes_bound: int = 64_000_000) -> TextCnn:
    """Fits on at most ``bound`` labelled documents outside the held-out split, half of
    them toxic where there are enough, one row per id and ``bytes_bound`` bytes of text.
    Their word hashes reach the driver: four bytes a byte of text at most."""
    sample = balanced_sample(labels, "toxic", divisor, left_out, bound)
    docs = fitting_rows(documents, sample, bytes_bound, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [word_ids(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(ids, pa.binary())], names=["doc_id", "y", "ids"])

    rows = docs.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, ids binary").collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["ids"]))
    return TextCnn().fit([np.frombuffer(r["ids"], np.int64) for r in rows], np.array([r["y"] for r in rows]))


def score(documents: DataFrame, model: TextCnn, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The input with ``score`` and ``predicted``; input columns of these names are
    replaced. One pass, no shuffle."""
    keep = [c for c in documents.columns if c not in ("score", "predicted")]
    schema = extended(documents, keep, "score double, predicted int")
    sent = model.light()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = sent.prepare()
        for b in batches:
            s = np.array([ready.score(word_ids(t)) for t in b.column(b.schema.get_field_index(text)).to_pylist()])
            cols = [*[b.column(b.schema.get_field_index(k)) for k in keep], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "predicted"])

    return documents.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
