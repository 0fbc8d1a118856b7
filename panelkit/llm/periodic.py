"""Runs of periodically repeated words: recursive frequency splitting, then a lag scan.

A run is a stretch of words with smallest period q whose length is at least
``max(least, 2 q)`` and that no neighbouring word extends. Each of its words has an equal
word q places away inside the run, and q is at most half the run. So a word whose nearest
equal word lies further than half the current segment, or that occurs once in it, joins no
run of that segment: it splits the segment, pieces below ``least`` words go, and the rest
is looked at again until nothing splits. Prose falls apart in a few rounds; what survives
is scanned.

The lag scan reads the segment at multiples of each lag q. A run of period q has at least q
consecutive matches "word i equals word i + q", so one of them stands at a multiple of q;
from there the match is extended to both sides. Extension compares blocks of 2^k words by
exact ranks (equal blocks have equal ranks), so a segment of m words costs m log m places
and a logarithmic number of steps at each, also where one text is a single long run.

A batch of texts is one array of word numbers, split and scanned together. Nothing is
shuffled. Memory is bounded by ``CHUNK`` bytes of text, or by the largest text: about 300
bytes for each of its words.

Defined cases: null, empty and blank texts have no runs and an empty collapsed text;
repeated rows are handled row by row; other columns stay as they are, those called like an
output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import extended

#: Bytes of text that are split and scanned together; a longer text stands alone.
CHUNK = 2_000_000
#: Places of a segment that one step of the lag scan looks at.
PLACES = 1_000_000
#: Words of a run at least.
LEAST = 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and where each text's words begin in it."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    counts = np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    return words.filter(some), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def surviving(ids: np.ndarray, segment: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that frequency splitting leaves, in order, and the segment of each."""
    at = np.arange(len(ids))
    kinds = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])])
        number = np.cumsum(new) - 1
        size = np.bincount(number)[number]
        long = size >= least
        at, number, size = at[long], number[long], size[long]
        # the distance to the nearest equal word of the segment, by sorting equal words together
        key = number * kinds + ids[at]
        order = np.argsort(key, kind="stable")
        gap = np.diff(at[order]).astype(np.float64)
        gap[key[order[1:]] != key[order[:-1]]] = np.inf
        near = np.empty(len(at))
        near[order] = np.minimum(np.concatenate([[np.inf], gap]), np.concatenate([gap, [np.inf]])) if len(at) else 0
        joins = 2 * near <= size
        if joins.all():
            return at, number
        at, segment = at[joins], number[joins]
    return at, segment


def block_ranks(words: np.ndarray, end: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ... a number per place such that two places have the same one exactly
    if the 2^k words from there on are equal; defined where the block ends in its segment."""
    ranks, k = [words], 0
    while 2 << k <= longest:
        at = np.flatnonzero(np.arange(len(words)) + (2 << k) <= end)
        pair = ranks[k][at] * (int(ranks[k].max()) + 1) + ranks[k][at + (1 << k)]
        rank = np.zeros(len(words), np.int64)
        rank[at] = np.unique(pair, return_inverse=True)[1]
        ranks.append(rank)
        k += 1
    return ranks


def places(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, lag, segment) for every segment, lag up to half of it, and multiple of the lag."""
    lags = size // 2
    segment = np.repeat(np.arange(len(size)), lags)
    lag = np.arange(len(segment)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    count = (size[segment] - 1) // lag
    total = np.cumsum(count)
    bounds = np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, PLACES), side="right")
    bounds = np.unique(np.concatenate([bounds, [len(lag)]]))
    for a, b in zip(np.concatenate([[0], bounds[:-1]]), bounds):
        n = count[a:b]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q, s = np.repeat(lag[a:b], n), np.repeat(segment[a:b], n)
        yield begin[s] + step * q, q, s


def lag_scan(words: np.ndarray, segment: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) rows, places of ``words``, of all runs inside the segments."""
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(words) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(words)]]))
    end = np.repeat(begin + size, size)
    ranks = block_ranks(words, end, int(size.max()) if len(size) else 0)
    found = [np.zeros((0, 3), np.int64)]
    # where long runs found before reach to: their multiples as lags find the same stretch
    reach, known = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    for i, q, s in places(begin, size):
        same = (words[i] == words[i + q]) & ((i + q >= reach[i]) | (q % known[i] != 0))
        i, q, s = i[same], q[same], s[same]
        low, high = begin[s], begin[s] + size[s]
        ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            block, rank = 1 << k, ranks[k]
            x = i + ahead
            can = np.flatnonzero(x + q + block <= high)
            ahead[can[rank[x[can]] == rank[x[can] + q[can]]]] += block
            x = i - back - block
            can = np.flatnonzero(x >= low)
            back[can[rank[x[can]] == rank[x[can] + q[can]]]] += block
        a, b = i - back, i + q + ahead
        hit = b - a >= np.maximum(least, 2 * q)
        found.append(np.unique(np.stack([a[hit], b[hit], q[hit]], 1), axis=0))
        for x, y, p in found[-1][found[-1][:, 1] - found[-1][:, 0] >= 50 * found[-1][:, 2]].tolist():
            if reach[x] < y:
                reach[x:y], known[x:y] = y, p
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch is found with its period's multiples as well; the smallest comes first
    first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]) if len(rows) else np.zeros(0, bool)
    return rows[first]


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """All runs of texts whose word numbers stand one after another: (text, start, length,
    period) rows by text, start and period, and which words no run repeats."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at, segment = surviving(ids, text, least)
    rows = lag_scan(ids[at], segment, least)
    begin, length, period = at[rows[:, 0]], rows[:, 1] - rows[:, 0], rows[:, 2]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    of = text[begin]
    out = np.stack([of, begin - starts[of], length, period], 1)
    return out[np.lexsort((period, begin))], np.cumsum(change[:-1]) == 0


def chunked(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST) -> DataFrame:
    """The input with ``runs`` (start word, length and period of each run, by start and
    period) and ``collapsed``: the words that remain when of each run only its first
    period is kept, joined by one space. No shuffle: one pass over the rows."""
    keep = [c for c in df.columns if c not in (runs, collapsed)]
    schema = extended(df, keep, f"`{runs}` {RUNS}, `{collapsed}` string")
    of_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, text):
                words, starts = word_lists(part.column(part.schema.get_field_index(text)))
                ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                rows, kept = runs_of(ids, starts, least)
                offsets = np.searchsorted(rows[:, 0], np.arange(len(starts))).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], fields=list(of_run))
                left = np.concatenate([[0], np.cumsum(kept)])[starts].astype(np.int32)
                short = pc.binary_join(pa.ListArray.from_arrays(left, words.filter(pa.array(kept))), " ")
                columns = [part.column(part.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, spans), short.cast(pa.string())], names=[*keep, runs, collapsed])

    return df.mapInArrow(run, schema)


def with_planted_tails(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's probe: in about a tenth of the documents, chosen by crc32 of the id
    (null ids: none), the words from some place on repeat with some period. Other texts
    stay as they are."""
    keep = df.columns

    def tail(key: int, word: str | None) -> str | None:
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        w = word.encode().split() if word and h % 10 == 0 else []
        if not w:
            return word
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(w[:a] + [w[a + i % p] for i in range(n - a)]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t = batch.schema.get_field_index(doc_id), batch.schema.get_field_index(text)
            texts = [tail(k, w) for k, w in zip(batch.column(i).to_pylist(), batch.column(t).to_pylist())]
            yield batch.set_column(t, text, pa.array(texts, pa.string()))

    return df.select(*keep).mapInArrow(run, df.schema)


def digests(found: DataFrame, *keep: str, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Per row: the number of runs, the longest one, and digests of all runs and of the
    collapsed text."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("a"), (-r.period).alias("q"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select(*keep, F.size(runs).cast("long").alias("n_runs"), best.alias("_b"), sha(lines).alias("runs_sha256"), sha(F.col(collapsed)).alias("collapsed_sha256"))
    longest: dict[str, Column] = {"start": -F.col("_b.a"), "length": F.col("_b.length"), "period": -F.col("_b.q")}
    return rows.select(*keep, "n_runs", *[c.alias(n) for n, c in longest.items()], F.expr("1000 * _b.length div -_b.q").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
