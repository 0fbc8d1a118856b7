"""Statistics of trailing frames of few rows of a history, as array arithmetic.

A sliding frame is evaluated on every daily row; here only the rows that are asked for take
part. A window places and orders the rows by key, tasks read them in batches, and what a
task holds is a batch and the history of the key at its end, which the calendar bounds.
Nulls are left out of a frame, and sums run from the oldest row to the newest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statistic of a frame: (kind, column, rows, fewest known values).
Frame = tuple[str, str, int, int]


def frame_of(x: np.ndarray, known: np.ndarray, first: np.ndarray, at: np.ndarray, n: int, fill: float) -> np.ndarray:
    """(n, rows): the ``n`` values up to each row of ``at``, oldest first; ``fill`` stands
    for nulls and before the key's ``first`` row."""
    place = np.arange(1 - n, 1)[:, None] + at
    inside = place >= first[at]
    place = np.maximum(place, 0)
    return np.where(inside & known[place], x[place], fill)


def statistic(kind: str, x: np.ndarray, known: np.ndarray, first: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, number of known values) of each frame; a frame without values has any value.
    ``deviation`` is the sample deviation, exactly 0 of equal values."""
    upto = np.concatenate([[0], np.cumsum(known)])
    size = upto[at + 1] - upto[np.maximum(at + 1 - n, first[at])]
    frame = lambda fill, of=x: frame_of(of, known, first, at, n, fill)
    if kind == "top":
        return frame(-np.inf).max(0), size
    if kind == "low":
        return np.fmin.reduce(frame(np.inf), 0), size
    if kind == "median":
        s, columns = np.sort(frame(np.nan), 0), np.arange(len(at))
        return (s[np.maximum(size - 1, 0) >> 1, columns] + s[np.minimum(size >> 1, n - 1), columns]) / 2, size
    values = frame(0.0)
    mean = values.sum(0) / size
    if kind == "mean":
        return mean, size
    away = np.where(frame(0.0, known) > 0, values - mean, 0.0)
    level = frame(-np.inf).max(0) == np.fmin.reduce(frame(np.inf), 0)
    return np.where(level, 0.0, np.sqrt((away * away).sum(0) / (size - 1))), size


def month_ends(month: np.ndarray, day: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a row is on its key's last date of a month; ``last`` marks a key's last row."""
    end = last.copy()
    end[:-1] |= month[1:] != month[:-1]
    while True:  # rows that share a date with such a row
        more = end.copy()
        more[:-1] |= end[1:] & (day[1:] == day[:-1]) & ~last[:-1]
        if (more == end).all():
            return end
        end = more


def month_end_statistics(df: DataFrame, values: dict[str, Column], frames: dict[str, Frame], key: str = "symbol") -> DataFrame:
    """(key, _at, *frames): one row per key. ``_at`` has the row numbers (``pos``) of all rows
    on the last date of a month of the key, and each frame an array of its statistic there."""
    used = list(values)  # columns themselves can't be sent to a task

    def of_keys(t: pa.Table) -> pa.RecordBatch:
        last = t.column("_next").is_null().to_numpy()
        start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        first = start[np.concatenate([[0], np.cumsum(last)[:-1]])]
        day = t.column("date").cast(pa.int32()).fill_null(-719_162).to_numpy()
        at = np.flatnonzero(month_ends(day.astype("datetime64[D]").astype("datetime64[M]"), day, last))
        known = {c: t.column(c).is_valid().to_numpy() for c in used}
        x = {c: t.column(c).to_numpy() for c in used}
        lists = pa.array(np.append(np.searchsorted(at, start), len(at)), pa.int32())
        arrays = [pa.array(t.column("pos").to_numpy()[at], pa.int32())]
        with np.errstate(all="ignore"):
            for kind, c, n, least in frames.values():
                value, size = statistic(kind, x[c], known[c], first, at, n)
                arrays.append(pa.array(value, pa.float64(), mask=size < least))
        keys = t.column(key).take(pa.array(start)).combine_chunks()
        return pa.RecordBatch.from_arrays([keys, *[pa.ListArray.from_arrays(lists, a) for a in arrays]], names=[key, "_at", *frames])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            ended = np.flatnonzero(b.column(b.schema.get_field_index("_next")).is_null().to_numpy(zero_copy_only=False))
            if not len(ended):
                waiting.append(b)
                continue
            upto = int(ended[-1]) + 1
            yield of_keys(pa.Table.from_batches([*waiting, b.slice(0, upto)]))
            waiting = [b.slice(upto)] if upto < b.num_rows else []

    # the window brings a key's rows together in their order; its last row has no next one
    following = F.lead("pos").over(Window.partitionBy(key).orderBy("pos")).alias("_next")
    rows = df.select(key, "pos", "date", following, *[c.cast("double").alias(n) for n, c in values.items()])
    schema = ", ".join([f"{key} string", "_at array<int>", *[f"{n} array<double>" for n in frames]])
    return rows.mapInArrow(run, schema)


def at_rows(rows: DataFrame, statistics: DataFrame, key: str = "symbol") -> DataFrame:
    """``rows`` with the statistics of their row numbers. Rows stay placed by key; one row
    per key is sent to them."""
    names = [c for c in statistics.columns if c not in (key, "_at")]
    both = rows.join(statistics.hint("merge"), key)
    k = (F.array_position("_at", F.col("pos")) - 1).cast("int")
    return both.withColumn("_k", k).withColumns({n: F.get(n, F.col("_k")) for n in names}).drop("_at", "_k")
