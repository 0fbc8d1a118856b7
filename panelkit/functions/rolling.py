"""Trailing row frames with a minimum number of non-null observations.

Every helper takes the caller's window, so one plan uses one
``partitionBy/orderBy`` pair and Spark plans a single exchange and sort for all of
its features. A symbol has at most one row per trading day, so a partition is
bounded by the calendar however large the panel grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelkit.functions.scalar import col


def symbol_window(key: str = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def series_window(order: str = "date") -> WindowSpec:
    """Order of an already aggregated series (one row per date or month). It has no
    partition key: use it only where the calendar bounds the row count."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(fn: Callable[[Column], Column], c: Column | str, n: int, min_periods: int, w: WindowSpec) -> Column:
    frame = last_rows(w, n)
    x = col(c)
    return F.when(F.count(x).over(frame) >= min_periods, fn(x).over(frame))


def rolling_full(fn: Callable[[Column], Column], c: Column | str, n: int, w: WindowSpec) -> Column:
    """A window that must be full, the default where no minimum is stated."""
    return rolling(fn, c, n, n, w)


def median_of_sorted(values: str, min_periods: int) -> Column:
    """Median of a column that holds a sorted array, null below ``min_periods`` values."""
    s = F.col(values)
    n = F.size(s)
    middle = (F.get(s, F.shiftright(n - 1, 1)) + F.get(s, F.shiftright(n, 1))) / 2
    return F.when(n >= F.greatest(F.lit(1), F.lit(min_periods)), middle)


def add_medians(df: DataFrame, frames: dict[str, tuple[str, int]]) -> DataFrame:
    """Medians of array columns: {output: (array column, min periods)}; the arrays drop.
    Each array is sorted in a projection of its own, so that it is sorted once and not
    per use of the result."""
    arrays = [a for a, _ in frames.values()]
    df = df.withColumns({a: F.sort_array(a) for a in arrays})
    return df.withColumns({out: median_of_sorted(a, m) for out, (a, m) in frames.items()}).drop(*arrays)


def frame_values(c: Column | str, n: int, w: WindowSpec) -> Column:
    """The non-null values of the last ``n`` rows, for ``add_medians``. Sorting a collected
    frame measured faster than a sliding ``percentile``, which rebuilds a hash map per row."""
    return F.collect_list(col(c)).over(last_rows(w, n))


def histories(df: DataFrame, values: dict[str, Column], key: str = "symbol", order: str = "pos") -> DataFrame:
    """(key, *values): each value of a key's rows as one array in the order of its row
    numbers 1, 2, ..., for frames that few rows need. A sliding frame is evaluated on every
    daily row; a slice of the history only where it is asked for. ``<value>_gaps`` tells
    whether the array holds a null."""
    rows = F.sort_array(F.collect_list(F.struct(order, *[c.alias(n) for n, c in values.items()])))
    gaps = {f"{n}_gaps": F.count(c) < F.count(F.lit(1)) for n, c in values.items()}
    held = df.groupBy(key).agg(rows.alias("_h"), *[c.alias(n) for n, c in gaps.items()])
    return held.select(key, *[F.col("_h")[n].alias(n) for n in values], *gaps)


def known_of(history: str, first: Column, n: Column) -> Column:
    """The non-null ones of ``n`` values of a history from position ``first`` on. Most
    histories have no gaps, and theirs are not looked for."""
    part = F.slice(history, first, n)
    return F.when(F.col(f"{history}_gaps"), F.array_compact(part)).otherwise(part)


def last_of(history: str, n: int, order: str = "pos") -> Column:
    """The non-null values of the last ``n`` rows up to the row's own, from ``histories``."""
    p = F.col(order)
    return known_of(history, F.greatest(p - n + 1, F.lit(1)), F.least(p, F.lit(n)))


def filled_frame(fn: Callable[[Column], Column], frame: str, min_periods: int) -> Column:
    """``fn`` of an array of non-null values, null below ``min_periods`` of them."""
    return F.when(F.size(frame) >= min_periods, fn(F.col(frame)))


def array_mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def array_deviation(values: Column, mean: Column) -> Column:
    """Sample deviation about a mean that an earlier projection holds. Equal values deviate
    by exactly 0, however their mean is rounded."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.array_min(values) == F.array_max(values), 0.0).otherwise(F.sqrt(squares / (F.size(values) - 1)))


def running_sum(c: Column | str, w: WindowSpec) -> Column:
    return F.sum(col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_max(c: Column | str, w: WindowSpec) -> Column:
    return F.max(col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_forward(c: Column | str, w: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(c: Column | str, newest_first: WindowSpec) -> Column:
    """Next non-null value, over a window in descending order: frames that reach forward
    to the end would be re-read for every row."""
    return fill_forward(c, newest_first)


def trailing_return(cumlog: Column | str, k: int, w: WindowSpec) -> Column:
    """Simple return over the last ``k`` rows of a cumulative log-return column."""
    return F.expm1(col(cumlog) - F.lag(col(cumlog), k).over(w))


def forward_return(cumlog: Column | str, k: int, w: WindowSpec) -> Column:
    return F.expm1(F.lead(col(cumlog), k).over(w) - col(cumlog))


def distance_from_max(cumlog: Column | str, n: int, min_periods: int, w: WindowSpec) -> Column:
    return F.expm1(col(cumlog) - rolling(F.max, cumlog, n, min_periods, w))


def distance_from_min(cumlog: Column | str, n: int, min_periods: int, w: WindowSpec) -> Column:
    return F.expm1(col(cumlog) - rolling(F.min, cumlog, n, min_periods, w))


def change(c: Column | str, k: int, w: WindowSpec) -> Column:
    return col(c) - F.lag(col(c), k).over(w)


def padded(c: Column | str, w: WindowSpec) -> Column:
    """Gaps filled forward, as a percentage change does before it divides."""
    return fill_forward(c, w)


def pct_change(padded_col: Column | str, k: int, w: WindowSpec) -> Column:
    """Relative change over ``k`` rows of a column already passed through ``padded``."""
    p = col(padded_col)
    return p / F.lag(p, k).over(w) - 1


def trailing_pct_rank(c: Column | str, n: int, min_periods: int, w: WindowSpec) -> Column:
    """Share (0-100) of the window's rows that the current value reaches or exceeds.

    Missing values stay in the denominator, and a missing current value scores 0. Round
    the column in an earlier projection, so that equal levels stay equal whatever the
    summation order. For aggregated series only: each row holds its frame.
    """
    frame = last_rows(w, n)
    x = col(c)
    values = F.collect_list(x).over(frame)
    reached = F.coalesce(F.size(F.filter(values, lambda v: v <= x)), F.lit(0))
    rows = F.count(F.lit(1)).over(frame)
    share = F.when(x.isNull(), 0.0).otherwise(reached / rows * 100)
    return F.when(F.size(values) >= min_periods, share)


def ma_flag(level: Column | str, n: int, w: WindowSpec) -> Column:
    """1.0 when the level is above its ``n``-row mean; 0.0 also before n rows exist."""
    above = col(level) > rolling_full(F.avg, level, n, w)
    return F.when(above, 1.0).otherwise(0.0)


def momentum_flag(ret: Column | str, n: int, w: WindowSpec) -> Column:
    """1.0 when the sum of the last ``n`` returns is positive, else 0.0."""
    return F.when(rolling_full(F.sum, ret, n, w) > 0, 1.0).otherwise(0.0)


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-null columns of a row."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, n)


def is_last_of(group: str, w: WindowSpec) -> Column:
    """True on the last row before ``group`` changes, within a window already
    ordered by date; it needs no further sort."""
    nxt = F.lead(group).over(w)
    return nxt.isNull() | (nxt != F.col(group))
