"""Writers: the sorted panel, CSV, JSON, and bundles of named tables."""

from __future__ import annotations

import os
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_panel(panel: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "date")) -> None:
    """Parquet sorted by symbol and date: ranges make symbol filters skip files, and a
    symbol with many rows may span several files."""
    panel.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_counted(df: DataFrame, path: str, fmt: str = "parquet", order: str | None = None) -> dict:
    """Writes a frame and returns what the writing tasks counted on the way: ``rows``, the
    non-null count of every column, and the least and greatest ``order``. Nothing is read
    again."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"filled_{i}") for i, c in enumerate(df.columns)]]
    ends = [F.min(order).alias("first"), F.max(order).alias("last")] if order else []
    df.observe(seen, *counts, *ends).write.mode("overwrite").format(fmt).save(path)
    got = seen.get
    return {"rows": got["rows"], "filled": {c: got[f"filled_{i}"] for i, c in enumerate(df.columns)}, "first": got.get("first"), "last": got.get("last")}


def write_with_provenance(df: DataFrame, path: str, order: str, sources: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Writes a frame under ``path/data`` and beside it, under ``path/provenance``, one
    JSON row per column: (column, source, rows, filled, first, last). ``sources`` names
    where columns come from. Returns the sidecar as read back."""
    seen = write_counted(df, os.path.join(path, "data"), fmt, order)
    rows = [(c, sources.get(c), seen["rows"], n, seen["first"], seen["last"]) for c, n in seen["filled"].items()]
    kind = dict(df.dtypes)[order]
    schema = f"column string, source string, rows bigint, filled bigint, first {kind}, last {kind}"
    side = os.path.join(path, "provenance")
    write_json(df.sparkSession.createDataFrame(rows, schema).coalesce(1), side)
    return df.sparkSession.read.schema(schema).json(side)


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", side_by_side: int = 4) -> dict[str, dict]:
    """One folder per named section; only this starts jobs. Returns the counts of each
    section, taken while it was written. Sections do not depend on each other and most are
    small, so a few are submitted at a time."""
    with ThreadPool(side_by_side) as pool:
        counts = pool.starmap(lambda name, df: write_counted(df, os.path.join(path, name), fmt), tables.items(), chunksize=1)
    return dict(zip(tables, counts))
