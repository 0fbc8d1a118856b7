"""What the two vector operators share: which vectors count, packed rows, fixed seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: str | Column) -> Column:
    """Not null, not zero, every component present and finite."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def one_per_id(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) with one row per id: of repeated ids the smallest usable vector,
    else the smallest array."""
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    return rows.filter("vec_id is not null").groupBy("vec_id").agg(F.coalesce(F.min(F.when(usable("embedding"), F.col("embedding"))), F.min("embedding")).alias("embedding"))


def common_size(vectors: DataFrame) -> int:
    """The number of components most vectors have; 0 without vectors."""
    row = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return row["d"] if row else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
