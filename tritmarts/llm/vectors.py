"""What the two vector operators share: which vectors take part, and small matrix helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str = "embedding") -> Column:
    """True for a vector that is not null, not zero and holds only finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def by_id(rows: DataFrame, *fields: str) -> DataFrame:
    """One row for each non-null vec_id; of rows that repeat an id the least (by ``fields``) counts."""
    one = rows.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(F.struct(*fields)).alias("row"))
    return one.select("vec_id", *[F.col(f"row.{f}").alias(f) for f in fields])


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """The n equally long lists of an Arrow column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def exact_products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products added up dimension by dimension, so that equal rows get equal sums wherever they stand."""
    total = np.zeros(len(rows))
    for d in range(len(vector)):
        total += rows[:, d] * vector[d]
    return total
