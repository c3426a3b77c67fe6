"""Scalar results next to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Rows of ``df`` with the columns of a one-row aggregate.

    ``row`` is a grand aggregate, so what is broadcast is a single row.
    """
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one"))
