"""Helpers of all operators: written tables, keys of rows, batches for Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.functions.written import scratch_path, written

__all__ = ["in_small_batches", "row_key", "scratch_path", "written"]


#: rows of long columns that travel to a Python worker at once
BATCH_ROWS = 512
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to send few rows at a time to Python; texts and pages can be very long."""
    conf = df.sparkSession.conf
    now = int(conf.get(_ROWS_CONF, "0"))
    if not 0 < now <= BATCH_ROWS:
        conf.set(_ROWS_CONF, str(BATCH_ROWS))
    return df


def row_key(*cols: str) -> Column:
    """64-bit key of a row for narrowing joins; equal rows share it, and rows that collide are only checked twice."""
    return F.xxhash64(*cols)
