"""Rolling up only the years that an import touches.

Marts of days depend on their own year of the journal, except where an operator looks at the
row before: the last rows of every channel and year are kept as edges, so the first row of a
year finds its predecessor without the years before being read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators import intrusion, pumps

_ROW = ["event_id", "channel_id", "d", "t_sec", "raw_value"]


def touched_years(imported: Iterable[int], known: Iterable[int]) -> list[int]:
    """The imported years and, after each, the next known one, whose first rows have a new predecessor."""
    imported, known = set(imported), set(known)
    after = {min((y for y in known if y > i), default=None) for i in imported}
    return sorted(imported | (after - {None}))


def _last_rows(rows: DataFrame) -> DataFrame:
    packed = F.struct("d", "t_sec", "event_id", "channel_id", "raw_value")
    return (rows.groupBy("channel_id", F.year("d").alias("year")).agg(F.max(packed).alias("r"))
            .select(*[F.col(f"r.{c}").alias(c) for c in _ROW], "year"))


def edge_rows(journal: DataFrame, dim: DataFrame) -> DataFrame:
    """Last row of each pump, and last switch of each guard channel, in every year of ``journal``."""
    kinds = dim.select("channel_id", "sensor_type").filter(F.col("sensor_type").isin(fv.PUMP, fv.GUARD))
    rows = journal.select(*_ROW).join(kinds, "channel_id")
    counts = (F.col("sensor_type") == fv.PUMP) | F.col("raw_value").isin(fv.ARMED, fv.DISARMED)
    return _last_rows(rows.filter(counts))


def _with_edges(rows: DataFrame, edges: DataFrame, years: list[int]) -> DataFrame:
    return rows.select(*_ROW).unionByName(edges.filter(~F.col("year").isin(years)).select(*_ROW))


def pump_days(rows: DataFrame, edges: DataFrame, dim: DataFrame, years: list[int]) -> DataFrame:
    """``pumps.pump_day`` of the days of ``years``; ``rows`` is their journal, ``edges`` the last rows of all years."""
    return pumps.pump_day(_with_edges(rows, edges, years), dim).filter(F.year("d").isin(years))


def armed_intervals(rows: DataFrame, edges: DataFrame, dim: DataFrame, years: list[int]) -> DataFrame:
    """``intrusion.armed_intervals`` that end in ``years``, with the ``year`` they end in.

    An interval is kept under the year of its end, so what a new year closes is new and what
    earlier years hold stays as it is.
    """
    ended = F.year(F.timestamp_seconds("t_to"))
    return (intrusion.armed_intervals(_with_edges(rows, edges, years), dim).withColumn("year", ended)
            .filter(F.col("year").isin(years)))
