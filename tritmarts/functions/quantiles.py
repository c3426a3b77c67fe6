"""Exact quantiles of groups of any size, by rank selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.functions.ordering import running_totals


def grouped_quantiles(df: DataFrame, key: Sequence[str], value: Column, named: Mapping[str, float]) -> DataFrame:
    """(key..., one double per name): quantiles of the non-null values of each group, interpolated between ranks.

    Rows are folded to counts of distinct values, placed by running totals, and the two ranks around
    each quantile are picked, so no task holds a group, or all rows where ``key`` is empty.  Null keys
    are a group; a group without values gives no row; the results are those of ``percentile``.
    """
    group = F.struct(*map(F.col, key)) if key else F.struct(F.lit(0).alias("all"))
    folded = (df.select(group.alias("_key"), value.cast("double").alias("_value")).filter("_value IS NOT NULL")
              .groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n")))
    placed = running_totals(folded, [F.col("_value")], ["_n"], key=["_key"])
    sizes = placed.groupBy("_key").agg(F.max("_n_cum").alias("_size"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_n_cum") > rank) & (F.col("_n_cum") - F.col("_n") <= rank), F.col("_value")))

    place = {name: (F.col("_size") - 1) * F.lit(float(p)) for name, p in named.items()}
    picked = placed.join(sizes, "_key").groupBy("_key", "_size").agg(
        *[at(F.floor(x)).alias(f"_low_{n}") for n, x in place.items()], *[at(F.ceil(x)).alias(f"_high_{n}") for n, x in place.items()])

    def between(name: str, x: Column) -> Column:
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name)

    return picked.select(*[F.col("_key")[k].alias(k) for k in key], *[between(n, x) for n, x in place.items()])
