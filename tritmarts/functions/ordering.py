"""Ordered computations that stay distributed when one key is hot.

A plain window over a hot key (or over no key at all) puts all of its rows in
one task.  Both helpers here cut the order into segments, work inside a segment,
and carry a small per-segment summary across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts.functions.written import written


def with_neighbour(df: DataFrame, key: Sequence[str], segment: str, order: Sequence[str],
                   value: Sequence[str], name: str = "prev", forward: bool = False) -> DataFrame:
    """Add a struct ``name`` with ``value`` of the previous (or next) row of the key.

    Rows of a key are windowed per (key, segment), so a hot key spreads over
    its segments; only one edge row per segment is windowed over the key.
    ``segment`` must not decrease with ``order`` inside a key.
    """
    packed = F.struct(*value)
    place = F.struct(*order)
    inside = Window.partitionBy(*key, segment).orderBy(*order)
    edge = (F.min_by if forward else F.max_by)(packed, place)
    across = Window.partitionBy(*key).orderBy(segment)
    step = F.lead if forward else F.lag
    carried = (df.groupBy(*key, segment).agg(edge.alias("_edge"))
               .select(*key, segment, step("_edge").over(across).alias("_carried")))
    return (df.withColumn("_near", step(packed).over(inside))
            .join(carried, [*key, segment])
            .withColumn(name, F.coalesce("_near", "_carried"))
            .drop("_near", "_carried"))


def with_nearest(asked: DataFrame, marks: DataFrame, key: Sequence[str], at: str, value: Sequence[str], reach: int,
                 name: str = "nearest") -> DataFrame:
    """``asked`` (key..., at) with a struct ``name`` of the nearest mark of its key: dist, at and ``value``.

    Both stand in one order per key; the last mark is carried from either side and the nearer one kept, of
    equals the smaller.  Beyond ``reach`` there is none.  Every asked row is one row, however far it sees;
    ``asked`` is distinct, ``marks`` has one row per key and place.
    """
    mark = F.struct(F.col(at).alias("at"), *value)
    both = asked.select(*key, at, F.lit(True).alias("_asked")).unionByName(
        marks.select(*key, at, F.lit(False).alias("_asked"), mark.alias("_mark")), allowMissingColumns=True)

    def carried(order: Column) -> Column:
        side = Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last("_mark", ignorenulls=True).over(side)

    def told(side: str) -> Column:
        dist = F.abs(F.col(side)["at"] - F.col(at))
        fields = [F.col(side)[v].alias(v) for v in ["at", *value]]
        return F.when(dist <= reach, F.struct(dist.alias("dist"), *fields))

    rows = both.withColumn("_below", carried(F.col(at))).withColumn("_above", carried(F.col(at).desc())).filter("_asked")
    below, above = told("_below"), told("_above")
    nearer = F.when(above.isNull() | (below["dist"] <= above["dist"]), below).otherwise(above)
    return rows.select(*key, at, nearer.alias(name))


def running_totals(df: DataFrame, order: Sequence[Column], measures: Sequence[str], key: Sequence[str] = (),
                   suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``measures`` per ``key`` (non-null columns) in the given order.

    Rows are dealt by ranges of (key, order) and written with the number of their slice, so a hot
    key is as many slices as its rows fill, and only rows that are equal in the whole order share one.
    A slice is summed row by row in one task; what lies before it comes from the sums of slices, one
    row per key and slice.  Two exchanges of the rows, whatever the order is made of.
    """
    place = [*key, "_slice"]
    dealt = written(df.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("_slice", F.spark_partition_id()), "slices")
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*place).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures]).select(
        *place, *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.select("*", *[F.sum(m).over(inside).alias(f"_w_{m}") for m in measures]).join(offsets, place)
    return rows.select(*df.columns, *[(F.col(f"_w_{m}") + F.col(f"_o_{m}")).alias(f"{m}{suffix}") for m in measures])
