"""Schematic geometry: object axis from its pickets, verdict points along it."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.settings import Cards

MIN_METERS = 200


def _named(dim: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("parent_name", F.lit("")), F.nullif("object_name", F.lit("")))
    return dim.select(name.alias("object_name"), "sensor_name", "picket").filter("object_name IS NOT NULL")


def _stems(text: Column) -> Column:
    """All place stems in a text, in one pass: each place of the text is tried once against all of them.

    No stem begins another, so what is found at every place are the occurrences of each stem alone.
    """
    any_stem = "|".join(re.escape(stem.lower()) for stem, _, _ in fv.DISTRICT_ANCHORS)
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?=({any_stem}))"), F.lit(1))


def toponyms(dim: DataFrame) -> DataFrame:
    """Place name found most often in an object's sensor names; earlier entries win ties."""
    order = {stem.lower(): i for i, (stem, _, _) in reversed(list(enumerate(fv.DISTRICT_ANCHORS)))}
    hits = (_named(dim).select("object_name", F.explode_outer(_stems(F.col("sensor_name"))).alias("key"))
            .groupBy("object_name", "key").agg(F.count("key").alias("n")))
    rank, name = None, None
    for key, i in order.items():
        found = F.col("key") == key
        rank = (F if rank is None else rank).when(found, F.lit(-i))
        name = (F if name is None else name).when(found, F.lit(fv.DISTRICT_ANCHORS[i][0]))
    best = F.max(F.when(F.col("n") > 0, F.struct("n", rank.alias("rank"), name.alias("stem"))))
    return hits.groupBy("object_name").agg(best.alias("_best")).select("object_name", F.col("_best.stem").alias("toponym"))


def bearing(name: Column) -> Column:
    """Stable direction of an axis: sum of code points modulo 360, in radians."""
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    total = F.aggregate(letters, F.lit(0), lambda a, c: a + F.ascii(c))
    return F.pmod(total, F.lit(360)) * math.pi / 180.0


def axis_lines(dim: DataFrame, cfg: Cards = Cards()) -> DataFrame:
    """Picket range, anchor and end points of each object's axis."""
    spans = _named(dim).groupBy("object_name").agg(F.min("picket").alias("picket_min"), F.max("picket").alias("picket_max"))
    rows = spans.filter("picket_min IS NOT NULL").join(toponyms(dim), "object_name")

    def anchor(index: int) -> Column:
        out = None
        for row in fv.DISTRICT_ANCHORS:
            out = (F if out is None else out).when(F.col("toponym") == row[0], F.lit(row[index]))
        return out.otherwise(F.lit(fv.DEFAULT_ANCHOR[index - 1]))

    reach = (F.col("picket_max") - F.col("picket_min")) * cfg.picket_meters
    meters = F.greatest(reach, F.lit(MIN_METERS))
    rows = (rows.withColumn("lat0", anchor(1)).withColumn("lon0", anchor(2)).withColumn("length_m", reach)
            .withColumn("_b", bearing(F.col("object_name")))
            .withColumn("_dlat", meters * F.cos("_b") / fv.METERS_PER_DEGREE / 2)
            .withColumn("_dlon", meters * F.sin("_b") / (fv.METERS_PER_DEGREE * F.cos(F.radians("lat0"))) / 2))
    return rows.select("object_name", "toponym", F.col("toponym").isNotNull().alias("anchor_known"), "picket_min",
                       "picket_max", "length_m", (F.col("lat0") - F.col("_dlat")).alias("lat1"),
                       (F.col("lon0") - F.col("_dlon")).alias("lon1"), (F.col("lat0") + F.col("_dlat")).alias("lat2"),
                       (F.col("lon0") + F.col("_dlon")).alias("lon2"))


def picket_position() -> tuple[Column, Column]:
    """(lat, lon) of ``picket`` on an axis row; outside pickets are clamped."""
    low, high = F.col("picket_min"), F.col("picket_max")
    t = F.when(low == high, F.lit(0.0)).otherwise(
        F.least(F.greatest((F.col("picket") - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0)), F.lit(1.0)))
    return (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t,
            F.col("lon1") + (F.col("lon2") - F.col("lon1")) * t)


def object_geometry(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Axis rows of the objects that have cards."""
    return lines.join(headers.select("object_name", "n_cards", "max_probability"), "object_name")


def verdict_points(cards: DataFrame, lines: DataFrame) -> DataFrame:
    lat, lon = picket_position()
    return (cards.filter("picket IS NOT NULL").join(lines, "object_name")
            .select("object_name", "picket", "scenario", "probability", "title", lat.alias("lat"), lon.alias("lon")))
