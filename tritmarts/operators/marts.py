"""Dimensions and day marts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.ordering import running_totals
from tritmarts.functions.written import written
from tritmarts.operators.contract import classify
from tritmarts.settings import Measurement

#: journal rows of one slice of the day roll-up, on average
SLICE_ROWS = 150_000


def channel_dimension(channels: DataFrame, objects: DataFrame) -> DataFrame:
    """Channel passport: location, picket, grouping tag and exclusion flags."""
    own = objects.select("object_id", "object_name", "object_kind", "parent_id")
    parents = objects.select(F.col("object_id").alias("parent_id"),
                             F.col("object_name").alias("parent_name"))
    name = F.lower("sensor_name")
    zone = name.contains(fv.ZONE_MARKERS[0])
    for marker in fv.ZONE_MARKERS[1:]:
        zone = zone | name.contains(marker)
    return (channels
            .join(own, "object_id", "left")
            .join(parents, "parent_id", "left")
            .select("channel_id", "system", "sensor_type", "sensor_name", "tag", "object_id",
                    F.split_part("tag", F.lit("-"), F.lit(1)).alias("tag_base"),
                    F.regexp_extract("sensor_name", fv.PICKET_PATTERN, 1).try_cast("int").alias("picket"),
                    "object_name", "object_kind", "parent_id", "parent_name",
                    zone.alias("is_zone_aggregate"),
                    F.col("sensor_type").isin(fv.POWER_TYPES).alias("is_power_type")))


def with_twins(dim: DataFrame) -> DataFrame:
    """Channels sharing object, name and type: group size and group number.

    The number is a dense rank in (object, name, type) order: a running total over distinct
    keys, so no task ranks a whole object.
    """
    groups = dim.groupBy("object_id", "sensor_name", "sensor_type").agg(F.count(F.lit(1)).alias("twin_count"))
    ranked = running_totals(groups.withColumn("_one", F.lit(1).cast("bigint")),
                            [F.col(c).asc_nulls_last() for c in ("object_id", "sensor_name", "sensor_type")], ["_one"])
    g = ranked.select(F.col("object_id").alias("_o"), F.col("sensor_name").alias("_n"),
                      F.col("sensor_type").alias("_t"), "twin_count",
                      F.col("_one_cum").alias("twin_group"))
    same = (dim["object_id"].eqNullSafe(F.col("_o")) & dim["sensor_name"].eqNullSafe(F.col("_n"))
            & dim["sensor_type"].eqNullSafe(F.col("_t")))
    return dim.join(g, same).drop("_o", "_n", "_t")


def channel_day_of_classes(classified: DataFrame) -> DataFrame:
    """Channel-day counters, states, readings and clock marks of classified rows."""
    cls, t = F.col("cls"), F.col("t_sec")

    def of(*names: str) -> Column:
        return cls.isin(*names)

    broken = of(fv.FAULT, fv.DISABLED)
    return classified.groupBy("channel_id", "d").agg(
        F.count(F.lit(1)).alias("n_ev"),
        F.count_if(F.col("is_alarm")).alias("n_alarm"),
        F.max("trit").alias("trit_day"),
        F.count_if(of(fv.NORM)).alias("n_norm"),
        F.count_if(of(fv.TRIGGER)).alias("n_trigger"),
        F.count_if(of(fv.FAULT)).alias("n_fault"),
        F.count_if(of(fv.DISABLED)).alias("n_disabled"),
        F.count_if(of(fv.UNDEFINED)).alias("n_undefined"),
        F.count_if(of(fv.GARBAGE)).alias("n_garbage"),
        F.count_if(of(fv.NUMERIC)).alias("n_numeric"),
        F.avg("num_ok").alias("num_avg"),
        F.min("num_ok").alias("num_min"),
        F.max("num_ok").alias("num_max"),
        F.count("num_ok").alias("n_num_ok"),
        F.min(t).alias("t_first"),
        F.max(t).alias("t_last"),
        F.min(F.when(broken, t)).alias("t_first_fault"),
        F.max(F.when(broken, t)).alias("t_last_fault"),
        F.min(F.when(of(fv.TRIGGER), t)).alias("t_first_trigger"),
        F.min(F.when(of(fv.UNDEFINED), t)).alias("t_first_undefined"))


def fact_channel_day(journal: DataFrame, dim_channel: DataFrame, contract: DataFrame,
                     m: Measurement = Measurement()) -> DataFrame:
    """Classification and the channel-day roll-up of the journal.

    A channel-day holds few rows, so counters made before the exchange would be nearly as many as the rows,
    and far wider, in a table as large as the part of a file that a task reads.  The rows themselves are
    dealt by channel-day, into as many slices as their number asks for.
    """
    rows = journal.select("channel_id", "d", "t_sec", "is_alarm", "raw_value")
    slices = max(1, math.ceil(rows.count() / SLICE_ROWS))
    return channel_day_of_classes(classify(rows, dim_channel, contract, m).repartition(slices, "channel_id", "d"))


def failures(fact: DataFrame | None = None) -> Column:
    return F.col("n_fault") + F.col("n_disabled")


def fact_object_day(fact: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """Object-day activity.  A fact row is one channel, so rows are counted."""
    place = dim_channel.select("channel_id", "object_id", "parent_id")
    return (fact.join(place, "channel_id")
            .groupBy("object_id", "parent_id", "d")
            .agg(F.count(F.lit(1)).alias("n_channels_active"),
                 F.sum("n_ev").alias("n_ev"),
                 F.sum("n_alarm").alias("n_alarm"),
                 F.sum(failures()).alias("n_failure_ev"),
                 F.count_if(F.col("trit_day") == fv.DEVIATION).alias("n_ch_deviation"),
                 F.count_if(F.col("trit_day") == fv.UNKNOWN).alias("n_ch_unknown"),
                 F.count_if(F.col("trit_day") == fv.NORMAL).alias("n_ch_normal"),
                 F.max("trit_day").alias("trit_day")))


def channel_profile(fact: DataFrame) -> DataFrame:
    """What is usual for a channel: span, activity, typical gap."""
    base = fact.groupBy("channel_id").agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"),
        F.count(F.lit(1)).alias("active_days"), F.sum("n_ev").alias("total_ev"),
        F.median("n_ev").alias("median_ev_per_active_day"),
        F.percentile("n_ev", 0.95).alias("p95_ev_per_active_day"))
    life = F.datediff("last_day", "first_day") + 1
    return (base.withColumn("lifespan_days", life.cast("bigint"))
            .withColumn("active_share", F.col("active_days") / life)
            .withColumn("mean_gap_days", life / F.col("active_days")))
