"""Twins and logical domains (all channels of one object and picket)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.ordering import running_totals
from tritmarts.functions.quantiles import grouped_quantiles
from tritmarts.functions.written import written
from tritmarts.settings import Cards

_BLOCK = 62


def twin_synchrony(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """How often twins share a state on common days, without listing pairs.

    On one day a group with n rows has n(n-1)/2 pairs and, per state with c
    rows, c(c-1)/2 equal ones.  The number of distinct pairs that ever met is
    counted over classes of members with the same active days: classes are numbered densely
    in their group, each ORs the day masks of its days, and the sizes of the classes it
    met are added from their binary digits.
    """
    members = dim.filter(F.col("twin_count") > 1).select(
        "twin_group", "channel_id", "sensor_name", "sensor_type")
    days = fact.select("channel_id", "d", "trit_day").join(members, "channel_id")

    per_state = days.groupBy("twin_group", "d", "trit_day").agg(F.count(F.lit(1)).alias("c"))
    per_day = per_state.groupBy("twin_group", "d").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("equal"))
    met = (per_day.filter(F.col("n") > 1).groupBy("twin_group")
           .agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("shared_days"),
                F.sum("equal").alias("equal")))

    days_of = days.groupBy("twin_group", "channel_id").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("d")).alias("h1"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("h2"))
    same_days = ["twin_group", "k", "h1", "h2"]
    classes = (days_of.groupBy(*same_days).agg(F.count(F.lit(1)).alias("size"), F.min("channel_id").alias("channel_id"))
               .withColumn("one", F.lit(1).cast("bigint")))
    numbered = written(running_totals(classes, [F.col("k"), F.col("h1"), F.col("h2")], ["one"], key=["twin_group"])
                       .select("twin_group", "channel_id", "size", F.floor((F.col("one_cum") - 1) / _BLOCK).alias("block"),
                               F.pmod(F.col("one_cum") - 1, F.lit(_BLOCK)).cast("int").alias("bit")), "twin_classes")
    active = days.select("twin_group", "channel_id", "d").join(numbered, ["twin_group", "channel_id"])
    masks = active.groupBy("twin_group", "d", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    seen = (active.select("twin_group", "channel_id", "size", "d").join(masks, ["twin_group", "d"])
            .groupBy("twin_group", "channel_id", "size", "block").agg(F.bit_or("mask").alias("seen")))
    planes = (numbered.select("twin_group", "block", "bit", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(30)), lambda p: F.getbit("size", p))).alias("power", "on")).filter("on = 1")
        .groupBy("twin_group", "block", "power").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("plane")))
    met_rows = F.bit_count(F.col("seen").bitwiseAND(F.col("plane"))).cast("bigint") * F.expr("shiftleft(1L, power)")
    partners = (seen.join(planes, ["twin_group", "block"])
                .groupBy("twin_group", "channel_id", "size").agg(F.sum(met_rows).alias("seen"))
                .groupBy("twin_group").agg((F.sum(F.col("size") * (F.col("seen") - 1)) / 2).cast("bigint").alias("n_pairs")))

    names = members.groupBy("twin_group").agg(F.min("sensor_name").alias("sensor_name"),
                                              F.min("sensor_type").alias("sensor_type"))
    return (met.join(partners, "twin_group").join(names, "twin_group")
            .select("twin_group", "sensor_name", "sensor_type", "n_pairs", "shared_days",
                    (F.col("equal") / F.col("shared_days")).alias("sync_rate")))


def synchrony_buckets(sync: DataFrame) -> DataFrame:
    """Groups, pairs and the median rate per bucket; the median is picked by rank."""
    bucket = None
    for floor, label in fv.SYNC_BUCKETS:
        bucket = (F if bucket is None else bucket).when(F.col("sync_rate") >= floor, F.lit(label))
    rows = sync.select(F.coalesce(bucket, F.lit("")).alias("bucket"), "sync_rate", "n_pairs")
    totals = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_pairs").alias("pairs"))
    middle = grouped_quantiles(rows, ["bucket"], F.col("sync_rate"), {"median_sync": 0.5})
    return totals.join(middle, "bucket").select(F.nullif("bucket", F.lit("")).alias("bucket"), "groups", "pairs", "median_sync")


def logical_domains(dim: DataFrame) -> DataFrame:
    """Channels of one point that can confirm each other.

    Types and systems are few, so their sets stay small.  The channel ids of a
    point have no bound and are rows of their own (``domain_channels``).
    """
    kind = F.col("sensor_type")
    cols = [
        F.count(F.lit(1)).alias("n_channels"),
        F.size(F.collect_set("sensor_type")).alias("n_sensor_types"),
        F.size(F.collect_set("system")).alias("n_systems"),
        F.sort_array(F.collect_set("sensor_type")).alias("sensor_types"),
        F.min("object_name").alias("object_name"),
        F.min("parent_name").alias("parent_name"),
        F.bool_or(kind.isin(fv.THERMAL_TYPES)).alias("has_thermal"),
        F.bool_or(kind == fv.SMOKE).alias("has_smoke"),
        F.bool_or(kind == fv.PUMP).alias("has_pump"),
        F.bool_or(kind.isin(fv.INTRUSION_DOMAIN_TYPES)).alias("has_intrusion")]
    return (dim.filter(F.col("picket").isNotNull() & ~F.col("is_zone_aggregate"))
            .groupBy("object_id", "picket").agg(*cols))


def domain_channels(dim: DataFrame, page_size: int = Cards.page_size) -> DataFrame:
    """The id lists of points as pages of bounded length, for points of any size."""
    rows = (dim.filter(F.col("picket").isNotNull() & ~F.col("is_zone_aggregate"))
            .select("object_id", "picket", "channel_id"))
    paged = rows.withColumn("page", F.floor(F.col("channel_id") / page_size))
    return (paged.groupBy("object_id", "picket", "page")
            .agg(F.sort_array(F.collect_list("channel_id")).alias("channel_ids")))


def domain_size_buckets(domains: DataFrame) -> DataFrame:
    n, bucket = F.col("n_channels"), None
    for limit, label in fv.DOMAIN_BUCKETS:
        if limit is None:
            bucket = bucket.otherwise(F.lit(label))
        else:
            bucket = (F if bucket is None else bucket).when(n <= limit, F.lit(label))
    return (domains.groupBy(bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("domains"), F.sum("n_channels").alias("channels")))


def smoke_thermal_crosstab(domains: DataFrame) -> DataFrame:
    return (domains.filter("has_smoke").groupBy("has_smoke", "has_thermal")
            .agg(F.count(F.lit(1)).alias("domains"), F.sum("n_channels").alias("channels")))
