"""Failure labels on a dense channel-day grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts.operators.marts import failures
from tritmarts.settings import Labelling

NO_FAILURE = 2**31 - 1


def sweep_days(fact: DataFrame, dim: DataFrame, cfg: Labelling = Labelling()) -> DataFrame:
    """Days on which many channels of one controller fail together."""
    base = dim.select("channel_id", "tag_base")
    failed = (fact.filter(failures() > 0).select("channel_id", "d").join(base, "channel_id")
              .groupBy("tag_base", "d").agg(F.count(F.lit(1)).alias("n_failed")))
    size = dim.groupBy("tag_base").agg(F.count(F.lit(1)).alias("n_total"))
    share = F.col("n_failed") / F.col("n_total")
    return (failed.join(size, "tag_base")
            .withColumn("share_failed", share)
            .filter((F.col("n_failed") >= cfg.sweep_min_channels)
                    | (F.col("share_failed") >= cfg.sweep_min_share))
            .select("tag_base", "d", "n_failed", "n_total", "share_failed"))


def calendar(fact: DataFrame) -> DataFrame:
    """Every day between the first and the last fact."""
    span = fact.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d"))


def twin_representatives(dim: DataFrame) -> DataFrame:
    return dim.groupBy("twin_group").agg(F.min("channel_id").alias("channel_id"))


def grid(dim: DataFrame, profile: DataFrame, cfg: Labelling = Labelling()) -> DataFrame:
    """One row per day of a channel's life, for channels fit for the model.

    Zone aggregates leak the target and power channels are another task; both
    are left out, as are artifact periods and blackout days.
    """
    fit = (dim.filter(~F.col("is_zone_aggregate") & ~F.col("is_power_type")).select("channel_id")
           .join(twin_representatives(dim).select("channel_id"), "channel_id", "left_semi"))
    days = (profile.select("channel_id", "first_day", "last_day").join(fit, "channel_id", "left_semi")
            .select("channel_id", F.explode(F.sequence(
                "first_day", "last_day", F.expr("interval 1 day"))).alias("d")))
    for first, last in cfg.artifact_periods:
        days = days.filter(~F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if cfg.blackout_days:
        days = days.filter(~F.col("d").isin([F.lit(x).cast("date") for x in cfg.blackout_days]))
    return days


def labels(days: DataFrame, fact: DataFrame, dim: DataFrame, sweeps: DataFrame,
           cfg: Labelling = Labelling()) -> DataFrame:
    """y = 1 when the channel fails, outside sweeps, in the following days.

    A failing day marks the ``h`` days before it, so the look-ahead is an equi
    join on (channel, day) instead of a range join.
    """
    h = cfg.horizon_days
    own = (fact.filter(failures() > 0).select("channel_id", "d")
           .join(dim.select("channel_id", "tag_base"), "channel_id")
           .join(sweeps.select("tag_base", "d"), ["tag_base", "d"], "left_anti"))
    marked = own.select("channel_id", F.explode(F.sequence(
        F.date_sub("d", h), F.date_sub("d", 1), F.expr("interval 1 day"))).alias("d"))
    if h > 1:
        marked = marked.distinct()
    return (days.join(marked.withColumn("_hit", F.lit(1)), ["channel_id", "d"], "left")
            .select("channel_id", "d", F.coalesce("_hit", F.lit(0)).alias("y")))


def days_to_failure(days: DataFrame, fact: DataFrame, dim: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(channel_id, d, ahead): days until the channel fails next outside sweeps, ``NO_FAILURE`` if it never does.

    One pass over the channel's days from the last to the first carries the
    nearest failing day, so every horizon is a comparison: y = 1 when ahead <= its
    days.  Failing days off the grid count, repeated days of the grid stay.
    """
    own = (fact.filter(failures() > 0).select("channel_id", "d")
           .join(dim.select("channel_id", "tag_base"), "channel_id")
           .join(sweeps.select("tag_base", "d"), ["tag_base", "d"], "left_anti"))
    both = days.select("channel_id", "d", F.lit(True).alias("_grid")).unionByName(
        own.select("channel_id", "d", F.lit(False).alias("_grid")))
    # days are compared as numbers, so that rows of one day do not see each other
    later = (Window.partitionBy("channel_id").orderBy(F.unix_date("d").desc())
             .rangeBetween(Window.unboundedPreceding, -1))
    failing = F.min(F.when(~F.col("_grid"), F.col("d"))).over(later)
    ahead = F.coalesce(F.datediff(failing, "d"), F.lit(NO_FAILURE))
    return both.select("channel_id", "d", "_grid", ahead.alias("ahead")).filter("_grid").drop("_grid")


def labels_within(ahead: DataFrame, cfg: Labelling = Labelling()) -> DataFrame:
    """Labels of one horizon from ``days_to_failure``."""
    return ahead.select("channel_id", "d", within(F.col("ahead"), cfg.horizon_days).alias("y"))


def within(ahead: Column, days: int) -> Column:
    return (ahead <= days).cast("int")


def label_balance(y: DataFrame) -> DataFrame:
    weekend = F.dayofweek("d").isin(1, 7)
    hits = F.sum("y")
    return y.agg(
        F.count(F.lit(1)).alias("channel_days"), hits.alias("positives"),
        F.round(100.0 * hits / F.count(F.lit(1)), 4).alias("share_percent"),
        F.round(100.0 * F.count_if((F.col("y") == 1) & weekend) / F.nullif(hits, F.lit(0)), 1)
        .alias("weekend_percent"))
