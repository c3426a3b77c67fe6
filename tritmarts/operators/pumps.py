"""Pumping regime: starts per day, seasonal norm, anomaly, network context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text
from tritmarts.functions.ordering import with_neighbour
from tritmarts.settings import Pumping

START_FORMS = ("пуск", "пуска", "пусков")


def pump_day(journal: DataFrame, dim: DataFrame) -> DataFrame:
    """Starts, stops and on-time per pump and day.

    A start is OFF followed by ON, whatever the days; on-time counts only runs
    that begin and end on the same day.
    """
    pumps = dim.filter(F.col("sensor_type") == fv.PUMP).select("channel_id")
    rows = (journal.select("channel_id", "d", "t_sec", "event_id", "raw_value")
            .join(pumps, "channel_id", "left_semi"))
    seq = with_neighbour(rows, ["channel_id"], "d", ["d", "t_sec", "event_id"], ["raw_value", "d", "t_sec"])
    before, now, t = F.col("prev.raw_value"), F.col("raw_value"), F.col("t_sec")
    start = (now == fv.ON) & (before == fv.OFF)
    stop = (now == fv.OFF) & (before == fv.ON)
    same_day = stop & (F.col("prev.d") == F.col("d"))
    return seq.groupBy("channel_id", "d").agg(
        F.count_if(start).alias("n_starts"),
        F.min(F.when(start, t)).alias("t_first_start"), F.max(F.when(start, t)).alias("t_last_start"),
        F.count_if(stop).alias("n_stops"),
        F.coalesce(F.sum(F.when(same_day, t - F.col("prev.t_sec"))), F.lit(0)).alias("duty_seconds"),
        F.count(F.lit(1)).alias("n_ev"))


def pump_baseline(days: DataFrame) -> DataFrame:
    """Personal norm per pump and month over active days, with its spread.

    The median absolute deviation needs the median first, so it is a second
    aggregate joined on the same key.
    """
    active = days.filter("n_starts > 0").select(
        "channel_id", F.month("d").alias("mon"), "n_starts", "duty_seconds")
    norm = active.groupBy("channel_id", "mon").agg(
        F.median("n_starts").alias("med_starts"), F.percentile("n_starts", 0.95).alias("p95_starts"),
        F.median("duty_seconds").alias("med_duty"), F.count(F.lit(1)).alias("n_days"))
    spread = (active.join(norm.select("channel_id", "mon", "med_starts"), ["channel_id", "mon"])
              .groupBy("channel_id", "mon")
              .agg(F.median(F.abs(F.col("n_starts") - F.col("med_starts"))).alias("mad_starts")))
    return norm.join(spread, ["channel_id", "mon"])


def pump_anomaly(days: DataFrame, baseline: DataFrame, cfg: Pumping = Pumping()) -> DataFrame:
    """Deviation of the regime as a trit; a pump without a norm is unknown."""
    rows = (days.select("channel_id", "d", "n_starts", "duty_seconds", F.month("d").alias("mon"))
            .join(baseline.drop("med_duty"), ["channel_id", "mon"], "left"))
    n, med, mad = F.col("n_starts"), F.col("med_starts"), F.col("mad_starts")
    usual = F.coalesce(med, F.lit(0.0))
    z = F.when(mad > 0, (n - med) / (1.4826 * mad))
    small = (n < cfg.min_starts) | (n - usual < cfg.min_excess) | (n < usual * cfg.min_ratio)
    beyond = F.when(F.coalesce(mad, F.lit(0.0)) == 0, n > F.col("p95_starts")).otherwise(z >= cfg.z_threshold)
    trit = (F.when(F.coalesce("n_days", F.lit(0)) < cfg.min_days, F.lit(fv.UNKNOWN))
            .when(~small & beyond, F.lit(fv.DEVIATION)).otherwise(F.lit(fv.NORMAL)))
    return rows.select("channel_id", "d", "n_starts", "duty_seconds", "med_starts", "p95_starts",
                       z.alias("robust_z"), F.when(med > 0, n / med).alias("ratio_to_norm"), trit.alias("trit"))


def network_days(anomaly: DataFrame, cfg: Pumping = Pumping()) -> DataFrame:
    """Hot and active pumps of the whole network per day."""
    hot = F.count_if(F.col("trit") == fv.DEVIATION)
    return anomaly.groupBy("d").agg(
        hot.alias("n_hot"), F.count(F.lit(1)).alias("n_active"),
        (hot >= cfg.network_hot_min).alias("is_network_event"))


def upstream_neighbours(anomaly: DataFrame, dim: DataFrame, probes: DataFrame,
                        cfg: Pumping = Pumping()) -> DataFrame:
    """Pumps within some pickets of each probed point (d, object_id, picket).

    Pickets are cut into bands of the radius; a probe looks into three bands,
    which makes the band join an equi join.  Probes are points, not channels,
    so a pump row is repeated at most once per point in reach.
    """
    r = cfg.radius
    points = (probes.select("d", "object_id", F.col("picket").alias("probe_picket")).distinct()
              .withColumn("_band", F.explode(F.sequence(F.floor(F.col("probe_picket") / r) - 1,
                                                        F.floor(F.col("probe_picket") / r) + 1))))
    pumps = (anomaly.select("channel_id", "d", "n_starts", "med_starts", "trit")
             .join(dim.select("channel_id", "object_id", "picket", "sensor_name"), "channel_id")
             .filter(F.col("picket").isNotNull())
             .withColumn("_band", F.floor(F.col("picket") / r)))
    near = F.abs(F.col("picket") - F.col("probe_picket")) <= r
    return (points.join(pumps, ["d", "object_id", "_band"]).filter(near)
            .select("d", "object_id", "probe_picket", "picket", "channel_id", "sensor_name",
                    "n_starts", "med_starts", "trit"))


def starts_phrase(n: Column, norm: Column, name: Column) -> Column:
    head = F.concat(name, F.lit(": "), text.counted(n, START_FORMS), F.lit(" за сутки"))
    return (F.when(norm > 0, F.concat(head, F.lit(" против нормы "), text.whole(norm)))
            .otherwise(F.concat(head, F.lit(", личной нормы ещё нет"))))
