"""Distributions of channels, precursors, points and incident processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.quantiles import grouped_quantiles
from tritmarts.functions.written import written

PROBES = (1, 3, 7, 14, 30)


def _from(day: str) -> Column:
    return F.col("d") >= F.lit(day).cast("date")


def sensor_behaviour(fact: DataFrame, dim: DataFrame, labels: DataFrame, test_from: str) -> DataFrame:
    """Activity and daily failure rate of each sensor type.

    A channel's median is over its days, which a calendar bounds; that of a type is over all of
    its channels and picked by rank.
    """
    kinds = dim.select("channel_id", "sensor_type")
    life = F.datediff(F.max("d"), F.min("d")) + 1
    span = fact.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("active"), life.alias("life"), F.avg("n_ev").alias("mean"), F.median("n_ev").alias("med"))
    span = written(span.join(kinds, "channel_id"), "channel_spans")
    middle = grouped_quantiles(span, ["sensor_type"], F.col("med"), {"median": 0.5})
    activity = (span.groupBy("sensor_type")
                .agg(F.count(F.lit(1)).alias("channels"), F.round(F.avg("mean"), 2).alias("events_per_active_day"),
                     F.round(F.avg(F.col("active") / F.col("life")), 4).alias("active_share"))
                .join(middle.withColumnRenamed("sensor_type", "_type"), F.col("sensor_type").eqNullSafe(F.col("_type")), "left")
                .select("sensor_type", "channels", "events_per_active_day", F.round("median", 1).alias("median_events"),
                        "active_share"))
    rates = (labels.filter(_from(test_from)).groupBy("channel_id")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).join(kinds, "channel_id").groupBy("sensor_type")
             .agg(F.sum("n").alias("channel_days"), F.sum("y").alias("failures"),
                  F.round(F.sum("y") / F.sum("n"), 6).alias("daily_failure_rate")))
    return activity.join(rates, "sensor_type", "left").na.fill(0, ["channel_days", "failures", "daily_failure_rate"])


def precursor_profile(features: DataFrame, test_from: str) -> DataFrame:
    """How far each feature rises on the day before a failure."""
    names = fv.PRECURSOR_FEATURES
    means = features.filter(_from(test_from)).agg(*[
        F.avg(F.when(F.col("y") == y, F.col(n))).alias(f"{n}_{y}") for n in names for y in (0, 1)])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}_1").alias("before"), F.col(f"{n}_0").alias("usual"))
                     for n in names])
    x = means.select(F.explode(rows).alias("x")).select("x.*")
    return x.select("feature", F.round("before", 4).alias("before"), F.round("usual", 4).alias("usual"),
                    F.round(F.col("before") / F.nullif("usual", F.lit(0.0)), 1).alias("ratio"))


def early_signal(features: DataFrame, test_from: str) -> DataFrame:
    """Share of failing channels that already showed a sign some days earlier."""
    fails = (features.filter((F.col("y") == 1) & _from(test_from)).select("channel_id", F.col("d").alias("fail_day"))
             .withColumn("horizon", F.explode(F.array(*map(F.lit, PROBES))))
             .select("channel_id", "horizon", F.expr("date_sub(fail_day, horizon)").alias("d")))
    seen = features.select("channel_id", "d", (F.col("fault_ev_7d") > 0).cast("int").alias("f"),
                           (F.col("undefined_ev_7d") > 0).cast("int").alias("u"))
    per = fails.join(seen, ["channel_id", "d"]).groupBy("channel_id", "horizon").agg(F.max("f").alias("f"), F.max("u").alias("u"))
    return per.groupBy("horizon").agg(F.round(F.avg("f"), 4).alias("with_fault"), F.round(F.avg("u"), 4).alias("with_undefined"))


def instrumentation(dim: DataFrame) -> DataFrame:
    """Points and channels by number of sensor types at the point."""
    per = (dim.filter("picket IS NOT NULL").groupBy("object_id", "picket", "sensor_type").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("object_id", "picket").agg(F.count("sensor_type").alias("n_types"), F.sum("n").alias("n")))
    return per.groupBy("n_types").agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("channels"))


def _beside(row: DataFrame, quantiles: DataFrame) -> DataFrame:
    """The one row of an aggregate with that of its quantiles, which is absent where there are no values."""
    one = F.lit(1)
    return row.withColumn("_one", one).join(quantiles.withColumn("_one", one), "_one", "left").drop("_one")


def pump_statistics(days: DataFrame) -> DataFrame:
    """Starts per active day of all pumps."""
    active = days.filter("n_starts > 0").select("n_starts")
    row = active.agg(F.round(F.avg("n_starts"), 2).alias("mean"), F.max("n_starts").alias("max"))
    ranks = grouped_quantiles(active, [], F.col("n_starts"), {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return _beside(row, ranks).select("mean", "median", "p90", "p99", "max")


def pump_months(days: DataFrame) -> DataFrame:
    return days.groupBy(F.month("d").alias("month")).agg(F.round(F.avg("n_starts"), 2).alias("starts"))


def smoke_statistics(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("is_sweep").agg(
        F.count(F.lit(1)).alias("episodes"), F.round(F.avg("n_smoke_ch"), 2).alias("channels"),
        F.round(F.avg("n_smoke_ev"), 2).alias("triggers"),
        F.round(F.avg(F.when(F.col("has_thermal"), 1.0).otherwise(0.0)), 4).alias("with_thermal"),
        F.round(F.avg("domain_size"), 2).alias("point_channels"))


def intrusion_statistics(episodes: DataFrame) -> DataFrame:
    minutes = F.floor(F.col("last_t") / 60) - F.floor(F.col("first_t") / 60)
    row = episodes.agg(
        F.round(F.avg("n_triggers"), 2).alias("triggers"),
        F.round(F.avg("n_types"), 2).alias("types"), F.round(F.avg(minutes), 1).alias("minutes"),
        F.round(F.avg(F.when(F.col("is_night"), 1.0).otherwise(0.0)), 4).alias("night_share"))
    middle = grouped_quantiles(episodes, [], F.col("n_triggers"), {"median": 0.5})
    return _beside(row, middle).select("triggers", "median", "types", "minutes", "night_share")


def temperature_statistics(days: DataFrame) -> DataFrame:
    return days.agg(
        F.round(F.avg("t_avg"), 2).alias("mean"), F.round(F.avg(F.col("t_max") - F.col("t_min")), 2).alias("daily_range"),
        F.round(F.stddev_samp("t_avg"), 2).alias("spread_between_points"),
        F.round(F.avg("n_channels"), 2).alias("sensors_per_point"))


def domain_histogram(domains: DataFrame) -> DataFrame:
    return domains.groupBy(F.col("n_channels").alias("channels")).agg(F.count(F.lit(1)).alias("domains"))


def missing_controls(dim: DataFrame) -> DataFrame:
    """How many objects lack each kind of control."""
    flags = dim.groupBy("parent_name").agg(*[
        F.count_if(F.col("sensor_type") == kind).alias(f"_{i}") for i, (kind, _) in enumerate(fv.CONTROL_TYPES)])
    counts = flags.agg(*[F.count_if(F.col(f"_{i}") == 0).alias(f"_{i}") for i in range(len(fv.CONTROL_TYPES))])
    rows = F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"_{i}").alias("objects_without"))
                     for i, (_, t) in enumerate(fv.CONTROL_TYPES)])
    return counts.select(F.explode(rows).alias("x")).select("x.type", "x.objects_without")


def facts_panel(dim: DataFrame, profile: DataFrame, domains: DataFrame, candidates: DataFrame, health: DataFrame) -> DataFrame:
    """Headline numbers as (fact, value) rows."""
    local = ~F.col("is_sweep")

    def rows(df: DataFrame, **named: Column) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(k).alias("fact"), F.col(k).cast("bigint").alias("value")) for k in named])
        return df.agg(*[v.alias(k) for k, v in named.items()]).select(F.explode(cells).alias("x")).select("x.fact", "x.value")

    n = F.count(F.lit(1))
    ends = (profile.select(F.lit(1).alias("k")).unionByName(dim.select(F.lit(-1).alias("k"))))
    return (rows(dim, channels=n, objects=F.count_distinct("parent_name"))
            .unionByName(rows(ends, orphans=F.sum("k")))
            .unionByName(rows(domains, domains=n, domains_single=F.count_if(F.col("n_channels") == 1)))
            .unionByName(rows(candidates, fire_local=F.count_if(local), fire_no_thermal=F.count_if(local & ~F.col("has_thermal"))))
            .unionByName(rows(health, guards=n, guards_stuck=F.count_if(F.col("is_stuck")))))
