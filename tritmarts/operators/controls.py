"""Quality controls: own-fault window, strata, incident detection against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.attach import with_row
from tritmarts.operators.marts import failures


def own_fault_window(fact: DataFrame, dim: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Trailing sum over 7 active days of faults outside sweep days."""
    swept = sweeps.select("tag_base", "d", F.lit(True).alias("_swept"))
    rows = (fact.select("channel_id", "d", failures().alias("f"))
            .join(dim.select("channel_id", "tag_base"), "channel_id")
            .join(swept, ["tag_base", "d"], "left")
            .withColumn("own", F.when(F.col("_swept"), F.lit(0)).otherwise(F.col("f"))))
    week = Window.partitionBy("channel_id").orderBy("d").rowsBetween(-6, 0)
    return rows.select("channel_id", "d", F.sum("own").over(week).alias("own_fault_7d"))


def with_own_fault(scored: DataFrame, own: DataFrame) -> DataFrame:
    return (scored.join(own, ["channel_id", "d"], "left")
            .withColumn("own_fault_7d", F.coalesce("own_fault_7d", F.lit(0)))
            .withColumn("fault_ev_7d", F.coalesce("fault_ev_7d", F.lit(0.0))))


def strata() -> dict[str, Column]:
    """Named conditions over fault_ev_7d and own_fault_7d."""
    fault, own = F.col("fault_ev_7d"), F.col("own_fault_7d")
    return {"fresh": fault == 0, "own_fault": own > 0, "sweep_only": (fault > 0) & (own == 0),
            "ongoing": fault != 0, "all": F.lit(True)}


def exploded_strata(scored: DataFrame) -> DataFrame:
    """One row per population a scored row belongs to (at most four)."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in strata().items()]))
    return scored.select("channel_id", "d", "y", "score", F.explode(names).alias("population"))


def incident_metrics(truth: DataFrame, fact: DataFrame, dim: DataFrame, smoke: DataFrame,
                     reach: int = 2) -> DataFrame:
    """Detection of true incidents by triggers within a few pickets the same day.

    ``truth`` has scenario, d, picket (one row per event).  Every scenario has a
    row, also without a true event, with its false alarms and the sensor types that
    are in place for it.  The band join is an equi join: each place of true events is spread over the
    pickets it can be seen from.  What is seen from a place, one bit per type of the scenario, then
    meets all of its events, so rows of events are neither repeated nor gathered into sets.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(t).alias("sensor_type"),
                                         F.lit(1 << list(ts).index(t)).cast("bigint").alias("bit"))
                                for s, ts in fv.INCIDENT_TYPES.items() for t in ts])).alias("k")
    spec = truth.sparkSession.range(1).select(kinds).select("k.*")
    sweep = smoke.filter("is_sweep").select("d").distinct()

    raw = (fact.filter(F.col("n_trigger") > 0).select("channel_id", "d")
           .join(dim.select("channel_id", "picket", "sensor_type"), "channel_id"))
    kept = raw.join(sweep, "d", "left_anti")
    # triggers of a point, day and type: what detection needs, already folded
    seen = kept.groupBy("d", "picket", "sensor_type").agg(F.count(F.lit(1)).alias("n")).join(spec, "sensor_type")

    near = F.explode(F.sequence(F.col("picket") - reach, F.col("picket") + reach)).alias("picket")
    events = truth.select("event_no", "scenario", "d", "picket")
    reachable = events.select("scenario", "d", "picket").distinct().select(
        "scenario", "d", F.col("picket").alias("_at"), near)
    in_sight = (reachable.join(seen, ["scenario", "d", "picket"])
                .groupBy("scenario", "d", F.col("_at").alias("picket")).agg(F.bit_or("bit").alias("types")))
    caught = (events.hint("merge").join(in_sight, ["scenario", "d", "picket"])  # events are never sent whole to the places
              .groupBy("scenario", "event_no").agg(F.bit_or("types").alias("types"))
              .groupBy("scenario")
              .agg(F.count(F.lit(1)).alias("detected"), F.count_if(F.bit_count("types") >= 2).alias("confirmed")))
    covered = reachable.select("scenario", "d", "picket").distinct()
    wrong = seen.join(covered, ["scenario", "d", "picket"], "left_anti")
    false_points = wrong.groupBy("scenario", "d", "picket").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
    false = false_points.groupBy("scenario").agg(
        F.sum("n").alias("false_alarms"), F.count_if((F.col("types") >= 2) & F.col("picket").isNotNull()).alias("false_confirmed"))
    lost = (events.join(sweep, "d", "left_semi").groupBy("scenario")
            .agg(F.count(F.lit(1)).alias("events_in_dropped_days")))
    base = events.groupBy("scenario").agg(F.count(F.lit(1)).alias("events"))
    dropped = with_row(raw.join(sweep, "d", "left_semi").agg(F.count(F.lit(1)).alias("triggers_dropped")),
                       sweep.agg(F.count(F.lit(1)).alias("sweep_days")))
    installed = dim.filter(F.col("picket").isNotNull()).select("sensor_type").distinct()
    places = spec.groupBy("scenario").agg(F.lit(0).alias("_")).drop("_").join(
        spec.join(installed, "sensor_type").groupBy("scenario").agg(F.sort_array(F.collect_list("sensor_type")).alias("types_in_place")),
        "scenario", "left").withColumn("types_in_place", F.coalesce("types_in_place", F.array().cast("array<string>")))
    out = places.join(base, "scenario", "left").join(caught, "scenario", "left").join(false, "scenario", "left").join(lost, "scenario", "left")
    out = with_row(out, dropped).na.fill(0, ["events", "detected", "confirmed", "false_alarms", "false_confirmed", "events_in_dropped_days"])

    def part(a: str, whole: Column) -> Column:
        return F.coalesce(F.col(a) / F.nullif(whole, F.lit(0)), F.lit(0.0))

    return (out
            .withColumn("recall", part("detected", F.col("events")))
            .withColumn("precision", part("detected", F.col("detected") + F.col("false_alarms")))
            .withColumn("recall_confirmed", part("confirmed", F.col("events")))
            .withColumn("precision_confirmed", part("confirmed", F.col("confirmed") + F.col("false_confirmed")))
            .withColumn("confirmability", part("confirmed", F.col("detected"))))


def busiest_failure_day(features: DataFrame) -> DataFrame:
    """Day with the most positives; the later one on a tie."""
    per = features.groupBy("d").agg(F.sum(F.col("y").cast("bigint")).alias("failures"))
    return per.orderBy(F.col("failures").desc(), F.col("d").desc()).limit(1)
