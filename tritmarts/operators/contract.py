"""Value contract: (sensor type, raw value) to semantic class and trit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import trits
from tritmarts.functions.numbers import measured, to_number
from tritmarts.functions.ordering import with_neighbour
from tritmarts.settings import Measurement


def classify(journal: DataFrame, dim_channel: DataFrame, contract: DataFrame,
             m: Measurement = Measurement(), orphan_type: str | None = None) -> DataFrame:
    """Journal rows with ``num_ok``, ``cls`` and ``trit``.

    An exact contract pair wins; otherwise a valid reading is telemetry and
    everything else is garbage.  Channels missing from the dictionary have no
    sensor type and fall through to the fallback, unless ``orphan_type`` names
    the contract type to use for them.
    """
    types = dim_channel.select("channel_id", "sensor_type")
    pairs = contract.select("sensor_type", "raw_value", F.col("cls").alias("_listed"))
    typed = journal.join(types, "channel_id", "left")
    if orphan_type:
        typed = typed.withColumn("sensor_type", F.coalesce("sensor_type", F.lit(orphan_type)))
    raw = F.col("raw_value")
    fallback = (F.when(raw.startswith(fv.EPOCH_PREFIX), F.lit(fv.GARBAGE))
                .when(F.col("num_ok").isNotNull(), F.lit(fv.NUMERIC))
                .otherwise(F.lit(fv.GARBAGE)))
    return (typed.join(pairs, ["sensor_type", "raw_value"], "left")
            .withColumn("num_ok", measured(raw, m))
            .withColumn("cls", F.coalesce("_listed", fallback))
            .withColumn("trit", trits.of_class(F.col("cls")))
            .drop("_listed"))


def typed_class(raw: Column, sensor_type: Column) -> Column:
    """Class from type-aware rules instead of the contract table.

    Numbers are judged by per-type ranges; a few words mean different things on
    mechanisms (switch, fan, pump) than elsewhere.
    """
    number = to_number(raw)
    strict = F.when(raw.rlike(fv.NUMBER_PATTERN), raw.try_cast("double"))
    bad = F.lit(fv.GARBAGE)
    reading = F.lit(fv.NUMERIC)
    gas = F.when(strict.isin(fv.GAS_SATURATION) | (strict < 0), bad).otherwise(reading)
    temperature = F.when((strict == fv.BROKEN_WIRE) | (strict <= -40) | (strict >= 60), bad).otherwise(reading)
    untyped = F.when((strict < 0) | (strict >= 60), bad).otherwise(reading)
    numeric = (F.when(sensor_type == fv.GAS, gas)
               .when(sensor_type == fv.TEMPERATURE, temperature)
               .when(sensor_type == fv.UPS, reading)
               .when(sensor_type == fv.ORPHAN_TYPE_SHORT, untyped)
               .otherwise(bad))
    mechanism = sensor_type.isin(fv.MECHANISM_TYPES)
    driven = sensor_type.isin([fv.FAN, fv.PUMP])
    return (
        F.when(number.isNotNull(), numeric)
        .when(raw.rlike(fv.DATETIME_PATTERN), bad)
        .when(raw.isin(fv.TYPED_DISABLED) | ((raw == fv.OFF) & ~mechanism), F.lit(fv.DISABLED))
        .when(raw.isin(fv.TYPED_UNDEFINED), F.lit(fv.UNDEFINED))
        .when(raw.isin(fv.TYPED_FAULT) | ((raw == fv.DE_ENERGISED) & driven), F.lit(fv.FAULT))
        .when(raw.isin([*fv.TYPED_TRIGGER, fv.DE_ENERGISED])
              | ((raw == fv.ON) & mechanism), F.lit(fv.TRIGGER))
        .when(raw.isin([*fv.TYPED_NORM, fv.OFF, fv.ON]), F.lit(fv.NORM))
        .otherwise(F.lit(fv.UNCOVERED)))


def refine_normal(classified: DataFrame) -> DataFrame:
    """Split "normal" into restored link and return to normal.

    The class before it on the same channel decides; ``event_id`` breaks ties
    of the second-precise clock.
    """
    seen = with_neighbour(classified, ["channel_id"], "d", ["d", "t_sec", "event_id"], ["cls"])
    refined = (F.when(F.col("cls") != fv.NORM, F.col("cls"))
               .when(F.col("prev.cls") == fv.UNDEFINED, F.lit(fv.LINK_RESTORED))
               .otherwise(F.lit(fv.BACK_TO_NORMAL)))
    return seen.withColumn("refined_cls", refined).drop("prev")
