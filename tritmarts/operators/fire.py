"""Smoke events, heat events and fire candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text
from tritmarts.settings import Smoke

DETECTOR_FORMS = ("независимый дымовой датчик", "независимых дымовых датчика", "независимых дымовых датчиков")


def smoke_events(journal: DataFrame, dim: DataFrame, cfg: Smoke = Smoke()) -> DataFrame:
    """Smoke triggers with the maintenance-sweep flag of their controller day.

    Distinct detectors and pickets per controller day are counted from rows
    already folded to (controller, day, picket, detector).
    """
    smoke = dim.filter(F.col("sensor_type") == fv.SMOKE)
    place = smoke.select("channel_id", "object_id", "picket", "tag_base", "sensor_name")
    events = (journal.filter(F.col("raw_value") == fv.SMOKE_ON)
              .select("channel_id", "d", "t_sec").join(place, "channel_id"))
    detectors = events.select("tag_base", "d", "picket", "channel_id").distinct()
    points = detectors.groupBy("tag_base", "d", "picket").agg(F.count(F.lit(1)).alias("n"))
    fired = points.groupBy("tag_base", "d").agg(F.sum("n").alias("n_fired"), F.count("picket").alias("n_pickets"))
    size = smoke.groupBy("tag_base").agg(F.count(F.lit(1)).alias("n_smoke_total"))
    share = F.col("n_fired") / F.col("n_smoke_total")
    swept = (fired.join(size, "tag_base").withColumn("base_share", share)
             .withColumn("is_sweep", (F.col("base_share") >= cfg.sweep_share)
                         & (F.col("n_pickets") >= cfg.sweep_min_pickets)))
    return events.join(swept, ["tag_base", "d"])


def heat_events(journal: DataFrame, dim: DataFrame, cfg: Smoke = Smoke()) -> DataFrame:
    """Thermal trips and hot readings."""
    place = (dim.filter(F.col("sensor_type").isin(fv.THERMAL_TYPES))
             .select("channel_id", "object_id", "picket", "sensor_type", "sensor_name"))
    hot = (F.col("raw_value") == fv.HEAT_TRIP) | (F.col("num_value") >= cfg.heat_celsius)
    return (journal.filter(hot).select("channel_id", "d", "t_sec", "raw_value", "num_value")
            .join(place, "channel_id"))


def fire_candidates(smoke: DataFrame, heat: DataFrame, domains: DataFrame, cfg: Smoke = Smoke()) -> DataFrame:
    """Point-days with smoke and whether heat at the same point confirms it."""
    key = ["object_id", "picket", "d"]
    # folded per detector first: a noisy detector is one row
    detector = (smoke.filter(F.col("picket").isNotNull()).groupBy(*key, "channel_id")
                .agg(F.count(F.lit(1)).alias("n"), F.min("t_sec").alias("a"), F.max("t_sec").alias("b"),
                     F.bool_or("is_sweep").alias("sw"), F.max("base_share").alias("sh"),
                     F.min("sensor_name").alias("nm")))
    smoky = detector.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_smoke_ch"), F.sum("n").alias("n_smoke_ev"), F.min("a").alias("first_t"),
        F.max("b").alias("last_t"), F.bool_or("sw").alias("is_sweep"), F.max("sh").alias("base_share"),
        F.min("nm").alias("sample_name"))
    warm = (heat.filter(F.col("picket").isNotNull()).groupBy(*key)
            .agg(F.count(F.lit(1)).alias("n_heat_ev"), F.min("t_sec").alias("heat_t")))
    points = domains.select("object_id", "picket", "has_thermal", F.col("n_channels").alias("domain_size"))
    close = F.abs(F.col("heat_t") - F.col("first_t")) <= cfg.window_minutes * 60
    confirm = (F.when(~F.coalesce("has_thermal", F.lit(False)), F.lit(fv.UNKNOWN))
               .when(close, F.lit(fv.DEVIATION)).otherwise(F.lit(fv.NORMAL)))
    return (smoky.join(warm, key, "left").join(points, ["object_id", "picket"], "left")
            .select(*key, "n_smoke_ch", "n_smoke_ev", "first_t", "last_t", "is_sweep", "base_share", "sample_name",
                    F.coalesce("n_heat_ev", F.lit(0)).alias("n_heat_ev"), "has_thermal", "domain_size",
                    confirm.alias("confirm_trit")))


def fire_score() -> tuple[Column, Column]:
    """Trust in a candidate and the reasons, as (score, array of text)."""
    n, trit, ev = F.col("n_smoke_ch"), F.col("confirm_trit"), F.col("n_smoke_ev")
    sweep = F.col("is_sweep")
    local = F.when(n >= 3, 0.45).when(n == 2, 0.30).otherwise(0.10)
    backed = F.when(trit == fv.DEVIATION, 0.40).when(trit == fv.NORMAL, -0.15).otherwise(0.0)
    lasting = F.when(ev >= 10, 0.10).otherwise(0.0)
    score = F.when(sweep, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), local + backed + lasting)))
    many = F.concat(F.lit("в одной точке сработало "), text.counted(n, DETECTOR_FORMS))
    reasons = text.present(
        F.when(n >= 3, many).when(n == 2, F.lit("в одной точке сработали два независимых дымовых датчика"))
        .otherwise(F.lit("сработал один дымовой датчик")),
        F.when(trit == fv.DEVIATION, F.lit("подтверждено термическим датчиком в том же пикете"))
        .when(trit == fv.NORMAL, F.lit("термический датчик в этой точке сработку не подтвердил")),
        F.when(ev >= 10, F.concat(F.lit("сработок за сутки: "), ev.cast("string"), F.lit(" — устойчивое задымление"))))
    routine = F.array(F.concat(F.lit("сработало "), text.percent(F.col("base_share")), F.lit(
        " дымовых датчиков контроллера — это регламентная проверка, пожар так не выглядит")))
    return score, F.when(sweep, routine).otherwise(reasons)


def fire_blind_spots() -> Column:
    note = ("тепловых датчиков в этой точке нет — подтвердить задымление нечем; "
            "это не значит, что температура в норме")
    return text.present(F.when(F.col("confirm_trit") == fv.UNKNOWN, F.lit(note)))
