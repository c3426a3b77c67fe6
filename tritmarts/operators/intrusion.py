"""Guard intervals, guard health and intrusion episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text
from tritmarts.functions.numbers import epoch_second
from tritmarts.functions.ordering import running_totals, with_neighbour
from tritmarts.settings import Guarding

def armed_intervals(journal: DataFrame, dim: DataFrame) -> DataFrame:
    """Half-open intervals of guard mode; the open last one is dropped.

    Bounds are epoch seconds.
    """
    place = dim.filter(F.col("sensor_type") == fv.GUARD).select("channel_id", "object_id")
    rows = (journal.filter(F.col("raw_value").isin(fv.ARMED, fv.DISARMED))
            .select("channel_id", "d", "t_sec", "event_id", "raw_value",
                    epoch_second(F.col("d"), F.col("t_sec")).alias("t_from"))
            .join(place, "channel_id"))
    seq = with_neighbour(rows, ["channel_id"], "d", ["d", "t_sec", "event_id"], ["t_from"], "next", forward=True)
    return (seq.filter(F.col("next").isNotNull())
            .select("object_id", "channel_id", "t_from", F.col("next.t_from").alias("t_to"),
                    (F.col("raw_value") == fv.ARMED).alias("is_armed")))


def guard_health(intervals: DataFrame, cfg: Guarding = Guarding()) -> DataFrame:
    """A guard channel that hardly ever switches or is always armed is stuck."""
    length = F.col("t_to") - F.col("t_from")
    agg = intervals.groupBy("object_id", "channel_id").agg(
        F.count(F.lit(1)).alias("n_switches"),
        F.sum(F.when(F.col("is_armed"), length).otherwise(0)).alias("armed_sec"),
        F.sum(length).alias("total_sec"))
    share = F.col("armed_sec") / F.nullif("total_sec", F.lit(0))
    return (agg.withColumn("armed_share", share)
            .withColumn("is_stuck", (F.col("armed_share") >= cfg.stuck_share)
                        | (F.col("n_switches") < cfg.stuck_min_switches)))


_STATES = ["covering", "armed", "stuck"]


def _guard_states(triggers: DataFrame, intervals: DataFrame, health: DataFrame) -> DataFrame:
    """(object_id, ts, covering, armed, stuck): guard intervals that cover each trigger second, all, sound and armed, and stuck."""
    known = (intervals.filter((F.col("t_to") > F.col("t_from")) & F.col("object_id").isNotNull())
             .join(health.select("channel_id", "is_stuck"), "channel_id", "left")
             .withColumn("is_stuck", F.coalesce("is_stuck", F.lit(False))))
    bounds = F.explode(F.array(F.struct(F.col("t_from").alias("ts"), F.lit(1).alias("sign")),
                               F.struct(F.col("t_to").alias("ts"), F.lit(-1).alias("sign")))).alias("b")
    sign = F.col("b.sign")
    marks = known.select("object_id", bounds, "is_armed", "is_stuck").select(
        "object_id", "b.ts", sign.alias("covering"), F.when(F.col("is_armed") & ~F.col("is_stuck"), sign).otherwise(0).alias("armed"),
        F.when(F.col("is_stuck"), sign).otherwise(0).alias("stuck"), F.lit(False).alias("asked"))
    none = [F.lit(0).alias(s) for s in _STATES]
    asked = triggers.filter("object_id IS NOT NULL").select("object_id", "ts", *none, F.lit(True).alias("asked"))
    steps = marks.unionByName(asked).groupBy("object_id", "ts").agg(
        *[F.sum(s).alias(s) for s in _STATES], F.bool_or("asked").alias("asked"))
    swept = running_totals(steps, [F.col("ts")], _STATES, key=["object_id"])
    return swept.filter("asked").select("object_id", "ts", *[F.col(f"{s}_cum").alias(s) for s in _STATES])


def intrusion_events(journal: DataFrame, dim: DataFrame, intervals: DataFrame, health: DataFrame,
                     cfg: Guarding = Guarding(), per_guard: bool = True) -> DataFrame:
    """Point-day episodes of perimeter triggers with the guard mode as a trit.

    What a trigger needs of the guard intervals is how many cover its second, and of
    which kind.  Interval bounds and trigger seconds are merged in one order per
    object and swept with running totals, so neither triggers nor intervals are paired
    and an interval of years is two rows.  With several guard channels on an object a trigger
    counts once per channel that covers it; ``per_guard=False`` counts it once.
    """
    place = (dim.filter(F.col("sensor_type").isin(fv.INTRUSION_TYPES) & F.col("picket").isNotNull())
             .select("channel_id", "object_id", "object_name", "parent_name", "picket", "sensor_type", "sensor_name"))
    triggers = (journal.filter(F.col("raw_value").isin(fv.INTRUSION_VALUES))
                .select("channel_id", "d", "t_sec").join(place, "channel_id")
                # one row per channel and second
                .groupBy("channel_id", "d", "t_sec", "object_id", "object_name", "parent_name", "picket",
                         "sensor_type", "sensor_name")
                .agg(F.count(F.lit(1)).alias("n"))
                .withColumn("ts", epoch_second(F.col("d"), F.col("t_sec"))))
    key = ["object_id", "object_name", "parent_name", "picket", "d"]
    channel = [*key, "channel_id", "sensor_type", "sensor_name"]
    modes = triggers.join(_guard_states(triggers, intervals, health), ["object_id", "ts"], "left").na.fill(0, _STATES)
    trit = (F.when(F.col("armed") > 0, F.lit(fv.DEVIATION)).when((F.col("stuck") > 0) | (F.col("covering") == 0), F.lit(fv.UNKNOWN))
            .otherwise(F.lit(fv.NORMAL)))
    times = F.greatest(F.col("covering"), F.lit(1)) if per_guard else F.lit(1)
    modes = modes.select(*channel, "t_sec", (F.col("n") * times).alias("n"), trit.alias("_trit"), (F.col("stuck") > 0).alias("_stuck"))
    # channels first, then points: distinct counts become plain counts
    per_channel = modes.groupBy(*channel).agg(
        F.min("t_sec").alias("a"), F.max("t_sec").alias("b"), F.sum("n").alias("n"),
        F.max("_trit").alias("trit"), F.bool_or("_stuck").alias("stuck"))
    points = per_channel.groupBy(*key).agg(
        F.min("a").alias("first_t"), F.max("b").alias("last_t"), F.sum("n").alias("n_triggers"),
        F.count(F.lit(1)).alias("n_channels"), F.sort_array(F.collect_set("sensor_type")).alias("types"),
        F.min("sensor_name").alias("sample_name"), F.max("trit").alias("armed_trit"),
        F.bool_or("stuck").alias("guard_unreliable"))
    hour = F.floor(F.col("first_t") / 3600).cast("int")
    return (points.withColumn("n_types", F.size("types")).withColumn("min_hour", hour)
            .withColumn("is_night", F.col("min_hour").between(cfg.night_from, cfg.night_to)))


def episode_hours(first: Column, last: Column) -> Column:
    return (last - first) / 3600.0


def intrusion_score(cfg: Guarding = Guarding()) -> tuple[Column, Column]:
    """Trust in an episode and the reasons, as (score, array of text)."""
    types, trit, n = F.col("n_types"), F.col("armed_trit"), F.col("n_triggers")
    hours = episode_hours(F.col("first_t"), F.col("last_t"))
    too_long, too_many = hours > cfg.max_hours, n > cfg.max_triggers
    variety = F.when(types >= 3, 0.45).when(types == 2, 0.30).otherwise(0.08)
    mode = F.when(trit == fv.DEVIATION, 0.35).when(trit == fv.NORMAL, -0.25).otherwise(0.0)
    night = F.when(F.col("is_night"), 0.20).otherwise(0.0)
    repeated = F.when(n >= 5, 0.10).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), variety + mode + night + repeated))
    score = F.when(too_long | too_many, F.lit(0.0)).otherwise(total)

    def said(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    reasons = text.present(
        F.when(types >= 3, said("сработали датчики ", types.cast("string"),
                                " разных типов — последовательность похожа на перемещение человека"))
        .when(types == 2, F.lit("сработали датчики двух разных типов подряд"))
        .otherwise(said("сработал один тип датчика (", F.get("types", F.lit(0)), ")")),
        F.when(trit == fv.DEVIATION, F.lit("объект в этот момент был под охраной"))
        .when(trit == fv.NORMAL, F.lit("объект был снят с охраны — вероятно, работа подрядчиков")),
        F.when(F.col("is_night"), said("время срабатывания — ", F.lpad(F.col("min_hour").cast("string"), 2, "0"),
                                       " ч, присутствие людей в это время не регламентно")),
        F.when(n >= 5, said("срабатываний за эпизод: ", n.cast("string"))))
    long_note = F.array(said(
        "эпизод длился ", text.tenth(hours), " ч — для присутствия человека это неправдоподобно долго. "
        "Картина соответствует работе подрядчиков при не снятой охране либо залипшему датчику, а не проникновению"))
    many_note = F.array(said(
        "срабатываний за эпизод: ", n.cast("string"), ". Для перемещения человека это неправдоподобно много — "
        "картина соответствует дребезгу шлейфа, а не проникновению; эпизод отнесён к отказам оборудования"))
    return score, F.when(too_long, long_note).when(too_many, many_note).otherwise(reasons)


def intrusion_blind_spots() -> Column:
    unknown = F.col("armed_trit") == fv.UNKNOWN
    return text.present(
        F.when(unknown & F.col("guard_unreliable"), F.lit(
            "канал состояния охраны на объекте недостоверен (держит режим почти постоянно) — "
            "решение принято по времени суток и кратности, а не по режиму"))
        .when(unknown, F.lit("канала состояния охраны на объекте нет — неизвестно, был ли он под охраной")))
