"""Queries over the contract, trits and day marts, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tritmarts.functions import trits
from tritmarts.functions.attach import with_row
from tritmarts.functions.numbers import measured, to_number
from tritmarts.operators import contract, domains, marts
from tritmarts.plans import samples
from tritmarts.plans.oracle_parts import part, with_parts
from tritmarts.plans.registry import query, tidy

FACT_COLS = """channel_id, d, n_ev, n_alarm, trit_day, n_norm, n_trigger, n_fault, n_disabled,
 n_undefined, n_garbage, n_numeric, round(num_avg + 1e-9, 6) AS num_avg, round(num_min + 1e-9, 6) AS num_min,
 round(num_max + 1e-9, 6) AS num_max, n_num_ok, t_first, t_last, t_first_fault, t_last_fault,
 t_first_trigger, t_first_undefined"""


@query("c1_classify", with_parts("""
SELECT event_id, channel_id, meaning_ AS cls, CAST(trit AS BIGINT) AS trit,
       round(num_ok + 1e-9, 6) AS num_ok FROM q_classed"""))
def c1(spark, sf):
    out = contract.classify(samples.journal(spark, sf), samples.channels(spark, sf), samples.contract(spark))
    return tidy(out.select("event_id", "channel_id", "cls", "trit", "num_ok"))


@query("c3_typed_contract", with_parts("""
SELECT sensor_type, raw_value, count(*) AS n,
  CASE WHEN TRY_CAST(replace(raw_value, ',', '.') AS DOUBLE) IS NOT NULL THEN
         CASE WHEN sensor_type <> 'Датчик температуры' THEN 'МУСОР'
              WHEN TRY_CAST(raw_value AS DOUBLE) <= -40 OR TRY_CAST(raw_value AS DOUBLE) >= 60 THEN 'МУСОР'
              ELSE 'ТЕЛЕМЕТРИЯ_ЧИСЛО' END
       WHEN regexp_full_match(raw_value, '\\d\\d\\.\\d\\d\\.\\d{4} \\d\\d:\\d\\d:\\d\\d') THEN 'МУСОР'
       WHEN raw_value IN ('Отключено устройство', 'Снято с охраны') THEN 'ОТКЛЮЧЕНО'
       WHEN raw_value = 'Неопределен' THEN 'НЕОПРЕДЕЛЕНО'
       WHEN raw_value = 'Неисправен' THEN 'ОТКАЗ'
       WHEN raw_value IN ('Обнаружен дым','Обнаружено движение','Не замкнут') THEN 'СРАБОТКА'
       WHEN raw_value = 'Включен' AND sensor_type = 'Состояние насоса' THEN 'СРАБОТКА'
       ELSE 'НОРМА' END AS cls
FROM q_journal JOIN q_channels USING (channel_id) GROUP BY ALL"""))
def c3(spark, sf):
    """Typed rules over the distinct (type, value) pairs of the journal."""
    pairs = (samples.journal(spark, sf).join(samples.channels(spark, sf), "channel_id")
             .groupBy("sensor_type", "raw_value").agg(F.count(F.lit(1)).alias("n")))
    return pairs.withColumn("cls", contract.typed_class(F.col("raw_value"), F.col("sensor_type")))


@query("c4_refine_normal", with_parts("""
SELECT event_id, channel_id,
       CASE WHEN meaning_ <> 'НОРМА' THEN meaning_
            WHEN lag(meaning_) OVER one = 'НЕОПРЕДЕЛЕНО' THEN 'НОРМА_СВЯЗЬ_ВОССТАНОВЛЕНА'
            ELSE 'НОРМА_ВОЗВРАТ' END AS refined_cls
FROM q_classed WINDOW one AS (PARTITION BY channel_id ORDER BY d, t_sec, event_id)"""))
def c4(spark, sf):
    rows = contract.classify(samples.journal(spark, sf), samples.channels(spark, sf), samples.contract(spark))
    return contract.refine_normal(rows).select("event_id", "channel_id", "refined_cls")


@query("c5_numeric_parse", with_parts("""
SELECT event_id, round(x + 1e-9, 6) AS number,
       round(CASE WHEN x >= -40 AND x <= 150 AND x <> -127 THEN x END + 1e-9, 6) AS num_ok
FROM (SELECT event_id, TRY_CAST(replace(raw_value, ',', '.') AS DOUBLE) AS x FROM q_journal)"""))
def c5(spark, sf):
    raw = F.col("raw_value")
    return tidy(samples.journal(spark, sf).select("event_id", to_number(raw).alias("number"),
                                                  measured(raw).alias("num_ok")))


@query("c6_class_trit", with_parts("""
SELECT meaning_ AS cls, CAST(trit AS BIGINT) AS trit, count(*) AS n FROM q_classed GROUP BY ALL"""))
def c6(spark, sf):
    rows = contract.classify(samples.journal(spark, sf), samples.channels(spark, sf), samples.contract(spark))
    out = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return tidy(out.withColumn("trit", trits.of_class(F.col("cls"))).select("cls", "trit", "n"))


part("q_halves", """
SELECT object_id, picket, d, channel_id, trit_day AS trit, sensor_name
FROM q_fact JOIN q_dim USING (channel_id) WHERE picket IS NOT NULL
""")
PAIR_SQL = """
SELECT object_id, picket, d, arg_min(trit, channel_id) AS a, arg_max(trit, channel_id) AS b,
       arg_min(sensor_name, channel_id) AS name_a, arg_max(sensor_name, channel_id) AS name_b
FROM q_halves GROUP BY object_id, picket, d HAVING count(*) > 1"""


def _pairs(spark, sf):
    """First and last channel of every point-day that has at least two."""
    rows = (samples.fact(spark, sf).join(samples.dim(spark, sf), "channel_id")
            .filter(F.col("picket").isNotNull()))
    return (rows.groupBy("object_id", "picket", "d")
            .agg(F.count(F.lit(1)).alias("n"), F.min_by("trit_day", "channel_id").alias("a"),
                 F.max_by("trit_day", "channel_id").alias("b"),
                 F.min_by("sensor_name", "channel_id").alias("name_a"),
                 F.max_by("sensor_name", "channel_id").alias("name_b"))
            .filter("n > 1").drop("n"))


@query("c7_trit_algebra", with_parts(f"""
SELECT object_id, picket, d, CASE WHEN a < b THEN a ELSE b END AS confirmed,
       CASE WHEN a > b THEN a ELSE b END AS escalated, 0 - a AS negated, a <> 0 AS known
FROM ({PAIR_SQL})"""))
def c7(spark, sf):
    a, b = F.col("a"), F.col("b")
    return tidy(_pairs(spark, sf).select(
        "object_id", "picket", "d", trits.confirm(a, b).alias("confirmed"),
        trits.escalate(a, b).alias("escalated"), trits.negate(a).alias("negated"),
        trits.is_known(a).alias("known")))


@query("c8_group_states", with_parts("""
SELECT object_id, picket, d, min(trit) AS trit_all, max(trit) AS trit_any,
       round(count(*) FILTER (WHERE trit <> 0) / count(*) + 1e-9, 6) AS observability
FROM q_halves GROUP BY object_id, picket, d"""))
def c8(spark, sf):
    rows = (samples.fact(spark, sf).join(samples.dim(spark, sf), "channel_id")
            .filter(F.col("picket").isNotNull()).withColumnRenamed("trit_day", "trit"))
    return tidy(trits.group_states(rows, ["object_id", "picket", "d"]))


@query("c9_zscore_trit", with_parts("""
SELECT channel_id, d, round(z + 1e-9, 6) AS z,
       CAST(CASE WHEN z IS NULL THEN 0 WHEN z >= 2 OR z <= -2 THEN 1 ELSE -1 END AS BIGINT) AS trit
FROM (SELECT f.channel_id, f.d, (f.n_ev - m) / nullif(s, 0) AS z
      FROM q_fact_long f JOIN (SELECT channel_id, avg(n_ev) AS m, stddev_samp(n_ev) AS s
                               FROM q_fact_long GROUP BY channel_id) USING (channel_id))"""))
def c9(spark, sf):
    fact = samples.fact_long(spark, sf).select("channel_id", "d", "n_ev")
    norm = fact.groupBy("channel_id").agg(F.avg("n_ev").alias("m"), F.stddev_samp("n_ev").alias("s"))
    z = (F.col("n_ev") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    return tidy(fact.join(norm, "channel_id").select("channel_id", "d", z.alias("z"),
                                                     trits.of_zscore(z).alias("trit")))


@query("c10_staleness_trit", with_parts("""
SELECT channel_id, CAST(datediff('day', last_d, e) * 24 AS DOUBLE) AS age_h,
       round(24.0 * gap + 1e-9, 6) AS interval_h,
       CAST(CASE WHEN datediff('day', last_d, e) > gap * 2 THEN 1 ELSE -1 END AS BIGINT) AS trit
FROM (SELECT channel_id, max(d) AS last_d, (datediff('day', min(d), max(d)) + 1.0) / count(*) AS gap
      FROM q_fact GROUP BY channel_id), (SELECT max(d) AS e FROM q_fact)"""))
def c10(spark, sf):
    fact = samples.fact(spark, sf)
    prof = with_row(marts.channel_profile(fact), fact.agg(F.max("d").alias("end_day")))
    age = (F.datediff("end_day", "last_day") * 24).cast("double")
    step = F.col("mean_gap_days") * 24.0
    return tidy(prof.select("channel_id", age.alias("age_h"), step.alias("interval_h"),
                            trits.of_staleness(age, step, factor=2.0).alias("trit")))


@query("c11_confirmation_sentence", with_parts(f"""
SELECT object_id, picket, d,
  CASE WHEN a = 1 AND b = 1 THEN 'подтверждено: ' || name_a || ' и ' || name_b || ' одновременно показывают отклонение'
       WHEN a >= 0 AND b = 0 THEN 'подтвердить нечем: ' || name_a || ' показывает отклонение, но ' || name_b
            || ' недоступен — это не значит, что всё в порядке'
       WHEN a = 0 AND b = 1 THEN 'подтвердить нечем: ' || name_b || ' показывает отклонение, но ' || name_a
            || ' недоступен — это не значит, что всё в порядке'
       WHEN a = 1 AND b = -1 THEN 'не подтверждено: ' || name_a || ' сработал, но ' || name_b
            || ' в норме — вероятно, одиночный шум'
       WHEN a = -1 AND b = 1 THEN 'не подтверждено: ' || name_b || ' сработал, но ' || name_a
            || ' в норме — вероятно, одиночный шум'
       ELSE 'норма: ' || name_a || ' и ' || name_b || ' в пределах нормы' END AS sentence
FROM ({PAIR_SQL})"""))
def c11(spark, sf):
    return _pairs(spark, sf).select(
        "object_id", "picket", "d", trits.confirmation_sentence(
            F.col("name_a"), F.col("a"), F.col("name_b"), F.col("b")).alias("sentence")
    ).withColumn("picket", F.col("picket").cast("bigint"))


DIM_COLS = """channel_id, system, sensor_type, sensor_name, tag, object_id, tag_base, picket, object_name,
 object_kind, parent_id, parent_name, is_zone_aggregate, is_power_type"""


@query("e1_dim_channel", with_parts(f"SELECT {DIM_COLS} FROM q_dim"))
def e1(spark, sf):
    return tidy(marts.channel_dimension(samples.channels(spark, sf), samples.objects(spark, sf)))


@query("e2_twin_groups", with_parts("SELECT channel_id, twin_count, twin_group FROM q_dim"))
def e2(spark, sf):
    plain = marts.channel_dimension(samples.channels(spark, sf), samples.objects(spark, sf))
    return tidy(marts.with_twins(plain).select("channel_id", "twin_count", "twin_group"))


@query("e3_fact_channel_day", with_parts(f"SELECT {FACT_COLS} FROM q_fact"))
def e3(spark, sf):
    return tidy(marts.fact_channel_day(samples.journal(spark, sf), samples.channels(spark, sf),
                                       samples.contract(spark)))


@query("e3_fact_channel_day_long", with_parts(f"SELECT {FACT_COLS} FROM q_fact_long"))
def e3_long(spark, sf):
    return tidy(marts.fact_channel_day(samples.journal_long(spark, sf), samples.channels_long(spark, sf),
                                       samples.contract(spark)))


@query("e4_fact_object_day", with_parts("""
SELECT object_id, parent_id, d, count(DISTINCT channel_id) AS n_channels_active,
       CAST(sum(n_ev) AS BIGINT) AS n_ev, CAST(sum(n_alarm) AS BIGINT) AS n_alarm,
       CAST(sum(n_fault + n_disabled) AS BIGINT) AS n_failure_ev,
       count(DISTINCT CASE WHEN trit_day = 1 THEN channel_id END) AS n_ch_deviation,
       count(DISTINCT CASE WHEN trit_day = 0 THEN channel_id END) AS n_ch_unknown,
       count(DISTINCT CASE WHEN trit_day = -1 THEN channel_id END) AS n_ch_normal,
       max(trit_day) AS trit_day
FROM q_fact JOIN q_dim USING (channel_id) GROUP BY object_id, parent_id, d"""))
def e4(spark, sf):
    return tidy(marts.fact_object_day(samples.fact(spark, sf), samples.dim(spark, sf)))


part("q_profile_long", """
SELECT *, datediff('day', first_day, last_day) + 1 AS lifespan_days FROM (
  SELECT channel_id, min(d) AS first_day, max(d) AS last_day, count(*) AS active_days,
         CAST(sum(n_ev) AS BIGINT) AS total_ev, median(n_ev) AS med, quantile_cont(n_ev, 0.95) AS p95
  FROM q_fact_long GROUP BY channel_id)
""")


@query("e5_channel_profile", with_parts("""
SELECT channel_id, first_day, last_day, active_days, total_ev, med AS median_ev_per_active_day,
       round(p95 + 1e-9, 6) AS p95_ev_per_active_day, lifespan_days,
       round(active_days / lifespan_days + 1e-9, 6) AS active_share,
       round(lifespan_days / active_days + 1e-9, 6) AS mean_gap_days
FROM q_profile_long"""))
def e5(spark, sf):
    return tidy(marts.channel_profile(samples.fact_long(spark, sf)))


part("q_sync", """
SELECT twin_group, min(sensor_name) AS sensor_name, min(sensor_type) AS sensor_type,
       count(DISTINCT (ca, cb)) AS n_pairs, count(*) AS shared_days, avg(CASE WHEN ta = tb THEN 1.0 ELSE 0 END) AS sync_rate
FROM (SELECT l.twin_group, l.sensor_name, l.sensor_type, l.channel_id AS ca, r.channel_id AS cb,
             l.trit_day AS ta, r.trit_day AS tb
      FROM (SELECT * FROM q_fact_long JOIN q_dim_long USING (channel_id)) l
      JOIN (SELECT * FROM q_fact_long JOIN q_dim_long USING (channel_id)) r
        ON l.twin_group = r.twin_group AND l.d = r.d AND l.channel_id < r.channel_id)
GROUP BY twin_group
""")


@query("e6_twin_synchrony", with_parts("""
SELECT twin_group, sensor_name, sensor_type, n_pairs, shared_days,
       round(sync_rate + 1e-9, 6) AS sync_rate FROM q_sync"""))
def e6(spark, sf):
    return tidy(domains.twin_synchrony(samples.dim_long(spark, sf), samples.fact_long(spark, sf)))


@query("e7_synchrony_buckets", with_parts("""
SELECT bucket, count(*) AS groups, CAST(sum(n_pairs) AS BIGINT) AS pairs,
       round(median(sync_rate) + 1e-9, 6) AS median_sync
FROM (SELECT *, CASE WHEN sync_rate < 0.4 THEN 'независимы (<40%) — разные приборы'
                     WHEN sync_rate < 0.7 THEN 'слабо связаны (40-70%)'
                     WHEN sync_rate < 0.95 THEN 'скорее синхронны (70-95%)'
                     ELSE 'синхронны (>=95%) — пороги одного прибора' END AS bucket FROM q_sync)
GROUP BY bucket"""))
def e7(spark, sf):
    return tidy(domains.synchrony_buckets(
        domains.twin_synchrony(samples.dim_long(spark, sf), samples.fact_long(spark, sf))))


part("q_domain", """
SELECT object_id, picket, count(*) AS n_channels, count(DISTINCT sensor_type) AS n_sensor_types,
       count(DISTINCT system) AS n_systems,
       string_agg(DISTINCT sensor_type, '|' ORDER BY sensor_type) AS sensor_types,
       min(object_name) AS object_name, min(parent_name) AS parent_name,
       count(*) FILTER (WHERE sensor_type IN ('Тепловой датчик','Датчик температуры')) > 0 AS has_thermal,
       count(*) FILTER (WHERE sensor_type = 'Датчик дыма') > 0 AS has_smoke,
       count(*) FILTER (WHERE sensor_type = 'Состояние насоса') > 0 AS has_pump,
       count(*) FILTER (WHERE sensor_type IN ('Датчик движения','КД Дверь','КД Люк')) > 0 AS has_intrusion
FROM q_dim WHERE picket IS NOT NULL AND NOT is_zone_aggregate GROUP BY object_id, picket
""")


@query("e8_logical_domain", with_parts("SELECT * FROM q_domain"))
def e8(spark, sf):
    return tidy(domains.logical_domains(samples.dim(spark, sf)))


@query("e8_domain_channel_pages", with_parts("""
SELECT object_id, picket, channel_id // 500 AS page,
       string_agg(CAST(channel_id AS VARCHAR), '|' ORDER BY channel_id) AS channel_ids
FROM q_dim WHERE picket IS NOT NULL AND NOT is_zone_aggregate GROUP BY ALL"""))
def e8_pages(spark, sf):
    return tidy(domains.domain_channels(samples.dim(spark, sf)))


@query("e9_domain_size_buckets", with_parts("""
SELECT CASE WHEN n_channels < 2 THEN '1 канал — подтверждать нечем' WHEN n_channels < 4 THEN '2-3 канала'
            WHEN n_channels < 11 THEN '4-10 каналов' ELSE 'более 10' END AS bucket,
       count(*) AS domains, CAST(sum(n_channels) AS BIGINT) AS channels
FROM q_domain GROUP BY 1"""))
def e9(spark, sf):
    return tidy(domains.domain_size_buckets(domains.logical_domains(samples.dim(spark, sf))))


@query("e9_smoke_thermal_crosstab", with_parts("""
SELECT has_smoke, has_thermal, count(*) AS domains, CAST(sum(n_channels) AS BIGINT) AS channels
FROM q_domain WHERE has_smoke GROUP BY 1, 2"""))
def e9_cross(spark, sf):
    return tidy(domains.smoke_thermal_crosstab(domains.logical_domains(samples.dim(spark, sf))))
