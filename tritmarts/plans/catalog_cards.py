"""Queries over verdict cards, orders, geometry, reports, calibration and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.attach import with_row
from tritmarts.functions.numbers import clock
from tritmarts.functions.written import written
from tritmarts.operators import (
    calibration, cards, cascades, contract, controls, explain, geometry, orders, reports, verdicts)
from tritmarts.plans import catalog_marts, samples  # noqa: F401  catalog_marts holds shared oracle parts
from tritmarts.plans.catalog_ranking import FIT, World, _fitted, _scored_test, _test_rows, fixed_score
from tritmarts.plans.catalog_scenarios import CLOCK, ORDER_DAYS, Heat, Network, flat_evidence, forms
from tritmarts.plans.oracle_parts import part, with_parts
from tritmarts.plans.registry import query, tidy
from tritmarts.plans.store import stored
from tritmarts.session import shared_dir
from tritmarts.sources import readers, sinks
from tritmarts.sources.literal import inline_table

SCENARIOS = [fv.FAILURE, fv.FLOODING, fv.FIRE, fv.INTRUSION]
KINDS = [fv.SMOKE, fv.HEAT, fv.GAS, fv.DOOR, "Прочее"]


def sample_cards(spark, sf):
    """One verdict card per order, written once."""
    return stored(spark, sf, "cards", lambda: build_cards(spark, sf))


def build_cards(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    obj = cust % 16
    day = F.date_add(F.lit("2024-01-01").cast("date"),
                     F.pmod(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")), F.lit(1000)))
    name = (F.when(obj == 0, F.lit(None)).when(obj % 3 == 0, F.concat(F.lit("объект Гамма"), obj.cast("string")))
            .when(obj % 3 == 1, F.concat(F.lit("ПС объект Ро"), obj.cast("string")))
            .otherwise(F.concat(F.lit("Коллектор "), obj.cast("string"))))

    def pick(values, n):
        return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)

    rows = samples.table(spark, sf, "orders").select(
        key.alias("id"), pick(SCENARIOS, key).alias("scenario"), day.alias("d"), obj.alias("object_id"),
        name.alias("object_name"), F.when(key % 11 != 0, key % 50).cast("int").alias("picket"),
        F.when(key % 4 < 2, cust).alias("channel_id"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("probability"), F.lit(24).alias("horizon_hours"),
        F.when(F.col("o_orderstatus") == "O", fv.STATUS_NEW).when(F.col("o_orderstatus") == "P", fv.STATUS_IN_WORK)
        .otherwise(fv.STATUS_CLOSED).alias("status"), day.cast("string").alias("created_at"),
        pick(KINDS, key).alias("sensor_type"), F.concat(F.lit("Н"), (key % 9).cast("string")).alias("sensor_name"),
        F.array(
            verdicts.sign("fault_ev_7d", "отказы", key % 7, F.lit(0.1234),
                          F.concat(F.lit("сообщений о неисправности за 7 суток: "), (key % 7).cast("string")),
                          F.date_sub(day, (key % 70).cast("int")).cast("string")),
            verdicts.sign("days_since_fault", "отказы", F.lit(0.0), F.lit(0.05), F.lit(fv.FAULT_TODAY),
                          F.concat(F.lit("2024-01-01T"), clock((cust * 13 + key % 97) % 20000)))).alias("evidence"),
        F.when(key % 3 == 0, F.array(F.lit("слепая зона"))).otherwise(F.array().cast("array<string>")).alias("blind_spots"),
        F.lit("Осмотреть").alias("recommendation"), F.when(key % 5 == 0, F.lit("Похожий случай")).alias("precedent"),
        F.when(key % 13 != 0, key % 70).cast("int").alias("incubation_days"), (key % 37 == 0).alias("cascade"),
        F.col("o_orderpriority").alias("urgency"))
    rows = rows.withColumn("title", cards.title()).withColumn("timeline", cards.timeline(
        F.col("evidence"), created=F.col("created_at")))
    return rows.withColumn("first_sign_at", F.array_min(F.transform("evidence", lambda e: e["since"])))


def users(spark, sf):
    n = samples.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("user_id"), F.col("n_name").alias("full_name"),
                    (F.col("n_nationkey") % 4 == 0).alias("is_global"))


def assignments(spark, sf):
    n = samples.table(spark, sf, "nation").filter("n_nationkey % 3 <> 0")
    key = F.col("n_nationkey").cast("bigint")
    return n.select(key.alias("user_id"), F.explode(F.array(key % 16, (key + 5) % 16)).alias("object_id"))


def reasons(spark):
    return inline_table(spark, [(1, "Ложное срабатывание"), (2, "Профилактика"), (3, "Подтверждён отказ"),
                                (4, "Плановая проверка"), (5, "Другое")], ["reason_id", "title"])


def decisions(spark, sf):
    o = samples.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("verdict_id"),
                    F.when(F.col("o_orderkey") % 2 == 0, "снят").otherwise("подтверждён").alias("action"),
                    F.substring("o_orderpriority", 1, 1).cast("int").alias("reason_id"),
                    (F.col("o_custkey") % 25).alias("user_id"), F.to_date("o_orderdate").alias("decided_at"))


part("q_cards", f"""
SELECT o_orderkey AS id, ['отказ','подтопление','пожар','проникновение'][o_orderkey % 4 + 1] AS scenario, s.d, s.wait,
  o_custkey % 16 AS object_id,
  CASE WHEN o_custkey % 16 = 0 THEN NULL WHEN o_custkey % 16 % 3 = 0 THEN 'объект Гамма' || (o_custkey % 16)
       WHEN o_custkey % 16 % 3 = 1 THEN 'ПС объект Ро' || (o_custkey % 16) ELSE 'Коллектор ' || (o_custkey % 16) END AS object_name,
  CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 50 END AS picket, CASE WHEN o_orderkey % 4 < 2 THEN o_custkey END AS channel_id,
  least(1.0, o_totalprice / 500000.0) AS probability,
  CASE o_orderstatus WHEN 'O' THEN 'новый' WHEN 'P' THEN 'в работе' ELSE 'закрыт' END AS status, CAST(s.d AS VARCHAR) AS created_at,
  ['Датчик дыма','Тепловой датчик','Газовый датчик','КД Дверь','Прочее'][o_orderkey % 5 + 1] AS sensor_type,
  'Н' || (o_orderkey % 9) AS sensor_name, CAST(s.d - CAST(o_orderkey % 70 AS INT) AS VARCHAR) AS since1,
  'сообщений о неисправности за 7 суток: ' || (o_orderkey % 7) AS phrase1,
  '2024-01-01T' || {CLOCK.format('((o_custkey * 13 + o_orderkey % 97) % 20000)')} AS since2,
  'неисправность зафиксирована сегодня' AS phrase2, o_orderkey % 3 = 0 AS blind,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Похожий случай' END AS precedent,
  CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 70 END AS incubation_days, o_orderkey % 37 = 0 AS cascade, o_orderpriority AS urgency
FROM orders JOIN ({ORDER_DAYS}) s ON s.id = o_orderkey
""")
TITLE = """trim(
  CASE scenario WHEN 'отказ' THEN 'Прогноз отказа ' || CASE sensor_type WHEN 'Датчик дыма' THEN 'дымового датчика' WHEN 'Тепловой датчик' THEN 'теплового датчика'
         WHEN 'Газовый датчик' THEN 'газового датчика' WHEN 'КД Дверь' THEN 'дверного контакта' ELSE 'датчика' END || ' ' || sensor_name
       WHEN 'подтопление' THEN 'Аномальный режим откачки ' || sensor_name WHEN 'пожар' THEN 'Возможное задымление' ELSE 'Возможное проникновение' END
  || ' ' || concat_ws(', ', CASE WHEN object_name LIKE 'объект %' THEN 'на объекте ' || substr(object_name, 8)
       WHEN object_name LIKE 'ПС объект %' THEN 'на объекте ' || substr(object_name, 11) || ' (ПС)' ELSE 'на объекте ' || object_name END, 'ПК' || picket))"""
part("q_titled", f"SELECT *, {TITLE} AS title, coalesce(object_name, 'без привязки к объекту') AS place FROM q_cards")
part("q_signs", """
SELECT place AS object_name, picket, sensor_name, probability, coalesce(channel_id, 0) AS ch, since1 AS ts, 'признак' AS kind, phrase1 AS text FROM q_titled
UNION ALL SELECT place, picket, sensor_name, probability, coalesce(channel_id, 0), since2, 'признак', phrase2 FROM q_titled
UNION ALL SELECT place, picket, sensor_name, probability, coalesce(channel_id, 0), created_at, 'вердикт', 'сформирован вердикт' FROM q_titled
""")


# ---- failure verdicts over a fixed score ----------------------------------------

part("q_head", """
SELECT h.*, dm.sensor_name, dm.sensor_type, dm.system, dm.picket, dm.object_id, dm.object_name, dm.parent_name,
       coalesce(g.n_channels, 1) AS dom_size, coalesce(g.has_thermal, false) AS dom_thermal
FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, channel_id) AS r
      FROM (SELECT f.*, (f.channel_id * 7919 + datediff('day', DATE '1995-01-01', f.d) * 104729) % 1009 / 1009.0 AS score FROM q_features f)) h
JOIN q_dim_long dm USING (channel_id) LEFT JOIN q_domain_long g ON g.object_id = dm.object_id AND g.picket = dm.picket
WHERE r <= 100
""")


def _head(spark, sf):
    w = World(spark, sf)
    return verdicts.score_days(w.matrix.withColumn("score", fixed_score()), w.dim, w.domains)


part("q_rows", """
SELECT f.*, dm.sensor_name, dm.sensor_type, dm.system, dm.picket, dm.object_id, dm.object_name, dm.parent_name,
       coalesce(g.n_channels, 1) AS dom_size, coalesce(g.has_thermal, false) AS dom_thermal, sm.d IS NOT NULL AS smoky
FROM q_features f JOIN q_dim_long dm USING (channel_id)
LEFT JOIN q_domain_long g ON g.object_id = dm.object_id AND g.picket = dm.picket
LEFT JOIN q_smoke_days sm ON sm.object_id = dm.object_id AND sm.d = f.d
""")
part("q_smoke_days", """
SELECT DISTINCT s_nationkey % 5 AS object_id, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE l_linenumber = 7 AND l_returnflag = 'A'
""")


def _rows(spark, sf):
    """Every grid row with its passport and smoke, not only the head of each day."""
    w = World(spark, sf)
    return verdicts.with_smoke(verdicts.with_passport(w.matrix, w.dim, w.domains), samples.smoke_long(spark, sf))


def _points(spark, sf):
    """Every point-day of the label grid's channels, as asked places."""
    return _rows(spark, sf).select("object_id", "picket", "d")


@query("v1_score_days", with_parts("""
SELECT channel_id, d, round(score + 1e-9, 6) AS score, sensor_name, object_id, picket, dom_size, dom_thermal FROM q_head"""))
def v1(spark, sf):
    return tidy(_head(spark, sf).select("channel_id", "d", "score", "sensor_name", "object_id", "picket", "dom_size", "dom_thermal"))


@query("v2_location", with_parts("""
SELECT channel_id, CASE WHEN picket IS NULL AND object_name IS NULL AND parent_name IS NULL THEN 'канал ' || channel_id
       ELSE concat_ws(', ', coalesce(parent_name, object_name), 'ПК' || picket) END AS location FROM q_dim"""))
def v2(spark, sf):
    return samples.dim(spark, sf).select("channel_id", verdicts.location(
        F.col("parent_name"), F.col("object_name"), F.col("picket"), F.col("channel_id")).alias("location"))


part("q_v3", """
SELECT channel_id, d, concat_ws('|', CASE WHEN system LIKE '%Пожарная%' AND NOT smoky THEN 'пожар: сработок дыма за сутки не зафиксировано' END,
       CASE WHEN domain_dev_share_7d < 0.2 THEN 'массовая авария: соседние каналы точки в норме' END) AS negatives FROM q_rows
""")


@query("v3_negatives", with_parts("SELECT * FROM q_v3"))
def v3(spark, sf):
    return tidy(_rows(spark, sf).select("channel_id", "d", verdicts.failure_negatives(F.col("_smoke")).alias("negatives")))


part("q_v4", """
SELECT channel_id, d, concat_ws('|',
  CASE WHEN dom_size = 1 THEN 'в этой точке только один канал — подтвердить показания нечем'
       WHEN domain_silent_share >= 0.5 THEN 'молчит ' || CAST(round_even(domain_silent_share * 100, 0) AS BIGINT) || '% соседних каналов точки — картина неполная' END,
  CASE WHEN system LIKE '%Пожарная%' AND NOT dom_thermal THEN 'тепловых датчиков в этой точке нет, подтвердить температурой нельзя' END) AS blind_spots
FROM q_rows
""")


@query("v4_blind_spots", with_parts("SELECT * FROM q_v4"))
def v4(spark, sf):
    return tidy(_rows(spark, sf).select("channel_id", "d", verdicts.failure_blind_spots().alias("blind_spots")))


part("q_v5", """
SELECT p.object_id, p.picket, p.d,
  coalesce(array_to_string(list_transform(t.said, lambda w: w || CASE WHEN t.picket = p.picket THEN '' ELSE ' (датчик в ' || abs(t.picket - p.picket) * 10 || ' м)' END), '|'), '') AS evidence,
  CASE WHEN t.picket IS NOT NULL THEN CASE WHEN len(t.said) > 0 THEN t.blind ELSE '' END
       WHEN p.object_id IN (SELECT object_id FROM q_temp) THEN 'ближайший температурный датчик дальше 100 м — тепловой режим этой точки не контролируется'
       ELSE 'температурных датчиков на объекте нет — тепловой режим не контролируется' END AS blind_spots
FROM (SELECT DISTINCT object_id, picket, d FROM q_rows) p
LEFT JOIN (SELECT a.object_id, a.picket AS at, a.d, b.*EXCLUDE (object_id, d),
                  row_number() OVER (PARTITION BY a.object_id, a.picket, a.d ORDER BY abs(a.picket - b.picket), b.picket) AS rn
           FROM (SELECT DISTINCT object_id, picket, d FROM q_rows) a
           JOIN q_thermal_text b ON b.object_id = a.object_id AND b.d = a.d AND abs(a.picket - b.picket) <= 10) t
  ON t.object_id = p.object_id AND t.at = p.picket AND t.d = p.d AND t.rn = 1
""")


@query("v5_temperature_evidence", with_parts("SELECT * FROM q_v5"))
def v5(spark, sf):
    out = verdicts.temperature_evidence(_points(spark, sf), Heat(spark, sf).state)
    return tidy(out.select("object_id", "picket", "d", F.transform("temp_evidence", lambda e: e["phrase"]).alias("evidence"),
                           F.col("temp_blind").alias("blind_spots")))


part("q_v6", f"""
SELECT object_id, picket, d, 'Похожий случай: ' || strftime(hit.day, '%d.%m.%Y') || ', та же точка, ' || hit.n || ' '
       || {forms('hit.n', 'сообщение', 'сообщения', 'сообщений')} || ' о неисправности.' AS precedent
FROM (SELECT p.object_id, p.picket, p.d, arg_max({{'day': f.d, 'n': f.n}}, f.d) AS hit
      FROM (SELECT DISTINCT object_id, picket, d FROM q_rows) p
      JOIN (SELECT object_id, picket, d, CAST(sum(n_fault + n_disabled) AS BIGINT) AS n FROM q_fact_long JOIN q_dim_long USING (channel_id)
            WHERE n_fault + n_disabled > 0 GROUP BY object_id, picket, d) f
        ON f.object_id = p.object_id AND f.picket = p.picket AND f.d < p.d
      GROUP BY p.object_id, p.picket, p.d)
""")


@query("v6_precedents", with_parts("SELECT * FROM q_v6"))
def v6(spark, sf):
    w = World(spark, sf)
    return tidy(verdicts.precedents(_points(spark, sf), w.fact, w.dim))


@query("v7_recommendations", with_parts("""
SELECT id, CASE WHEN scenario = 'отказ' AND sensor_type = 'Датчик дыма' THEN 'Проверить шлейф пожарной сигнализации на участке и питание шкафа ОПС.'
  WHEN scenario = 'отказ' AND sensor_type = 'Газовый датчик' THEN 'Проверить питание и калибровку газоанализатора.'
  WHEN scenario = 'отказ' AND sensor_type = 'КД Дверь' THEN 'Проверить контактную группу и шлейф двери.'
  WHEN scenario = 'отказ' THEN 'Проверить питание и линию связи канала.'
  WHEN scenario = 'подтопление' THEN 'Осмотреть приямок и решётки, проверить работу насоса и уровень притока. При общесетевом водопритоке локальный ремонт не даст эффекта.'
  WHEN scenario = 'пожар' THEN 'Направить бригаду для визуального осмотра участка. При отсутствии термоконтроля полагаться только на осмотр.'
  ELSE 'Проверить целостность люков и дверей на участке, при подтверждении — вызвать группу реагирования.' END AS recommendation
FROM q_cards"""))
def v7(spark, sf):
    return sample_cards(spark, sf).select("id", verdicts.recommendation(F.col("scenario"), F.col("sensor_type")).alias("recommendation"))


def failure_cards(spark, sf):
    """Verdicts of the trained model over the whole test period, all lookups joined.

    The head is ranked once and written: its few rows are read four times, and the features as they were meet them where they are.
    """
    w, model = World(spark, sf), _fitted(spark, sf)[0]
    head = written(verdicts.score_days(_scored_test(spark, sf), w.dim, w.domains), "failure_head")
    told = stored(spark, sf, "explained_head", lambda: explain.top_evidence(
        explain.contributions(model, head), _test_rows(spark, sf)))
    change = explain.counterfactual(model, head, told).select("channel_id", "d", "counterfactual")
    told = told.join(change, ["channel_id", "d"], "left")
    smoke = samples.smoke_long(spark, sf)
    return verdicts.failure_verdicts(head, told, smoke, Heat(spark, sf).state, w.fact, w.dim)


@query("v8_cards_of_fixed_score", with_parts("""
SELECT h.channel_id, h.d, h.object_id, coalesce(h.parent_name, h.object_name) AS object_name, h.picket, round(h.score + 1e-9, 6) AS probability,
  CASE WHEN h.picket IS NULL AND h.object_name IS NULL AND h.parent_name IS NULL THEN 'канал ' || h.channel_id
       ELSE concat_ws(', ', coalesce(h.parent_name, h.object_name), 'ПК' || h.picket) END AS location,
  concat_ws('|', 'проверка', nullif(t.evidence, '')) AS evidence, n.negatives,
  concat_ws('|', nullif(b.blind_spots, ''), nullif(t.blind_spots, '')) AS blind_spots, p.precedent,
  CASE h.sensor_type WHEN 'Датчик дыма' THEN 'Проверить шлейф пожарной сигнализации на участке и питание шкафа ОПС.' WHEN 'Датчик температуры' THEN 'Проверить линию связи датчика; при повторе — заменить измерительный элемент.' WHEN 'Газовый датчик' THEN 'Проверить питание и калибровку газоанализатора.' WHEN 'КД Дверь' THEN 'Проверить контактную группу и шлейф двери.' WHEN 'Датчик движения' THEN 'Проверить питание извещателя и юстировку.' ELSE 'Проверить питание и линию связи канала.' END AS recommendation
FROM q_head h JOIN q_v3 n USING (channel_id, d) JOIN q_v4 b USING (channel_id, d)
LEFT JOIN q_v5 t ON t.object_id = h.object_id AND t.picket = h.picket AND t.d = h.d
LEFT JOIN q_v6 p ON p.object_id = h.object_id AND p.picket = h.picket AND p.d = h.d"""))
def v8_fixed(spark, sf):
    """Failure cards of the fixed score's head: every lookup joined, with one literal sign instead of a model's."""
    w, head = World(spark, sf), written(_head(spark, sf), "fixed_head")
    told = head.select("channel_id", "d", F.lit(0.5).alias("bias"), F.array(verdicts.sign(
        "fault_ev_7d", "отказы", F.lit(1.0), F.lit(0.5), F.lit("проверка"), F.lit(None).cast("string"))).alias("evidence"),
        F.lit(None).cast("string").alias("counterfactual"))
    rows = verdicts.failure_verdicts(head, told, samples.smoke_long(spark, sf), Heat(spark, sf).state, w.fact, w.dim)
    return tidy(rows.select("channel_id", "d", "object_id", "object_name", "picket", "probability", "location",
                            F.transform("evidence", lambda e: e["phrase"]).alias("evidence"), "negatives", "blind_spots", "precedent",
                            "recommendation"))


@query("v8_failure_cards")
def v8(spark, sf):
    return flat_evidence(failure_cards(spark, sf))


@query("v9_rendered_cards", with_parts(f"""
SELECT id, concat_ws(chr(10),
   coalesce(object_name || ', ', '') || scenario || ' — ' || scenario || ', ' || CAST(round_even(probability * 100, 0) AS BIGINT) || '% в ближайшие 24 ч',
   '', 'Почему так решено:', '  1. ' || phrase1, '     вклад +12.3%', '  2. ' || phrase2, '     вклад +5.0%',
   '', 'Это НЕ проверка', CASE WHEN blind THEN '' END, CASE WHEN blind THEN 'Чего мы не видим:' END, CASE WHEN blind THEN '  • слепая зона' END,
   '', 'Что делать: Осмотреть', precedent) AS card
FROM q_cards"""))
def v9(spark, sf):
    rows = sample_cards(spark, sf)
    rows = (rows.withColumn("location", F.concat(F.coalesce(F.concat("object_name", F.lit(", ")), F.lit("")), "scenario"))
            .withColumn("card_type", F.col("scenario")).withColumn("negatives", F.array(F.lit("проверка")))
            .withColumn("counterfactual", F.lit(None).cast("string")))
    return rows.select("id", verdicts.render_card().alias("card"))


# ---- timelines and multicards ------------------------------------------------------

part("q_series", """
SELECT h.channel_id, h.d AS day, f.d, f.n_ev, f.n_fault + f.n_disabled AS bad, f.n_undefined, f.t_first, f.t_last, f.t_first_fault,
       f.t_last_fault, f.t_first_undefined
FROM q_head h JOIN q_fact_long f ON f.channel_id = h.channel_id AND f.d BETWEEN h.d - 90 AND h.d
""")


def stamp_sql(t: str) -> str:
    return f"CAST(d AS VARCHAR) || 'T' || {CLOCK.format(t)}"


@query("d1_sign_onsets", with_parts(f"""
SELECT channel_id, day AS d,
  arg_min({stamp_sql('coalesce(t_first_fault, t_first)')}, d) FILTER (WHERE bad > 0 AND d > day - 7) AS fault_week,
  arg_min({stamp_sql('coalesce(t_first_fault, t_first)')}, d) FILTER (WHERE bad > 0 AND d > day - 30) AS fault_month,
  arg_max({stamp_sql('coalesce(t_last_fault, t_last)')}, d) FILTER (WHERE bad > 0) AS fault_last,
  arg_max({stamp_sql('t_last')}, d) AS active_last,
  arg_min({stamp_sql('coalesce(t_first_undefined, t_first)')}, d) FILTER (WHERE n_undefined > 0 AND d > day - 7) AS undefined_week,
  arg_min({stamp_sql('t_first')}, d) FILTER (WHERE d > day - 7) AS active_week
FROM q_series GROUP BY channel_id, day"""))
def d1(spark, sf):
    w = World(spark, sf)
    return cards.onsets(_head(spark, sf).select("channel_id", "d"), w.fact)


@query("d2_timelines", with_parts("""
SELECT id, CASE WHEN status = 'закрыт' THEN line || '|' || '2026-12-31~решение~закрыт: снят (Профилактика)' ELSE line END AS timeline
FROM (SELECT id, status, string_agg(ts || '~' || kind || '~' || text, '|' ORDER BY ts, pos) AS line
      FROM (SELECT id, status, since1 AS ts, 0 AS pos, 'признак' AS kind, phrase1 AS text FROM q_cards
            UNION ALL SELECT id, status, since2, 1, 'признак', phrase2 FROM q_cards
            UNION ALL SELECT id, status, created_at, 2, 'вердикт', 'сформирован вердикт' FROM q_cards)
      GROUP BY id, status)"""))
def d2(spark, sf):
    closed = F.when(F.col("status") == fv.STATUS_CLOSED, F.lit("2026-12-31"))
    line = cards.timeline(F.col("evidence"), created=F.col("created_at"), closed=closed,
                          action=F.lit("снят"), reason=F.lit("Профилактика"))
    return tidy(sample_cards(spark, sf).select("id", F.transform(
        line, lambda x: F.concat_ws("~", x["ts"], x["kind"], x["text"])).alias("timeline")))


@query("d3_incubation", with_parts(f"""
SELECT id, least(since1, since2) AS first_sign_at, n AS incubation_days,
  CASE WHEN n <= 0 THEN 'признаки появились сегодня — развитие внезапное' WHEN n = 1 THEN 'признаки копятся сутки'
       WHEN n <= 3 THEN 'признаки копятся ' || n || ' ' || {forms('n', 'сутки', 'суток', 'суток')}
       ELSE 'признаки копятся ' || n || ' ' || {forms('n', 'сутки', 'суток', 'суток')} || ' — деградация постепенная, вероятно, можно закрыть плановой заявкой' END AS phrase
FROM (SELECT *, datediff('day', CAST(substr(least(since1, since2), 1, 10) AS DATE), d) AS n FROM q_cards)"""))
def d3(spark, sf):
    n = F.datediff("d", F.to_date(F.substring("first_sign_at", 1, 10)))
    return tidy(sample_cards(spark, sf).select("id", "first_sign_at", n.alias("incubation_days"),
                                               cards.incubation_phrase(n).alias("phrase")))


@query("d4_titles", with_parts("SELECT id, title FROM q_titled"))
def d4(spark, sf):
    return build_cards(spark, sf).select("id", cards.title().alias("title"))


def scenario_cards(spark, sf):
    n = Network(spark, sf)
    from tritmarts.operators import pumps
    from tritmarts.plans.catalog_scenarios import GUARDING, PUMPING
    rows = (verdicts.pump_verdicts(n.pump_anomaly, n.pump_day, pumps.network_days(n.pump_anomaly, PUMPING), n.dim)
            .unionByName(verdicts.fire_verdicts(n.candidates, n.dim))
            .unionByName(verdicts.intrusion_verdicts(n.episodes, n.calendar, cfg=GUARDING)))
    return cards.enrich(rows, samples.fact(spark, sf))


part("q_net_cards", f"""
SELECT *, {TITLE} AS title, datediff('day', CAST(substr(first_sign_at, 1, 10) AS DATE), d) AS incubation_days
FROM (SELECT c.*, NULL::VARCHAR AS sensor_type, CASE WHEN channel_id IS NULL THEN episode_at ELSE
        (SELECT arg_min(CAST(f.d AS VARCHAR) || 'T' || {CLOCK.format('f.t_first')}, f.d) FROM q_fact f
         WHERE f.channel_id = c.channel_id AND f.d BETWEEN c.d - 6 AND c.d) END AS first_sign_at
      FROM (SELECT * FROM q_pump_cards UNION ALL SELECT * FROM q_fire_cards UNION ALL SELECT * FROM q_intrusion_cards) c)
""")


@query("d5_enriched_cards", with_parts("""
SELECT scenario, d, object_name, picket, channel_id, probability, title, first_sign_at, incubation_days,
       len(string_split(evidence, '|')) AS n_signs FROM q_net_cards"""))
def d5(spark, sf):
    """Titles, onsets and first signs of the pumping, fire and intrusion verdicts, with the signs of their timelines."""
    rows = scenario_cards(spark, sf)
    return tidy(rows.select("scenario", "d", "object_name", "picket", "channel_id", "probability", "title", "first_sign_at",
                            "incubation_days", F.size("timeline").alias("n_signs")))


@query("d6_multicards", with_parts(f"""
SELECT place AS object_name, count(*) AS n_cards, round(max(probability) + 1e-9, 6) AS max_probability,
       count(*) FILTER (WHERE scenario = 'отказ') AS failures, count(*) FILTER (WHERE scenario = 'пожар') AS fires,
       array_to_string(list_sort(list(DISTINCT picket) FILTER (WHERE picket IS NOT NULL)), '|') AS pickets, min(least(since1, since2)) AS first_sign_at
FROM q_titled GROUP BY place"""))
def d6(spark, sf):
    out = cards.multicards(sample_cards(spark, sf))
    count = lambda s: F.coalesce(F.try_element_at("scenarios", F.lit(s)), F.lit(0))
    return tidy(out.select("object_name", "n_cards", "max_probability", count(fv.FAILURE).alias("failures"),
                           count(fv.FIRE).alias("fires"), "pickets", "first_sign_at"))


@query("d6_ranked_cards", with_parts("""
SELECT id, place AS object_name, row_number() OVER (PARTITION BY place ORDER BY probability DESC, id) AS place FROM q_titled"""))
def d6_ranked(spark, sf):
    return tidy(cards.ranked_cards(sample_cards(spark, sf).select("id", "object_name", "probability"))
                .select("id", "object_name", "place"))


@query("d6_card_pages", with_parts("""
SELECT object_name, (place - 1) // 500 AS page, count(*) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY place) AS ids
FROM (SELECT id, place AS object_name, row_number() OVER (PARTITION BY place ORDER BY probability DESC, id) AS place FROM q_titled) GROUP BY 1, 2"""))
def d6_pages(spark, sf):
    pages = cards.card_pages(sample_cards(spark, sf).select("id", "object_name", "probability", "title"))
    return tidy(pages.select("object_name", "page", F.size("cards").alias("n"),
                             F.transform("cards", lambda c: c["id"]).alias("ids")))


part("q_merge", """
SELECT object_name, substr(ts, 1, 10) AS day, kind, text, label, min(o) AS o, arg_min(ts, o) AS ts
FROM (SELECT *, coalesce('ПК' || picket, sensor_name) AS label,
             {'p': -probability, 'c': ch, 'k': CASE WHEN kind = 'вердикт' THEN 1 ELSE 0 END, 't': ts} AS o FROM q_signs)
GROUP BY object_name, substr(ts, 1, 10), kind, text, label
""")


@query("d7_merged_timeline", with_parts("""
SELECT object_name, ts, kind, n AS n_sources,
  CASE WHEN n > 3 THEN text || ' — на ' || n || ' точках (' || array_to_string(names[1:3], ', ') || ' и ещё ' || (n - 3) || ')'
       WHEN n > 1 THEN text || ' — на ' || n || ' точках (' || array_to_string(names, ', ') || ')' ELSE text || ' — ' || names[1] END AS text
FROM (SELECT object_name, kind, text, arg_min(ts, o) AS ts, count(*) AS n, list(label ORDER BY o) AS names
      FROM q_merge GROUP BY object_name, day, kind, text)"""))
def d7(spark, sf):
    return tidy(cards.merged_timeline(sample_cards(spark, sf)))


part("q_secs", """
SELECT object_name, datediff('second', TIMESTAMP '2024-01-01', strptime(ts, '%Y-%m-%dT%H:%M:%S')) AS s, picket FROM q_signs WHERE length(ts) > 10
""")
CASCADES = with_parts(f"""
SELECT object_name, strftime(TIMESTAMP '2024-01-01' + to_seconds(a), '%Y-%m-%dT%H:%M:%S') AS "at", n_signs, span_seconds::DOUBLE AS span_seconds,
  array_to_string(pk, '|') AS pickets,
  n_signs || ' ' || {forms('n_signs', 'признак', 'признака', 'признаков')} || ' на ' || len(pk) || ' точках возникли за ' || span_seconds || ' с ('
  || strftime(TIMESTAMP '2024-01-01' + to_seconds(a), '%d.%m %H:%M:%S') || '), отрезок ПК' || pk[1] || '–ПК' || pk[-1] || ' (' || (pk[-1] - pk[1]) * 10
  || ' м). Похоже на каскад по питающей линии, а не на независимые отказы' AS text
FROM (SELECT w.object_name, w.a, count(*) AS n_signs, max(s) - w.a AS span_seconds, list_sort(list(DISTINCT picket) FILTER (WHERE picket IS NOT NULL)) AS pk
      FROM walk w JOIN q_secs q ON q.object_name = w.object_name AND q.s BETWEEN w.a AND w.a + 120 GROUP BY w.object_name, w.a)
WHERE n_signs >= 4 AND len(pk) >= 2""")
CASCADES = CASCADES.replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT object_name, strftime", """,
walk AS (
  SELECT object_name, min(s) AS a FROM q_secs GROUP BY object_name
  UNION ALL
  SELECT w.object_name, (SELECT min(q.s) FROM q_secs q WHERE q.object_name = w.object_name AND q.s > w.a + 120) FROM walk w
  WHERE w.a < (SELECT max(q.s) - 120 FROM q_secs q WHERE q.object_name = w.object_name)
)
SELECT object_name, strftime""", 1)


@query("d8_cascades", CASCADES)
def d8(spark, sf):
    return tidy(cascades.detect_cascades(cards.signs(sample_cards(spark, sf))))


@query("d9_object_summaries", with_parts(f"""
SELECT place AS object_name,
  place || ', участок ПК' || min(picket) || '–ПК' || max(picket) || ': ' || (SELECT string_agg(n || ' ' || CASE scenario
     WHEN 'отказ' THEN {forms('n', 'отказ', 'отказа', 'отказов')} WHEN 'подтопление' THEN {forms('n', 'подтопление', 'подтопления', 'подтоплений')}
     WHEN 'пожар' THEN {forms('n', 'задымление', 'задымления', 'задымлений')} ELSE {forms('n', 'проникновение', 'проникновения', 'проникновений')} END, ', ' ORDER BY n DESC, p DESC)
     FROM (SELECT scenario, count(*) AS n, max(probability) AS p FROM q_titled i WHERE i.place = o.place GROUP BY scenario))
  || '. Наибольший риск ' || CAST(round_even(max(probability) * 100, 0) AS BIGINT) || '% — ' || arg_max(title, (probability, title)) || '.' AS summary,
  CASE WHEN avg(blind::INT) >= 0.5 THEN 'У ' || sum(blind::INT) || ' из ' || count(*) || ' ' || {forms('count(*)', 'вердикта', 'вердиктов', 'вердиктов')}
       || ' ограничена наблюдаемость — подтвердить приборами получится не всё' END AS blind_summary
FROM q_titled o GROUP BY place"""))
def d9(spark, sf):
    return cards.multicards(sample_cards(spark, sf)).select("object_name", "summary", "blind_summary")


@query("d6_multicard_documents", with_parts("""
SELECT place AS object_name, n_cards, max_probability, ids, n_marks, (n_cards + 499) // 500 AS card_pages, true AS ordered
FROM (SELECT place, count(*) AS n_cards, round(max(probability) + 1e-9, 6) AS max_probability, sum(id)::BIGINT AS ids FROM q_titled GROUP BY place)
JOIN (SELECT object_name AS place, count(*) AS n_marks FROM (SELECT DISTINCT object_name, day, kind, text FROM q_merge) GROUP BY 1) USING (place)"""))
def d6_documents(spark, sf):
    """Whole documents per object, checked over their parts: cards, marks of the merged timeline, order."""
    parts = cards.multicard_documents(sample_cards(spark, sf))
    ids = F.aggregate("cards", F.lit(0).cast("bigint"), lambda a, c: a + c["id"])
    stamps = F.transform("timeline", lambda e: e["ts"])
    return tidy(parts.groupBy("object_name").agg(
        F.max("n_cards").alias("n_cards"), F.max("max_probability").alias("max_probability"), F.sum(ids).alias("ids"),
        F.sum(F.coalesce(F.size("timeline"), F.lit(0))).alias("n_marks"), F.count("cards").alias("card_pages"),
        F.bool_and(F.coalesce(stamps == F.array_sort(stamps), F.lit(True))).alias("ordered")))


# ---- work orders ---------------------------------------------------------------------

@query("o1_work_types", with_parts("""
SELECT id, CASE WHEN scenario = 'отказ' AND sensor_type = 'Датчик дыма' THEN 'Проверка шлейфа пожарной сигнализации'
  WHEN scenario = 'отказ' AND sensor_type = 'Тепловой датчик' THEN 'Проверка теплового извещателя'
  WHEN scenario = 'отказ' AND sensor_type = 'Газовый датчик' THEN 'Проверка и калибровка газоанализатора'
  WHEN scenario = 'отказ' AND sensor_type = 'КД Дверь' THEN 'Проверка дверного контакта и шлейфа'
  WHEN scenario = 'отказ' THEN 'Проверка канала и линии связи' WHEN scenario = 'подтопление' THEN 'Обследование приямка и насосного оборудования'
  WHEN scenario = 'пожар' THEN 'Визуальный осмотр участка, проверка пожарной сигнализации'
  ELSE 'Осмотр люков и дверей участка, проверка охранного контура' END AS work_type,
  CASE scenario WHEN 'отказ' THEN 'Служба эксплуатации КИПиА' WHEN 'подтопление' THEN 'Служба водоудаления' WHEN 'пожар' THEN 'Дежурная бригада'
  ELSE 'Группа реагирования' END AS responsible FROM q_cards"""))
def o1(spark, sf):
    return sample_cards(spark, sf).select("id", orders.work_type(F.col("scenario"), F.col("sensor_type")).alias("work_type"),
                                          orders.responsible(F.col("scenario")).alias("responsible"))


part("q_prio", """
SELECT *, CASE WHEN cascade THEN 'аварийный' WHEN scenario IN ('пожар','проникновение') AND probability >= 0.6 THEN 'аварийный'
  WHEN probability >= 0.85 THEN 'высокий' WHEN probability >= 0.6 AND coalesce(incubation_days, 0) > 7 THEN 'средний'
  WHEN probability >= 0.6 THEN 'высокий' ELSE 'низкий' END AS priority FROM q_titled
""")


@query("o2_priorities", with_parts("SELECT id, priority FROM q_prio"))
def o2(spark, sf):
    level = orders.priority(F.col("probability"), F.col("scenario"), F.col("incubation_days"), F.col("cascade"))
    return sample_cards(spark, sf).select("id", level.alias("priority"))


part("q_drafts", """
SELECT p.*, CASE WHEN next_break <= raw_due THEN greatest(d, next_break - 1) ELSE raw_due END AS due_date,
  CASE WHEN next_break <= raw_due THEN 'срок сдвинут на ' || strftime(next_break - 1, '%d.%m') || ': далее следуют ' || next_break_length || ' нерабочих дня подряд' END AS calendar_note
FROM (SELECT *, d + CASE priority WHEN 'аварийный' THEN 1 WHEN 'высокий' THEN 3 WHEN 'средний' THEN 10 ELSE 30 END AS raw_due FROM q_prio) p
JOIN (SELECT d, next_break, next_break_length FROM q_risk) USING (d)
""")


@query("o3_due_dates", with_parts("SELECT id AS verdict_id, due_date, calendar_note FROM q_drafts"))
def o3(spark, sf):
    return orders.drafts(sample_cards(spark, sf), Network(spark, sf).calendar).select("verdict_id", "due_date", "calendar_note")


@query("o4_drafts", with_parts("""
SELECT id AS verdict_id, priority, concat_ws(chr(10), phrase1, replace(since2, 'T', ' ') || ' — ' || phrase2,
   CASE WHEN blind THEN chr(10) || 'Ограничения наблюдаемости:' || chr(10) || '— слепая зона' END, chr(10) || precedent) AS justification,
  work || ' — ' || coalesce(object_name, '') || coalesce(', ПК' || picket, '') || '. Приоритет ' || priority || ', срок до ' || strftime(due_date, '%d.%m.%Y')
  || ', исполнитель: ' || who || '.' || coalesce(' С' || substr(calendar_note, 2) || '.', '') AS summary_line
FROM (SELECT *, CASE scenario WHEN 'отказ' THEN 'Служба эксплуатации КИПиА' WHEN 'подтопление' THEN 'Служба водоудаления' WHEN 'пожар' THEN 'Дежурная бригада' ELSE 'Группа реагирования' END AS who,
   CASE WHEN scenario = 'подтопление' THEN 'Обследование приямка и насосного оборудования' WHEN scenario = 'пожар' THEN 'Визуальный осмотр участка, проверка пожарной сигнализации'
        WHEN scenario = 'проникновение' THEN 'Осмотр люков и дверей участка, проверка охранного контура'
        ELSE ['Проверка шлейфа пожарной сигнализации','Проверка теплового извещателя','Проверка и калибровка газоанализатора','Проверка дверного контакта и шлейфа','Проверка канала и линии связи'][id % 5 + 1] END AS work
 FROM q_drafts)"""))
def o4(spark, sf):
    rows = orders.drafts(sample_cards(spark, sf), Network(spark, sf).calendar)
    return rows.select("verdict_id", "priority", "justification", orders.summary_line().alias("summary_line"))


# ---- geometry --------------------------------------------------------------------------

part("q_named", "SELECT coalesce(parent_name, object_name) AS name, sensor_name, picket FROM q_dim WHERE coalesce(parent_name, object_name) IS NOT NULL")
part("q_topo", """
SELECT name, arg_max(place, (c, -n)) AS toponym FROM (
  SELECT name, place, n, sum((length(sensor_name) - length(replace(lower(sensor_name), lower(place), ''))) / length(place)) AS c
  FROM q_named, q_places GROUP BY name, place, n) WHERE c > 0 GROUP BY name
""")
part("q_axis", """
SELECT *, lat0 - k * cos(b) / 111320 / 2 AS lat1, lon0 - k * sin(b) / (111320 * cos(radians(lat0))) / 2 AS lon1,
       lat0 + k * cos(b) / 111320 / 2 AS lat2, lon0 + k * sin(b) / (111320 * cos(radians(lat0))) / 2 AS lon2
FROM (SELECT name, toponym, lo, hi, (hi - lo) * 10 AS length_m, greatest((hi - lo) * 10, 200) AS k, lat0, lon0,
             radians(list_sum(list_transform(string_split(name, ''), lambda ch: unicode(ch))) % 360) AS b
      FROM (SELECT name, min(picket) AS lo, max(picket) AS hi FROM q_named GROUP BY name)
      JOIN q_topo USING (name)
      JOIN (VALUES ('Зюзино', 55.6560, 37.5760), ('Ясенево', 55.6030, 37.5330), ('Беляево', 55.6420, 37.5240),
                   ('Коньково', 55.6330, 37.5180), ('Никулино', 55.6620, 37.4770)) AS a(toponym, lat0, lon0) USING (toponym))
""")
AXIS_COLS = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("lat1", "lon1", "lat2", "lon2"))


@query("g1_toponyms", with_parts("SELECT name AS object_name, toponym FROM q_topo"))
def g1(spark, sf):
    return geometry.toponyms(samples.dim(spark, sf))


@query("g2_axis_lines", with_parts(f"""
SELECT name AS object_name, toponym, true AS anchor_known, lo AS picket_min, hi AS picket_max, length_m, {AXIS_COLS} FROM q_axis"""))
def g2(spark, sf):
    return tidy(geometry.axis_lines(samples.dim(spark, sf)))


def network_cards(spark, sf):
    """Enriched scenario cards with an id, as exports and maps take them."""
    rows = stored(spark, sf, "network_cards", lambda: scenario_cards(spark, sf))
    return rows.withColumn("id", F.xxhash64("scenario", "d", "object_id", "picket", "channel_id")) \
        .withColumn("status", F.lit(fv.STATUS_NEW)).withColumn("created_at", F.col("d").cast("string"))


@query("g3_picket_positions", with_parts("""
SELECT channel_id, round(lat1 + (lat2 - lat1) * t + 1e-9, 6) AS lat, round(lon1 + (lon2 - lon1) * t + 1e-9, 6) AS lon
FROM (SELECT channel_id, a.*, CASE WHEN hi = lo THEN 0 ELSE (picket - lo) / (hi - lo) END AS t
      FROM q_dim JOIN q_axis a ON a.name = coalesce(parent_name, object_name) WHERE picket IS NOT NULL)"""))
def g3(spark, sf):
    lat, lon = geometry.picket_position()
    dim = samples.dim(spark, sf)
    named = dim.select("channel_id", "picket", F.coalesce("parent_name", "object_name").alias("object_name")).filter("picket IS NOT NULL")
    return tidy(named.join(geometry.axis_lines(dim), "object_name").select("channel_id", lat.alias("lat"), lon.alias("lon")))


def _map(spark, sf):
    rows = network_cards(spark, sf)
    lines = geometry.axis_lines(samples.dim(spark, sf))
    return geometry.object_geometry(cards.multicards(rows), lines), geometry.verdict_points(rows, lines)


@query("g4_object_geometry", with_parts(f"""
SELECT a.name AS object_name, toponym, lo AS picket_min, hi AS picket_max, length_m, n_cards, {AXIS_COLS}
FROM q_axis a JOIN (SELECT object_name, count(*) AS n_cards FROM (
   SELECT coalesce(parent_name, object_name) AS object_name FROM (
     SELECT dm.*, row_number() OVER (PARTITION BY p.d ORDER BY robust_z DESC NULLS LAST, p.channel_id) AS r
     FROM q_pump_anom p JOIN q_dim dm USING (channel_id) WHERE trit = 1) WHERE r <= 50
   UNION ALL SELECT place_name FROM (SELECT place_name, row_number() OVER (PARTITION BY d ORDER BY score DESC, object_id, picket) AS r
     FROM q_fire_scored JOIN q_place USING (object_id) WHERE score > 0) WHERE r <= 20
   UNION ALL SELECT coalesce(parent_name, object_name) FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY risk DESC, object_id, picket) AS r
     FROM q_intr_raised) WHERE r <= 20) GROUP BY object_name) m ON m.object_name = a.name"""))
def g4(spark, sf):
    out = _map(spark, sf)[0]
    return tidy(out.select("object_name", "toponym", "picket_min", "picket_max", "length_m", "n_cards", "lat1", "lon1", "lat2", "lon2"))


# ---- reports ------------------------------------------------------------------------------

part("q_register", """
SELECT c.*, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN id % 2 = 0 THEN 'снят' ELSE 'подтверждён' END END AS action,
       CASE WHEN o_orderstatus = 'F' THEN ['Ложное срабатывание','Профилактика','Подтверждён отказ','Плановая проверка','Другое'][CAST(o_orderpriority[1] AS INT)] END AS reason_title,
       n_name AS full_name
FROM q_titled c JOIN orders ON o_orderkey = id LEFT JOIN nation ON o_orderstatus = 'F' AND n_nationkey = o_custkey % 25
""")


def _register(spark, sf):
    return reports.verdict_register(sample_cards(spark, sf), decisions(spark, sf), reasons(spark), users(spark, sf))


@query("r1_verdict_register", with_parts("""
SELECT id, scenario, object_name, picket, round(probability + 1e-9, 6) AS probability, status, action, reason_title, full_name FROM q_register"""))
def r1(spark, sf):
    return tidy(_register(spark, sf).select("id", "scenario", "object_name", "picket", "probability", "status", "action",
                                            "reason_title", "full_name"))


@query("r2_summary", with_parts("""
SELECT indicator, round(value + 1e-9, 6) AS value FROM (
 SELECT 'total' AS indicator, count(*)::DOUBLE AS value FROM q_register UNION ALL SELECT 'closed', count(action) FROM q_register
 UNION ALL SELECT 'non_essential', count(*) FROM q_register WHERE reason_title IN ('Ложное срабатывание','Профилактика','Плановая проверка')
 UNION ALL SELECT 'non_essential_share', avg((reason_title IN ('Ложное срабатывание','Профилактика','Плановая проверка'))::INT) FROM q_register WHERE action IS NOT NULL
 UNION ALL SELECT 'scenario: ' || scenario, count(*) FROM q_register GROUP BY 1
 UNION ALL SELECT 'status: ' || status, count(*) FROM q_register GROUP BY 1)"""))
def r2(spark, sf):
    return tidy(reports.summary(_register(spark, sf)))


@query("r3_observability", with_parts("""
SELECT object_name, count(*) AS total, sum(blind::INT)::BIGINT AS blind, round(avg(blind::INT) + 1e-9, 6) AS share
FROM q_register GROUP BY object_name HAVING bool_or(blind)"""))
def r3(spark, sf):
    return tidy(reports.observability(_register(spark, sf)))


@query("r4_work_order_register", with_parts("""
SELECT id AS verdict_id, due_date, priority, n_name AS full_name FROM q_drafts LEFT JOIN nation ON n_nationkey = id % 30"""))
def r4(spark, sf):
    rows = orders.drafts(sample_cards(spark, sf), Network(spark, sf).calendar)
    rows = rows.withColumn("author_id", F.col("verdict_id") % 30).withColumn("created_at", F.col("d").cast("string"))
    return reports.work_order_register(rows, users(spark, sf)).select("verdict_id", "due_date", "priority", "full_name")


@query("r5_verdict_feed", with_parts("""
SELECT id, round(probability + 1e-9, 6) AS probability, status, scenario FROM q_cards WHERE status = 'новый' AND scenario = 'пожар'
ORDER BY q_cards.probability DESC, created_at DESC, id LIMIT 100"""))
def r5(spark, sf):
    feed = reports.verdict_feed(sample_cards(spark, sf), fv.STATUS_NEW, fv.FIRE)
    return tidy(feed.select("id", "probability", "status", "scenario"))


@query("r6_visible_to_user", with_parts("""
SELECT id, object_id FROM q_cards WHERE object_id IN (7, 12)"""))
def r6_rows(spark, sf):
    rows = reports.visible_to(sample_cards(spark, sf), users(spark, sf), assignments(spark, sf), 7)
    return rows.select("id", "object_id")


@query("r6_visible_counts", with_parts("""
SELECT n_nationkey::BIGINT AS user_id, (SELECT count(*) FROM q_cards WHERE n_nationkey % 4 = 0 OR n_nationkey % 3 = 0
   OR object_id IN (n_nationkey % 16, (n_nationkey + 5) % 16)) AS visible FROM nation"""))
def r6_counts(spark, sf):
    return tidy(reports.visible_counts(sample_cards(spark, sf), users(spark, sf), assignments(spark, sf)))


@query("r7_queue_counters", with_parts("""
SELECT count(DISTINCT place) AS objects, count(*) AS verdicts, count(*) FILTER (WHERE probability >= 0.8) AS high_risk,
       count(*) FILTER (WHERE status = 'новый') AS "new", count(*) FILTER (WHERE blind) AS limited_view FROM q_titled"""))
def r7(spark, sf):
    return tidy(reports.queue_counters(sample_cards(spark, sf)))


@query("r8_object_scenario_matrix", with_parts("""
SELECT coalesce(object_name, 'без объекта') AS object_name, count(*) FILTER (WHERE scenario = 'отказ') AS failure,
  count(*) FILTER (WHERE scenario = 'подтопление') AS flooding, count(*) FILTER (WHERE scenario = 'пожар') AS fire,
  count(*) FILTER (WHERE scenario = 'проникновение') AS intrusion, count(*) AS total FROM q_cards GROUP BY 1"""))
def r8(spark, sf):
    m = reports.object_scenario_matrix(sample_cards(spark, sf))
    return tidy(m.select("object_name", F.col(fv.FAILURE).alias("failure"), F.col(fv.FLOODING).alias("flooding"),
                         F.col(fv.FIRE).alias("fire"), F.col(fv.INTRUSION).alias("intrusion"), "total"))


@query("r9_incubation_histogram", with_parts("""
SELECT bucket, count(incubation_days) AS n
FROM (VALUES (0, 0, 'сегодня'), (1, 7, '1–7 суток'), (8, 30, '8–30 суток'), (31, 60, '31–60 суток'), (61, 9999, 'свыше 60 суток')) AS b(lo, hi, bucket)
LEFT JOIN q_cards ON incubation_days BETWEEN lo AND hi GROUP BY bucket"""))
def r9(spark, sf):
    return tidy(reports.incubation_histogram(sample_cards(spark, sf)))


@query("r10_linear_scheme", with_parts("""
SELECT id, object_name, picket, lo, hi, round((picket - lo) / greatest(hi - lo, 1) + 1e-9, 6) AS position
FROM (SELECT *, min(picket) OVER (PARTITION BY object_name) AS lo, max(picket) OVER (PARTITION BY object_name) AS hi FROM q_cards
      WHERE picket IS NOT NULL AND object_name IS NOT NULL)"""))
def r10(spark, sf):
    return tidy(reports.linear_scheme(sample_cards(spark, sf)).select("id", "object_name", "picket", "lo", "hi", "position"))


# ---- calibration ------------------------------------------------------------------------------

@query("q1_sensor_behaviour", with_parts("""
SELECT sensor_type, channels, events_per_active_day, median_events, active_share, coalesce(channel_days, 0) AS channel_days,
       coalesce(failures, 0)::BIGINT AS failures, coalesce(daily_failure_rate, 0) AS daily_failure_rate
FROM (SELECT sensor_type, count(*) AS channels, round(avg(m) + 1e-9, 2) AS events_per_active_day, round(median(md) + 1e-9, 1) AS median_events,
             round(avg(a / l) + 1e-9, 4) AS active_share
      FROM (SELECT channel_id, count(*) AS a, datediff('day', min(d), max(d)) + 1 AS l, avg(n_ev) AS m, median(n_ev) AS md FROM q_fact_long GROUP BY channel_id)
      JOIN q_dim_long USING (channel_id) GROUP BY sensor_type)
LEFT JOIN (SELECT sensor_type, count(*) AS channel_days, sum(y) AS failures, round(avg(y) + 1e-9, 6) AS daily_failure_rate
           FROM q_labels JOIN q_dim_long USING (channel_id) WHERE d >= DATE '2000-01-01' GROUP BY sensor_type) USING (sensor_type)"""))
def q1(spark, sf):
    w = World(spark, sf)
    return tidy(calibration.sensor_behaviour(w.fact, w.dim, w.labels, FIT.test_from))


@query("q2_precursor_profile", with_parts("SELECT feature, round(b, 4) AS before, round(u, 4) AS usual, round(b / nullif(u, 0), 1) AS ratio FROM ("
       + " UNION ALL ".join(f"SELECT '{n}' AS feature, avg({n}) FILTER (WHERE y = 1) AS b, avg({n}) FILTER (WHERE y = 0) AS u "
                            f"FROM q_features WHERE d >= DATE '2000-01-01'" for n in fv.PRECURSOR_FEATURES) + ")"))
def q2(spark, sf):
    return tidy(calibration.precursor_profile(World(spark, sf).features, FIT.test_from))


@query("q3_early_signal", with_parts("""
SELECT h::BIGINT AS horizon, round(avg(f), 4) AS with_fault, round(avg(u), 4) AS with_undefined
FROM (SELECT x.channel_id, h, max((p.fault_ev_7d > 0)::INT) AS f, max((p.undefined_ev_7d > 0)::INT) AS u
      FROM q_features x, (SELECT unnest([1, 3, 7, 14, 30]) AS h), q_features p
      WHERE x.y = 1 AND x.d >= DATE '2000-01-01' AND p.channel_id = x.channel_id AND p.d = x.d - h GROUP BY x.channel_id, h) GROUP BY h"""))
def q3(spark, sf):
    return tidy(calibration.early_signal(World(spark, sf).features, FIT.test_from))


@query("q4_instrumentation", with_parts("""
SELECT k AS n_types, count(*) AS points, sum(n)::BIGINT AS channels FROM (
  SELECT count(DISTINCT sensor_type) AS k, count(*) AS n FROM q_dim WHERE picket IS NOT NULL GROUP BY object_id, picket) GROUP BY k"""))
def q4(spark, sf):
    return tidy(calibration.instrumentation(samples.dim(spark, sf)))


@query("q5_pump_statistics", with_parts("""
SELECT round(avg(n_starts), 2) AS mean, median(n_starts) AS median, quantile_cont(n_starts, 0.9) AS p90, quantile_cont(n_starts, 0.99) AS p99,
       max(n_starts) AS max FROM q_pump_day WHERE n_starts > 0"""))
def q5(spark, sf):
    return tidy(calibration.pump_statistics(Network(spark, sf).pump_day))


@query("q5_pump_months", with_parts("SELECT month(d) AS month, round(avg(n_starts), 2) AS starts FROM q_pump_day GROUP BY 1"))
def q5_months(spark, sf):
    return tidy(calibration.pump_months(Network(spark, sf).pump_day))


@query("q5_smoke_statistics", with_parts("""
SELECT is_sweep, count(*) AS episodes, round(avg(n_smoke_ch), 2) AS channels, round(avg(n_smoke_ev), 2) AS triggers,
       round(avg((has_thermal IS TRUE)::INT), 4) AS with_thermal, round(avg(domain_size), 2) AS point_channels FROM q_cand GROUP BY is_sweep"""))
def q5_smoke(spark, sf):
    return tidy(calibration.smoke_statistics(Network(spark, sf).candidates))


@query("q5_intrusion_statistics", with_parts("""
SELECT round(avg(n_triggers), 2) AS triggers, median(n_triggers) AS median, round(avg(n_types), 2) AS types,
       round(avg(last_t // 60 - first_t // 60), 1) AS minutes, round(avg(is_night::INT), 4) AS night_share FROM q_episodes"""))
def q5_intrusion(spark, sf):
    return tidy(calibration.intrusion_statistics(Network(spark, sf).episodes))


@query("q5_temperature_statistics", with_parts("""
SELECT round(avg(t_avg), 2) AS mean, round(avg(t_max - t_min), 2) AS daily_range, round(stddev_samp(t_avg), 2) AS spread_between_points,
       round(avg(n_channels), 2) AS sensors_per_point FROM q_temp"""))
def q5_temperature(spark, sf):
    return tidy(calibration.temperature_statistics(Heat(spark, sf).days))


@query("q5_domain_histogram", with_parts("SELECT n_channels AS channels, count(*) AS domains FROM q_domain GROUP BY 1"))
def q5_domains(spark, sf):
    return tidy(calibration.domain_histogram(Network(spark, sf).domains))


@query("q6_missing_controls", with_parts("SELECT type, count(*) FILTER (WHERE k = 0) AS objects_without FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS type, parent_name, count(*) FILTER (WHERE sensor_type = '{k}') AS k FROM q_dim GROUP BY parent_name"
    for k, t in fv.CONTROL_TYPES) + ") GROUP BY type"))
def q6(spark, sf):
    return tidy(calibration.missing_controls(samples.dim(spark, sf)))


@query("q7_facts_panel", with_parts("""
SELECT fact, value::BIGINT AS value FROM (
 SELECT 'channels' AS fact, count(*) AS value FROM q_dim UNION ALL SELECT 'objects', count(DISTINCT parent_name) FROM q_dim
 UNION ALL SELECT 'orphans', (SELECT count(DISTINCT channel_id) FROM q_fact) - (SELECT count(*) FROM q_dim)
 UNION ALL SELECT 'domains', count(*) FROM q_domain UNION ALL SELECT 'domains_single', count(*) FROM q_domain WHERE n_channels = 1
 UNION ALL SELECT 'fire_local', count(*) FROM q_cand WHERE NOT is_sweep
 UNION ALL SELECT 'fire_no_thermal', count(*) FROM q_cand WHERE NOT is_sweep AND NOT has_thermal
 UNION ALL SELECT 'guards', count(*) FROM q_health UNION ALL SELECT 'guards_stuck', count(*) FROM q_health WHERE is_stuck)"""))
def q7(spark, sf):
    from tritmarts.operators import marts
    n = Network(spark, sf)
    return tidy(calibration.facts_panel(n.dim, marts.channel_profile(samples.fact(spark, sf)), n.domains, n.candidates, n.health))


part("q_truth", """
SELECT p_partkey AS event_no, ['задымление','подтопление','проникновение'][p_partkey % 3 + 1] AS scenario,
       DATE '2024-01-01' + p_size % 30 AS d, p_partkey % 40 AS picket FROM part
""")
part("q_kinds", """
SELECT * FROM (VALUES ('задымление','Датчик дыма'),('задымление','Тепловой датчик'),('подтопление','Состояние насоса'),('подтопление','Датчик затопления'),
 ('проникновение','КД Люк'),('проникновение','КД Дверь'),('проникновение','Датчик движения')) AS k(scenario, sensor_type)
""")
part("q_sweepdays", "SELECT DISTINCT d FROM q_smoke WHERE is_sweep")
part("q_trig", """
SELECT scenario, f.d, picket, sensor_type FROM q_fact f JOIN q_dim USING (channel_id) JOIN q_kinds USING (sensor_type)
WHERE n_trigger > 0 AND f.d NOT IN (SELECT d FROM q_sweepdays)
""")


def truth(spark, sf):
    """Ground truth as an input table: one incident per part."""
    p = samples.table(spark, sf, "part")
    key = F.col("p_partkey")
    scenario = F.element_at(F.array(*map(F.lit, fv.INCIDENT_TYPES)), (key % 3).cast("int") + 1)
    return p.select(key.alias("event_no"), scenario.alias("scenario"),
                    F.expr("date_add(DATE '2024-01-01', p_size % 30)").alias("d"), (key % 40).cast("int").alias("picket"))


@query("q11_incident_metrics", with_parts("""
SELECT scenario, coalesce(events, 0) AS events, coalesce(detected, 0) AS detected, coalesce(confirmed, 0) AS confirmed,
  coalesce(false_alarms, 0) AS false_alarms, coalesce(false_confirmed, 0) AS false_confirmed, coalesce(lost, 0) AS events_in_dropped_days,
  coalesce((SELECT string_agg(t, '|' ORDER BY t) FROM (SELECT unnest(s.kinds) AS t)
            WHERE t IN (SELECT sensor_type FROM q_dim WHERE picket IS NOT NULL)), '') AS types_in_place,
  (SELECT count(*) FROM q_sweepdays) AS sweep_days,
  (SELECT count(*) FROM q_fact JOIN q_dim USING (channel_id) WHERE n_trigger > 0 AND d IN (SELECT d FROM q_sweepdays)) AS triggers_dropped,
  round(coalesce(detected / nullif(events, 0), 0) + 1e-9, 6) AS recall,
  round(coalesce(detected / nullif(detected + coalesce(x.false_alarms, 0), 0), 0) + 1e-9, 6) AS precision,
  round(coalesce(confirmed / nullif(events, 0), 0) + 1e-9, 6) AS recall_confirmed,
  round(coalesce(confirmed / nullif(confirmed + coalesce(x.false_confirmed, 0), 0), 0) + 1e-9, 6) AS precision_confirmed,
  round(coalesce(confirmed / nullif(detected, 0), 0) + 1e-9, 6) AS confirmability
FROM (VALUES ('задымление', ['Датчик дыма', 'Тепловой датчик']), ('подтопление', ['Состояние насоса', 'Датчик затопления']),
             ('проникновение', ['КД Люк', 'КД Дверь', 'Датчик движения'])) s(scenario, kinds)
LEFT JOIN (SELECT scenario, count(*) AS events, count(*) FILTER (WHERE k > 0) AS detected, count(*) FILTER (WHERE k > 1) AS confirmed,
             count(*) FILTER (WHERE d IN (SELECT d FROM q_sweepdays)) AS lost
      FROM (SELECT t.event_no, t.scenario, t.d, count(DISTINCT g.sensor_type) AS k FROM q_truth t
            LEFT JOIN q_trig g ON g.scenario = t.scenario AND g.d = t.d AND g.picket BETWEEN t.picket - 2 AND t.picket + 2
            GROUP BY t.event_no, t.scenario, t.d) GROUP BY scenario) e USING (scenario)
LEFT JOIN (SELECT scenario, count(*) AS false_alarms, count(DISTINCT CASE WHEN two THEN (d, picket) END) AS false_confirmed
      FROM (SELECT g.*, picket IS NOT NULL AND min(sensor_type) OVER p <> max(sensor_type) OVER p AS two FROM q_trig g
            WHERE NOT EXISTS (SELECT 1 FROM q_truth t WHERE t.scenario = g.scenario AND t.d = g.d AND abs(t.picket - g.picket) <= 2)
            WINDOW p AS (PARTITION BY scenario, d, picket)) GROUP BY scenario) x USING (scenario)"""))
def q11(spark, sf):
    n = Network(spark, sf)
    return tidy(controls.incident_metrics(truth(spark, sf), samples.fact(spark, sf), n.dim, n.smoke))


# ---- sources and sinks ------------------------------------------------------------------------

def _out(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_journal_import", with_parts("""
SELECT 2024 AS year, count(*) AS rows, count(TRY_CAST(raw_value AS DOUBLE)) AS numbers, sum(is_alarm::INT)::BIGINT AS alarms,
       sum(t_sec)::BIGINT AS seconds FROM q_journal"""))
def s1(spark, sf):
    """The journal written as source CSV, imported to Parquet and read back."""
    j = samples.journal(spark, sf)
    titles = {v: k for k, v in readers.JOURNAL_COLUMNS.items()}
    src, dst = _out(spark, "journal-csv"), _out(spark, "journal")
    (j.withColumn("t", clock(F.col("t_sec"))).select(*[F.col(c).alias(titles[c]) for c in titles])
     .write.option("header", True).csv(src))
    readers.import_journal(spark, src, dst)
    return tidy(readers.read_journal(spark, dst).groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.count("num_value").alias("numbers"), F.count_if("is_alarm").alias("alarms"),
        F.sum("t_sec").alias("seconds")))


@query("s2_journal_scan", with_parts("SELECT channel_id, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM q_journal GROUP BY 1"))
def s2(spark, sf):
    """Journal files picked by a glob over their partitions."""
    path = _out(spark, "journal-weeks")
    samples.journal(spark, sf).withColumn("week", F.weekofyear("d")).write.partitionBy("week").parquet(path)
    rows = readers.read_journal(spark, f"{path}/week=*")
    return tidy(rows.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day")))


@query("s3_channel_dictionary", with_parts("""
SELECT channel_id, sensor_type, sensor_name || chr(10) || 'строка "2"' AS sensor_name, object_id FROM q_channels"""))
def s3(spark, sf):
    """Dictionary with quotes and line breaks inside names, read with a row check."""
    c = samples.channels(spark, sf).withColumn("sensor_name", F.concat("sensor_name", F.lit('\nстрока "2"')))
    titles = {v: k for k, v in readers.CHANNEL_COLUMNS.items()}
    src = _out(spark, "channels-csv")
    (c.select(*[F.col(n).alias(t) for n, t in titles.items()]).write.option("header", True).option("escape", '"').csv(src))
    got = readers.read_channels(spark, src, expected_rows=c.count())
    return got.select("channel_id", "sensor_type", "sensor_name", "object_id")


@query("s5_mart_round_trip", with_parts("SELECT channel_id, d, n_ev, trit_day FROM q_fact_long"))
def s5(spark, sf):
    path = readers.write_mart(samples.fact_long(spark, sf).withColumn("year", F.year("d")), _out(spark, "fact"), ["year"])
    return tidy(readers.read_mart(spark, path).select("channel_id", "d", "n_ev", "trit_day"))


@query("s6_verdict_csv", with_parts("""
SELECT concat_ws(';', id, created_at, scenario, coalesce(object_name, ''), coalesce(picket::VARCHAR, ''), coalesce(channel_id::VARCHAR, ''),
  printf('%.4f', probability), '24', status, title, least(since1, since2), coalesce(incubation_days::VARCHAR, ''), '"' || phrase1 || '; ' || phrase2 || '"',
  CASE WHEN blind THEN 'слепая зона' ELSE '' END, 'Осмотреть') AS value FROM q_titled
UNION ALL SELECT 'идентификатор;сформирован;сценарий;объект;пикет;канал;вероятность;горизонт_часов;статус;описание;первый_признак;вызревание_суток;улики;слепые_зоны;рекомендация'"""))
def s6(spark, sf):
    path = sinks.write_lines(sinks.verdict_csv(sample_cards(spark, sf)), _out(spark, "verdicts-csv"))
    return spark.read.option("lineSep", "\r\n").text(path)


@query("s7_verdict_xml", with_parts("""
SELECT id, scenario, title, phrase1 || '|' || phrase2 AS evidence, CASE WHEN blind THEN 1 ELSE 0 END::BIGINT AS n_blind, 3 AS n_marks,
       (SELECT count(*) FROM q_titled) AS total FROM q_titled"""))
def s7(spark, sf):
    path = sinks.write_xml(sample_cards(spark, sf), _out(spark, "verdicts-xml"), "gzip")
    shape = ("_id long, scenario string, title string, evidence struct<item:array<struct<_VALUE:string,_feature:string>>>, "
             "blind_spots struct<item:array<string>>, timeline struct<mark:array<struct<_VALUE:string,_at:string>>>")
    lines = spark.read.text(path)
    total = lines.agg(F.max(F.regexp_extract("value", r'<verdicts count="(\d+)">', 1).try_cast("long")).alias("total"))
    back = with_row(lines.filter(F.col("value").startswith("<verdict ")).select(F.from_xml("value", shape).alias("v")), total)
    return tidy(back.select("v.*", "total").select("total", F.col("_id").alias("id"), "scenario", "title",
                            F.transform("evidence.item", lambda e: e["_VALUE"]).alias("evidence"),
                            F.coalesce(F.size("blind_spots.item"), F.lit(0)).alias("n_blind"),
                            F.size("timeline.mark").alias("n_marks")))


SHAPES = """
SELECT 'collector' AS kind, a.name AS object_name, NULL::BIGINT AS picket, NULL::VARCHAR AS scenario, lo AS picket_min,
       round(m.p + 1e-9, 4) AS probability, round(lon1 + 1e-9, 5) AS lon, round(lat1 + 1e-9, 5) AS lat
FROM q_axis a JOIN (SELECT object_name, max(probability) AS p FROM q_net_cards GROUP BY object_name) m ON m.object_name = a.name
UNION ALL
SELECT 'verdict', c.object_name, picket, scenario, NULL, round(probability + 1e-9, 4), round(lon1 + (lon2 - lon1) * t + 1e-9, 5),
       round(lat1 + (lat2 - lat1) * t + 1e-9, 5)
FROM (SELECT c.*, a.*, CASE WHEN hi = lo THEN 0 ELSE (picket - lo) / (hi - lo) END AS t
      FROM q_net_cards c JOIN q_axis a ON a.name = c.object_name WHERE picket IS NOT NULL) c
"""


def _rounded(c, digits):
    return F.round(c.cast("double") + 1e-9, digits)


@query("s8_geojson_features", with_parts(f"SELECT * FROM ({SHAPES})"))
def s8(spark, sf):
    """The written feature collection, parsed from its lines: head, features, tail."""
    shapes, points = _map(spark, sf)
    path = sinks.write_geojson(shapes, points, _out(spark, "geojson"))
    kind = ("struct<geometry:struct<type:string,coordinates:string>,properties:struct<kind:string,object_name:string,picket:bigint,"
            "scenario:string,picket_min:bigint,probability:double,max_probability:double>>")
    line = F.when(F.col("value").startswith(sinks.COLLECTION), F.substring("value", F.lit(len(sinks.COLLECTION) + 1), F.length("value"))) \
        .otherwise(F.ltrim("value", F.lit(",")))
    f = spark.read.text(path).filter("value <> ']}'").select(F.from_json(line, kind).alias("f"))
    at = F.from_json(F.when(F.col("f.geometry.type") == "Point", F.concat(F.lit("["), "f.geometry.coordinates", F.lit("]")))
                     .otherwise(F.col("f.geometry.coordinates")), "array<array<double>>")
    p = F.col("f.properties")
    return f.withColumn("at", at).select(
        p["kind"].alias("kind"), p["object_name"].alias("object_name"), p["picket"].alias("picket"), p["scenario"].alias("scenario"),
        p["picket_min"].alias("picket_min"), _rounded(F.coalesce(p["probability"], p["max_probability"]), 4).alias("probability"),
        _rounded(F.col("at")[0][0], 5).alias("lon"), _rounded(F.col("at")[0][1], 5).alias("lat"))


@query("s9_wkt_table", with_parts(f"SELECT * EXCLUDE (picket_min) FROM ({SHAPES.replace('1e-9, 5)', '1e-9, 4)')})"))
def s9(spark, sf):
    """The written table read back: shapes parsed from their text."""
    shapes, points = _map(spark, sf)
    path = sinks.write_lines(sinks.wkt_csv(shapes, points), _out(spark, "wkt"))
    rows = spark.read.option("lineSep", "\r\n").text(path).filter(~F.col("value").endswith("wkt;kind;object_name;picket;scenario;probability")).select(
        F.from_csv("value", F.lit("wkt string, kind string, object_name string, picket string, scenario string, probability double"),
                   {"sep": ";", "escape": '"', "mode": "FAILFAST"}).alias("r")).select("r.*")
    number = lambda i: F.regexp_extract("wkt", r"\((-?[\d.]+) (-?[\d.]+)", i)
    return rows.select("kind", "object_name", F.nullif("picket", F.lit("")).cast("long").alias("picket"),
                       F.nullif("scenario", F.lit("")).alias("scenario"), _rounded(F.col("probability"), 4).alias("probability"),
                       _rounded(number(1), 4).alias("lon"), _rounded(number(2), 4).alias("lat"))


@query("s4_contract_csv", with_parts("""
SELECT meaning_ AS cls, CAST(trit AS BIGINT) AS trit, count(*) AS n FROM q_classed GROUP BY meaning_, trit"""))
def s4(spark, sf):
    """The contract written as CSV with placeholder and repeated rows, read back, and the journal classified with it."""
    listed = samples.contract(spark)
    noted = (listed.union(listed.filter(F.col("cls") == fv.FAULT))
             .union(listed.select("sensor_type", F.lit(fv.CONTRACT_PLACEHOLDERS[0]).alias("raw_value"), F.lit(fv.NUMERIC)).distinct()))
    titles = {v: k for k, v in readers.CONTRACT_COLUMNS.items()}
    src = _out(spark, "contract-csv")
    noted.select(*[F.col(c).alias(titles[c]) for c in ("sensor_type", "raw_value", "cls")]).write.option(
        "header", True).option("escape", '"').csv(src)
    classed = contract.classify(samples.journal(spark, sf), samples.channels(spark, sf), readers.read_contract(spark, src))
    return tidy(classed.groupBy("cls", "trit").agg(F.count(F.lit(1)).alias("n")))


@query("s10_verdict_json", with_parts("SELECT id, scenario, title, round(probability + 1e-9, 6) AS probability FROM q_titled"))
def s10(spark, sf):
    path = sinks.write_json(sample_cards(spark, sf), _out(spark, "verdicts-json"), "gzip")
    back = spark.read.schema("id long, scenario string, title string, probability double").json(path)
    return tidy(back)
