"""Queries over the pumping, fire, intrusion, thermal and calendar scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tritmarts.operators import calendar, domains, fire, intrusion, pumps, thermal, verdicts
from tritmarts.plans import catalog_marts, samples  # noqa: F401  catalog_marts holds shared oracle parts
from tritmarts.plans.oracle_parts import part, with_parts
from tritmarts.plans.registry import query, tidy
from tritmarts.plans.store import stored
from tritmarts.settings import Guarding, Pumping, Smoke

PUMPING = Pumping(z_threshold=1.0, min_starts=1, min_excess=0, min_ratio=1.2, network_hot_min=3)
SMOKE = Smoke(sweep_share=0.06, sweep_min_pickets=2, window_minutes=240)
GUARDING = Guarding(stuck_min_switches=45, max_hours=4.0)
CAL = ("2023-12-01", "2026-12-31")


class Network:
    """The short sample and its scenario marts."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.journal = samples.journal(spark, sf)

    def _stored(self, name, build):
        return stored(self.spark, self.sf, name, build)

    @property
    def dim(self):
        return samples.dim(self.spark, self.sf)

    @property
    def domains(self):
        return self._stored("domains", lambda: domains.logical_domains(self.dim))

    @property
    def pump_day(self):
        return self._stored("pump_day", lambda: pumps.pump_day(self.journal, self.dim))

    @property
    def pump_baseline(self):
        return self._stored("pump_baseline", lambda: pumps.pump_baseline(self.pump_day))

    @property
    def pump_anomaly(self):
        return self._stored("pump_anomaly", lambda: pumps.pump_anomaly(self.pump_day, self.pump_baseline, PUMPING))

    @property
    def smoke(self):
        return self._stored("smoke", lambda: fire.smoke_events(self.journal, self.dim, SMOKE))

    @property
    def candidates(self):
        return self._stored("fire_candidate", lambda: fire.fire_candidates(
            self.smoke, fire.heat_events(self.journal, self.dim, SMOKE), self.domains, SMOKE))

    @property
    def intervals(self):
        return self._stored("armed_interval", lambda: intrusion.armed_intervals(self.journal, self.dim))

    @property
    def health(self):
        return self._stored("guard_health", lambda: intrusion.guard_health(self.intervals, GUARDING))

    @property
    def episodes(self):
        return self._stored("intrusion_event", lambda: intrusion.intrusion_events(
            self.journal, self.dim, self.intervals, self.health, GUARDING))

    @property
    def calendar(self):
        return self._stored("calendar", lambda: calendar.calendar_dim(self.spark, *CAL))


class Heat:
    """Thermal marts of the long sample."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @property
    def days(self):
        return stored(self.spark, self.sf, "temp_day", lambda: thermal.temperature_day(
            samples.fact_long(self.spark, self.sf), samples.dim_long(self.spark, self.sf)))

    @property
    def state(self):
        return stored(self.spark, self.sf, "temp_state", lambda: thermal.temperature_state(
            self.days, thermal.monthly_norm(self.days), thermal.neighbour_norm(self.days)))


def flat_evidence(df):
    """Verdict rows with their lists as text, one shape for both engines."""
    items = F.transform("evidence", lambda e: F.concat_ws("~", e["feature"], e["phrase"], e["since"]))
    return tidy(df.select("scenario", "d", "object_id", "object_name", "picket", "channel_id", "probability",
                          "location", F.array_join(items, "|").alias("evidence"), "negatives", "blind_spots",
                          "recommendation", "sensor_name", "episode_at"))


# ---- pumping ------------------------------------------------------------------

part("q_pump_seq", """
SELECT channel_id, d, t_sec, raw_value, lag(raw_value) OVER o AS was, lag(d) OVER o AS was_d, lag(t_sec) OVER o AS was_t
FROM q_journal WHERE channel_id IN (SELECT channel_id FROM q_channels WHERE sensor_type = 'Состояние насоса')
WINDOW o AS (PARTITION BY channel_id ORDER BY d, t_sec, event_id)
""")
part("q_pump_day", """
SELECT channel_id, d, sum(up)::BIGINT AS n_starts, min(CASE WHEN up = 1 THEN t_sec END) AS t_first_start,
       max(CASE WHEN up = 1 THEN t_sec END) AS t_last_start, sum(down)::BIGINT AS n_stops,
       coalesce(sum(CASE WHEN down = 1 AND was_d = d THEN t_sec - was_t END), 0)::BIGINT AS duty_seconds, count(*) AS n_ev
FROM (SELECT *, CASE WHEN was = 'Выключен' AND raw_value = 'Включен' THEN 1 ELSE 0 END AS up,
             CASE WHEN was = 'Включен' AND raw_value = 'Выключен' THEN 1 ELSE 0 END AS down FROM q_pump_seq)
GROUP BY channel_id, d
""")
part("q_pump_base", """
SELECT channel_id, mon, any_value(m) AS med_starts, quantile_cont(n_starts, 0.95) AS p95_starts,
       median(duty_seconds) AS med_duty, count(*) AS n_days, median(abs(n_starts - m)) AS mad_starts
FROM (SELECT *, month(d) AS mon, median(n_starts) OVER (PARTITION BY channel_id, month(d)) AS m
      FROM q_pump_day WHERE n_starts > 0)
GROUP BY channel_id, mon
""")
part("q_pump_anom", """
SELECT p.channel_id, p.d, p.n_starts, p.duty_seconds, b.med_starts, b.p95_starts,
       (p.n_starts - b.med_starts) / (1.4826 * nullif(b.mad_starts, 0)) AS robust_z,
       p.n_starts / nullif(b.med_starts, 0) AS ratio_to_norm,
       CASE WHEN coalesce(b.n_days, 0) < 5 THEN 0
            WHEN p.n_starts < 1 OR p.n_starts < b.med_starts OR p.n_starts < 1.2 * b.med_starts THEN -1
            WHEN b.mad_starts = 0 AND p.n_starts > b.p95_starts THEN 1
            WHEN b.mad_starts > 0 AND (p.n_starts - b.med_starts) / (1.4826 * b.mad_starts) >= 1.0 THEN 1
            ELSE -1 END AS trit
FROM q_pump_day p LEFT JOIN q_pump_base b ON b.channel_id = p.channel_id AND b.mon = month(p.d)
""")
part("q_pump_net", """
SELECT d, count(*) FILTER (WHERE trit = 1) AS n_hot, count(DISTINCT channel_id) AS n_active,
       count(*) FILTER (WHERE trit = 1) > 2 AS is_network_event FROM q_pump_anom GROUP BY d
""")


@query("p1_pump_day", with_parts("SELECT * FROM q_pump_day"))
def p1(spark, sf):
    n = Network(spark, sf)
    return tidy(pumps.pump_day(n.journal, n.dim))


@query("p2_pump_baseline", with_parts("""
SELECT channel_id, mon, round(med_starts + 1e-9, 6) AS med_starts, round(p95_starts + 1e-9, 6) AS p95_starts,
       round(med_duty + 1e-9, 6) AS med_duty, n_days, round(mad_starts + 1e-9, 6) AS mad_starts FROM q_pump_base"""))
def p2(spark, sf):
    return tidy(pumps.pump_baseline(Network(spark, sf).pump_day))


@query("p3_pump_anomaly", with_parts("""
SELECT channel_id, d, n_starts, duty_seconds, round(med_starts + 1e-9, 6) AS med_starts,
       round(p95_starts + 1e-9, 6) AS p95_starts, round(robust_z + 1e-9, 6) AS robust_z,
       round(ratio_to_norm + 1e-9, 6) AS ratio_to_norm, trit::BIGINT AS trit FROM q_pump_anom"""))
def p3(spark, sf):
    n = Network(spark, sf)
    return tidy(pumps.pump_anomaly(n.pump_day, n.pump_baseline, PUMPING))


@query("p4_network_days", with_parts("SELECT * FROM q_pump_net"))
def p4(spark, sf):
    return tidy(pumps.network_days(Network(spark, sf).pump_anomaly, PUMPING))


@query("p5_upstream_neighbours", with_parts("""
SELECT h.d, h.object_id, h.picket AS probe_picket, c.picket, a.channel_id, c.sensor_name, a.n_starts,
       round(a.med_starts + 1e-9, 6) AS med_starts, a.trit::BIGINT AS trit
FROM (SELECT DISTINCT d, object_id, picket FROM q_pump_anom JOIN q_dim USING (channel_id) WHERE trit = 1 AND picket > 0) h
JOIN q_dim c ON c.object_id = h.object_id AND c.picket BETWEEN h.picket - 30 AND h.picket + 30
JOIN q_pump_anom a ON a.channel_id = c.channel_id AND a.d = h.d"""))
def p5(spark, sf):
    n = Network(spark, sf)
    hot = (n.pump_anomaly.filter("trit = 1").join(n.dim, "channel_id").filter("picket IS NOT NULL")
           .select("d", "object_id", "picket"))
    return tidy(pumps.upstream_neighbours(n.pump_anomaly, n.dim, hot, PUMPING))


CLOCK = "printf('%02d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60)"
ISO = "CAST(d AS VARCHAR) || 'T' || " + CLOCK


def forms(v: str, one: str, few: str, many: str) -> str:
    return (f"CASE WHEN {v} % 100 BETWEEN 11 AND 14 THEN '{many}' WHEN {v} % 10 = 1 THEN '{one}' "
            f"WHEN {v} % 10 IN (2, 3, 4) THEN '{few}' ELSE '{many}' END")


part("q_pump_cards", f"""
SELECT 'подтопление' AS scenario, d, object_id, coalesce(parent_name, object_name) AS object_name, picket, channel_id,
  round(least(0.95, 0.25 + 0.12 * least(coalesce(ratio_to_norm, 1), 6) + 0.004 * least(n_starts - coalesce(med_starts, 0), 50)) + 1e-9, 6) AS probability,
  concat_ws(', ', coalesce(parent_name, object_name), 'ПК' || picket) AS location,
  concat_ws('|',
    'pump_starts~' || sensor_name || ': ' || n_starts || ' ' || {forms('n_starts', 'пуск', 'пуска', 'пусков')} || ' за сутки'
      || CASE WHEN med_starts > 0 THEN ' против нормы ' || CAST(round_even(med_starts, 0) AS BIGINT) ELSE ', личной нормы ещё нет' END || '~' || f,
    CASE WHEN f <> l THEN 'pump_window~откачка шла с ' || substr(f, 12) || ' до ' || substr(l, 12) || '~' || f END,
    CASE WHEN ratio_to_norm >= 1.5 THEN 'ratio~это в ' || rr || ' ' || {forms('rr', 'раз', 'раза', 'раз')} || ' выше личной нормы насоса~' || f END,
    CASE WHEN duty_seconds > 0 THEN 'duty~наработка за сутки ' || CAST(round_even(duty_seconds / 60, 0) AS BIGINT) || ' минут~' || f END) AS evidence,
  CASE WHEN is_network_event THEN 'локальная течь: аномалия видна сразу на ' || n_hot || ' насосах сети — это общий водоприток'
       ELSE 'общесетевой водоприток: кроме этого насоса аномальны лишь ' || (n_hot - 1) END AS negatives,
  CASE WHEN is_network_event THEN 'источник воды может быть выше по трассе: уклон коллектора в данных не задан'
       ELSE 'датчики затопления в сети не дают сигнала — вода детектируется косвенно, по режиму откачки' END AS blind_spots,
  'Осмотреть приямок и решётки, проверить работу насоса и уровень притока. При общесетевом водопритоке локальный ремонт не даст эффекта.' AS recommendation,
  sensor_name, f AS episode_at
FROM (SELECT a.*, dm.object_id, dm.object_name, dm.parent_name, dm.picket, dm.sensor_name, n.n_hot, n.is_network_event,
             CAST(round_even(a.ratio_to_norm, 0) AS BIGINT) AS rr,
             CAST(a.d AS VARCHAR) || 'T' || {CLOCK.format('p.t_first_start')} AS f,
             CAST(a.d AS VARCHAR) || 'T' || {CLOCK.format('p.t_last_start')} AS l,
             row_number() OVER (PARTITION BY a.d ORDER BY a.robust_z DESC NULLS LAST, a.channel_id) AS place
      FROM q_pump_anom a JOIN q_pump_day p USING (channel_id, d) JOIN q_dim dm USING (channel_id)
      JOIN q_pump_net n ON n.d = a.d WHERE a.trit = 1)
WHERE place <= 50
""")


@query("p6_pump_verdicts", with_parts("SELECT * FROM q_pump_cards"))
def p6(spark, sf):
    n = Network(spark, sf)
    return flat_evidence(verdicts.pump_verdicts(n.pump_anomaly, n.pump_day,
                                                pumps.network_days(n.pump_anomaly, PUMPING), n.dim))


# ---- smoke and fire -------------------------------------------------------------

part("q_smoke", """
SELECT e.channel_id, e.d, e.t_sec, object_id, picket, e.tag_base, sensor_name, n_fired, n_pickets, n_smoke_total,
       n_fired / n_smoke_total AS base_share, n_fired / n_smoke_total >= 0.06 AND n_pickets >= 2 AS is_sweep
FROM (SELECT * FROM q_journal JOIN q_dim USING (channel_id)
      WHERE sensor_type = 'Датчик дыма' AND raw_value = 'Обнаружен дым') e
JOIN (SELECT tag_base, d, count(DISTINCT channel_id) AS n_fired, count(DISTINCT picket) AS n_pickets
      FROM q_journal JOIN q_dim USING (channel_id)
      WHERE sensor_type = 'Датчик дыма' AND raw_value = 'Обнаружен дым' GROUP BY tag_base, d) USING (tag_base, d)
JOIN (SELECT tag_base, count(*) AS n_smoke_total FROM q_dim WHERE sensor_type = 'Датчик дыма' GROUP BY tag_base) USING (tag_base)
""")
part("q_heat", """
SELECT channel_id, d, t_sec, object_id, picket, sensor_type, sensor_name, raw_value, TRY_CAST(raw_value AS DOUBLE) AS num_value
FROM q_journal JOIN q_dim USING (channel_id)
WHERE sensor_type IN ('Тепловой датчик', 'Датчик температуры')
  AND (raw_value = 'Не замкнут' OR TRY_CAST(raw_value AS DOUBLE) >= 40)
""")
part("q_cand", """
SELECT s.*, coalesce(n_heat_ev, 0) AS n_heat_ev, g.has_thermal, g.n_channels AS domain_size,
       CASE WHEN g.has_thermal IS NOT TRUE THEN 0 WHEN abs(heat_t - first_t) <= 14400 THEN 1 ELSE -1 END AS confirm_trit
FROM (SELECT object_id, picket, d, count(DISTINCT channel_id) AS n_smoke_ch, count(*) AS n_smoke_ev, min(t_sec) AS first_t,
             max(t_sec) AS last_t, bool_or(is_sweep) AS is_sweep, max(base_share) AS base_share, min(sensor_name) AS sample_name
      FROM q_smoke WHERE picket IS NOT NULL GROUP BY object_id, picket, d) s
LEFT JOIN (SELECT object_id, picket, d, count(*) AS n_heat_ev, min(t_sec) AS heat_t FROM q_heat GROUP BY object_id, picket, d)
  USING (object_id, picket, d)
LEFT JOIN q_domain g ON g.object_id = s.object_id AND g.picket = s.picket
""")


@query("h1_smoke_events", with_parts("""
SELECT channel_id, d, t_sec, object_id, picket, tag_base, sensor_name, n_fired::BIGINT AS n_fired, n_pickets, n_smoke_total,
       round(base_share + 1e-9, 6) AS base_share, is_sweep FROM q_smoke"""))
def h1(spark, sf):
    n = Network(spark, sf)
    return tidy(fire.smoke_events(n.journal, n.dim, SMOKE))


@query("h2_heat_events", with_parts("""
SELECT channel_id, d, t_sec, object_id, picket, sensor_type, sensor_name, raw_value,
       round(num_value + 1e-9, 6) AS num_value FROM q_heat"""))
def h2(spark, sf):
    n = Network(spark, sf)
    return tidy(fire.heat_events(n.journal, n.dim, SMOKE))


@query("h3_fire_candidates", with_parts("""
SELECT object_id, picket, d, n_smoke_ch, n_smoke_ev::BIGINT AS n_smoke_ev, first_t, last_t, is_sweep,
       round(base_share + 1e-9, 6) AS base_share, sample_name, n_heat_ev, has_thermal, domain_size,
       confirm_trit::BIGINT AS confirm_trit FROM q_cand"""))
def h3(spark, sf):
    n = Network(spark, sf)
    return tidy(fire.fire_candidates(n.smoke, fire.heat_events(n.journal, n.dim, SMOKE), n.domains, SMOKE))


part("q_fire_scored", """
SELECT *, CASE WHEN is_sweep THEN 0 ELSE greatest(0, least(1, CASE WHEN n_smoke_ch > 2 THEN 0.45 WHEN n_smoke_ch = 2 THEN 0.3 ELSE 0.1 END
            + CASE confirm_trit WHEN 1 THEN 0.4 WHEN -1 THEN -0.15 ELSE 0 END + CASE WHEN n_smoke_ev > 9 THEN 0.1 ELSE 0 END)) END::DOUBLE AS score,
  CASE WHEN is_sweep THEN ['сработало ' || CAST(round_even(base_share * 100, 0) AS BIGINT) || '% дымовых датчиков контроллера — это регламентная проверка, пожар так не выглядит']
  ELSE list_filter([
    CASE WHEN n_smoke_ch = 1 THEN 'сработал один дымовой датчик' WHEN n_smoke_ch = 2 THEN 'в одной точке сработали два независимых дымовых датчика'
         ELSE 'в одной точке сработало ' || n_smoke_ch || ' ' || CASE WHEN n_smoke_ch IN (3, 4) THEN 'независимых дымовых датчика' ELSE 'независимых дымовых датчиков' END END,
    CASE confirm_trit WHEN 1 THEN 'подтверждено термическим датчиком в том же пикете' WHEN -1 THEN 'термический датчик в этой точке сработку не подтвердил' END,
    CASE WHEN n_smoke_ev > 9 THEN 'сработок за сутки: ' || n_smoke_ev || ' — устойчивое задымление' END], lambda w: w IS NOT NULL) END AS why
FROM q_cand
""")


@query("h4_fire_scores", with_parts("""
SELECT object_id, picket, d, round(score + 1e-9, 6) AS score, array_to_string(why, '|') AS reasons FROM q_fire_scored"""))
def h4(spark, sf):
    score, reasons = fire.fire_score()
    return tidy(Network(spark, sf).candidates.select("object_id", "picket", "d", score.alias("score"),
                                                     reasons.alias("reasons")))


part("q_place", """
SELECT object_id, coalesce(min(parent_name), min(object_name)) AS place_name FROM q_dim GROUP BY object_id
""")
SPAN = """CASE WHEN last_t - first_t < 60 THEN (last_t - first_t) || ' с'
  WHEN last_t - first_t < 3600 THEN CAST(round_even((last_t - first_t) / 60, 0) AS BIGINT) || ' мин'
  ELSE printf('%.1f', (last_t - first_t) / 3600) || ' ч' END"""
EPISODE = (f"CASE WHEN first_t <> last_t THEN 'episode_span~эпизод длился ' || {SPAN} || ': с ' || "
           f"{CLOCK.format('first_t')} || ' до ' || {CLOCK.format('last_t')} || '~' || {ISO.format('first_t')} END")


part("q_fire_cards", f"""
SELECT 'пожар' AS scenario, d, object_id, place_name AS object_name, picket, CAST(NULL AS BIGINT) AS channel_id,
  round(score + 1e-9, 6) AS probability, place_name || ', ПК' || picket AS location,
  concat_ws('|', array_to_string(list_transform(why, lambda w: 'fire~' || w), '|'), {EPISODE}) AS evidence,
  'регламентная проверка: сработала лишь часть датчиков контроллера' AS negatives,
  CASE WHEN confirm_trit = 0 THEN 'тепловых датчиков в этой точке нет — подтвердить задымление нечем; это не значит, что температура в норме' ELSE '' END AS blind_spots,
  'Направить бригаду для визуального осмотра участка. При отсутствии термоконтроля полагаться только на осмотр.' AS recommendation,
  sample_name AS sensor_name, {ISO.format('first_t')} AS episode_at
FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, object_id, picket) AS place
      FROM q_fire_scored JOIN q_place USING (object_id) WHERE score > 0)
WHERE place <= 20
""")


@query("h5_fire_verdicts", with_parts("SELECT * FROM q_fire_cards"))
def h5(spark, sf):
    n = Network(spark, sf)
    return flat_evidence(verdicts.fire_verdicts(n.candidates, n.dim))


# ---- intrusion -----------------------------------------------------------------

part("q_armed", """
SELECT object_id, channel_id, now_s AS t_from, next_s AS t_to, raw_value = 'На охране' AS is_armed
FROM (SELECT object_id, channel_id, raw_value, datediff('day', DATE '1970-01-01', d) * 86400 + t_sec AS now_s,
             lead(datediff('day', DATE '1970-01-01', d) * 86400 + t_sec) OVER (PARTITION BY channel_id ORDER BY d, t_sec, event_id) AS next_s
      FROM q_journal JOIN q_channels USING (channel_id)
      WHERE sensor_type = 'Состояние охраны' AND raw_value IN ('На охране', 'Снято с охраны'))
WHERE next_s IS NOT NULL
""")
part("q_health", """
SELECT *, armed_sec / nullif(total_sec, 0) AS armed_share,
       armed_sec / nullif(total_sec, 0) >= 0.98 OR n_switches < 45 AS is_stuck
FROM (SELECT object_id, channel_id, count(*) AS n_switches, CAST(sum((t_to - t_from) * is_armed::INT) AS BIGINT) AS armed_sec,
             CAST(sum(t_to - t_from) AS BIGINT) AS total_sec FROM q_armed GROUP BY object_id, channel_id)
""")
part("q_perimeter", """
SELECT *, datediff('day', DATE '1970-01-01', d) * 86400 + t_sec AS ts
FROM q_journal JOIN q_dim USING (channel_id)
WHERE sensor_type IN ('Датчик движения', 'КД Дверь', 'КД Люк') AND raw_value IN ('Обнаружено движение', 'Не замкнут')
  AND picket IS NOT NULL
""")
part("q_moded", """
SELECT p.*, CASE WHEN a.is_armed IS NULL OR h.is_stuck THEN 0 WHEN a.is_armed THEN 1 ELSE -1 END AS mode,
       coalesce(h.is_stuck, false) AS stuck
FROM q_perimeter p LEFT JOIN q_armed a ON a.object_id = p.object_id AND p.ts >= a.t_from AND p.ts < a.t_to
LEFT JOIN q_health h ON h.channel_id = a.channel_id
""")
EPISODES = """
SELECT object_id, object_name, parent_name, picket, d, min(t_sec) AS first_t, max(t_sec) AS last_t, count(*) AS n_triggers,
       count(DISTINCT channel_id) AS n_channels, string_agg(DISTINCT sensor_type, '|' ORDER BY sensor_type) AS types,
       min(sensor_name) AS sample_name, max(mode)::BIGINT AS armed_trit, bool_or(stuck) AS guard_unreliable,
       count(DISTINCT sensor_type) AS n_types, min(t_sec) // 3600 AS min_hour, min(t_sec) // 3600 <= 5 AS is_night
FROM {src} GROUP BY object_id, object_name, parent_name, picket, d
"""
part("q_episodes", EPISODES.format(src="q_moded"))
part("q_moded_once", """
SELECT * EXCLUDE (mode, stuck), max(mode) AS mode, bool_or(stuck) AS stuck FROM q_moded GROUP BY ALL
""")


@query("h6_armed_intervals", with_parts("SELECT * FROM q_armed"))
def h6(spark, sf):
    n = Network(spark, sf)
    return tidy(intrusion.armed_intervals(n.journal, n.dim))


@query("h7_guard_health", with_parts("""
SELECT object_id, channel_id, n_switches, armed_sec, total_sec, round(armed_share + 1e-9, 6) AS armed_share, is_stuck
FROM q_health"""))
def h7(spark, sf):
    return tidy(intrusion.guard_health(Network(spark, sf).intervals, GUARDING))


@query("h8_intrusion_events", with_parts("SELECT * FROM q_episodes"))
def h8(spark, sf):
    n = Network(spark, sf)
    return tidy(intrusion.intrusion_events(n.journal, n.dim, n.intervals, n.health, GUARDING))


@query("h8_intrusion_events_one_mode", with_parts(EPISODES.format(src="q_moded_once")))
def h8_once(spark, sf):
    n = Network(spark, sf)
    return tidy(intrusion.intrusion_events(n.journal, n.dim, n.intervals, n.health, GUARDING, per_guard=False))


@query("h9_episode_hours", with_parts("""
SELECT object_id, picket, d, round((last_t - first_t) / 3600 + 1e-9, 6) AS hours FROM q_episodes"""))
def h9(spark, sf):
    return tidy(Network(spark, sf).episodes.select(
        "object_id", "picket", "d", intrusion.episode_hours(F.col("first_t"), F.col("last_t")).alias("hours")))


part("q_intr_scored", """
SELECT *, CASE WHEN last_t - first_t > 14400 OR n_triggers > 200 THEN 0 ELSE greatest(0, least(1,
    CASE WHEN n_types > 2 THEN 0.45 WHEN n_types = 2 THEN 0.3 ELSE 0.08 END + CASE armed_trit WHEN 1 THEN 0.35 WHEN -1 THEN -0.25 ELSE 0 END
    + CASE WHEN is_night THEN 0.2 ELSE 0 END + CASE WHEN n_triggers > 4 THEN 0.1 ELSE 0 END)) END::DOUBLE AS score,
  CASE WHEN last_t - first_t > 14400 THEN ['эпизод длился ' || printf('%.1f', (last_t - first_t) / 3600) || ' ч — для присутствия человека это неправдоподобно долго. Картина соответствует работе подрядчиков при не снятой охране либо залипшему датчику, а не проникновению']
       WHEN n_triggers > 200 THEN ['срабатываний за эпизод: ' || n_triggers || '. Для перемещения человека это неправдоподобно много — картина соответствует дребезгу шлейфа, а не проникновению; эпизод отнесён к отказам оборудования']
       ELSE list_filter([
    CASE n_types WHEN 1 THEN 'сработал один тип датчика (' || types || ')' WHEN 2 THEN 'сработали датчики двух разных типов подряд'
         ELSE 'сработали датчики ' || n_types || ' разных типов — последовательность похожа на перемещение человека' END,
    CASE armed_trit WHEN 1 THEN 'объект в этот момент был под охраной' WHEN -1 THEN 'объект был снят с охраны — вероятно, работа подрядчиков' END,
    CASE WHEN is_night THEN 'время срабатывания — 0' || min_hour || ' ч, присутствие людей в это время не регламентно' END,
    CASE WHEN n_triggers > 4 THEN 'срабатываний за эпизод: ' || n_triggers END], lambda w: w IS NOT NULL) END AS why
FROM q_episodes
""")


@query("h10_intrusion_scores", with_parts("""
SELECT object_id, picket, d, round(score + 1e-9, 6) AS score, array_to_string(why, '|') AS reasons FROM q_intr_scored"""))
def h10(spark, sf):
    score, reasons = intrusion.intrusion_score(GUARDING)
    return tidy(Network(spark, sf).episodes.select("object_id", "picket", "d", score.alias("score"),
                                                   reasons.alias("reasons")))


# ---- calendar --------------------------------------------------------------------

part("q_days", """
SELECT CAST(x AS DATE) AS d, h.name AS holiday, isodow(x) > 5 AS we, h.name IS NOT NULL OR isodow(x) > 5 AS off
FROM (SELECT unnest(generate_series(DATE '2023-10-01', DATE '2029-01-31', INTERVAL 1 DAY)) AS x)
LEFT JOIN (VALUES ('01-01','Новый год'),('01-02','Новогодние каникулы'),('01-03','Новогодние каникулы'),('01-04','Новогодние каникулы'),
  ('01-05','Новогодние каникулы'),('01-06','Новогодние каникулы'),('01-07','Рождество Христово'),('01-08','Новогодние каникулы'),
  ('02-23','День защитника Отечества'),('03-08','Международный женский день'),('05-01','Праздник Весны и Труда'),
  ('05-09','День Победы'),('06-12','День России'),('11-04','День народного единства')) AS h(md, name) ON h.md = strftime(x, '%m-%d')
""")
part("q_breaks", """
SELECT d, holiday, we, off, CASE WHEN off THEN datediff('day', prev_work, next_work) - 1 ELSE 0 END AS len
FROM (SELECT *, max(CASE WHEN NOT off THEN d END) OVER (ORDER BY d) AS prev_work,
             min(CASE WHEN NOT off THEN d END) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_work FROM q_days)
""")
part("q_calendar", """
SELECT b.d, b.holiday, b.we AS is_weekend, b.off AS is_nonworking, b.len AS break_length,
       (SELECT min(datediff('day', b.d, n.d)) FROM q_breaks n WHERE n.len > 2 AND n.d BETWEEN b.d AND b.d + 14) AS days_to_break,
       (SELECT min(n.d) FROM q_breaks n WHERE n.len > 2 AND n.d >= b.d) AS next_break
FROM q_breaks b WHERE b.d BETWEEN DATE '2023-12-01' AND DATE '2027-12-31'
""")
part("q_risk", """
SELECT c.*, nb.len AS next_break_length,
  CASE WHEN strftime(c.d, '%m-%d') = '05-09' THEN 1.35 WHEN holiday IS NOT NULL AND break_length > 2 THEN 1.3 WHEN holiday IS NOT NULL THEN 1.2
       WHEN is_weekend AND break_length > 2 THEN 1.15 WHEN is_weekend THEN 1.1 ELSE 1.0 END::DOUBLE AS multiplier,
  CASE WHEN strftime(c.d, '%m-%d') = '05-09' THEN 'День Победы — объекты без постоянного присмотра, бригад на линии меньше обычного'
       WHEN c.holiday IS NOT NULL AND break_length > 2 THEN c.holiday || ', ' || break_length || '-й день длинных выходных — присутствие персонала на объектах пониженное'
       WHEN c.holiday IS NOT NULL THEN c.holiday || ' — нерабочий день, персонала на объектах меньше'
       WHEN is_weekend AND break_length > 2 THEN 'длинные выходные (' || break_length || ' нерабочих дня подряд)'
       WHEN is_weekend THEN 'выходной день — плановых работ на объекте не ведётся'
       WHEN days_to_break IN (1, 2, 3) THEN 'через ' || days_to_break || ' сут начинаются длинные выходные — работы разумно закрыть до их начала' END AS note
FROM q_calendar c LEFT JOIN (SELECT d AS bd, len FROM q_breaks) nb ON nb.bd = c.next_break
""")
def _calendar_orders(spark, sf):
    """One requested due date per order: day shifted into the calendar's years."""
    o = samples.table(spark, sf, "orders")
    start = F.date_add(F.lit("2024-01-01").cast("date"),
                       F.pmod(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")), F.lit(1000)))
    return o.select(F.col("o_orderkey").alias("id"), start.alias("d"),
                    F.date_add(start, (F.col("o_custkey") % 121).cast("int")).alias("due"))


ORDER_DAYS = """
SELECT o_orderkey AS id, DATE '2024-01-01' + CAST(datediff('day', DATE '1995-01-01', o_orderdate) % 1000 AS INT) AS d,
       CAST(o_custkey % 121 AS INT) AS wait FROM orders"""


@query("k1_calendar", with_parts("""
SELECT d, holiday, is_weekend, is_nonworking, break_length::BIGINT AS break_length, days_to_break::BIGINT AS days_to_break, next_break,
       next_break_length::BIGINT AS next_break_length, multiplier, note, coalesce(n_orders, 0) AS n_orders
FROM q_risk LEFT JOIN (SELECT d, count(*) AS n_orders FROM (@ORDER_DAYS@) GROUP BY d) USING (d)
WHERE d BETWEEN (SELECT min(d) FROM (@ORDER_DAYS@)) AND (SELECT max(d + wait) FROM (@ORDER_DAYS@))""".replace("@ORDER_DAYS@", ORDER_DAYS)))
def k1(spark, sf):
    """Calendar from the first order's day to the last due date, with the orders of each day."""
    orders = _calendar_orders(spark, sf)
    per_day = orders.groupBy("d").agg(F.count(F.lit(1)).alias("n_orders"))
    return tidy(calendar.calendar_of(orders).join(per_day, "d", "left").na.fill(0, ["n_orders"]))


@query("k2_days_to_break", with_parts(f"""
SELECT id, days_to_break::BIGINT AS days_to_break FROM ({ORDER_DAYS}) JOIN q_risk USING (d)"""))
def k2(spark, sf):
    return tidy(_calendar_orders(spark, sf).join(Network(spark, sf).calendar, "d").select("id", "days_to_break"))


@query("k3_risk_factor", with_parts(f"""
SELECT multiplier, note, count(*) AS n FROM ({ORDER_DAYS}) JOIN q_risk USING (d) GROUP BY multiplier, note"""))
def k3(spark, sf):
    rows = _calendar_orders(spark, sf).join(Network(spark, sf).calendar, "d")
    return tidy(rows.groupBy("multiplier", "note").agg(F.count(F.lit(1)).alias("n")))


@query("k4_due_dates", with_parts(f"""
SELECT id, CASE WHEN next_break <= d + wait THEN greatest(d, next_break - 1) ELSE d + wait END AS due,
  CASE WHEN next_break <= d + wait THEN 'срок сдвинут на ' || strftime(next_break - 1, '%d.%m') || ': далее следуют '
       || next_break_length || ' нерабочих дня подряд' END AS calendar_note
FROM ({ORDER_DAYS}) JOIN q_risk USING (d)"""))
def k4(spark, sf):
    return calendar.adjust_due_dates(_calendar_orders(spark, sf), Network(spark, sf).calendar) \
        .select("id", "due", "calendar_note")


part("q_intr_raised", """
SELECT e.*, CASE WHEN multiplier > 1 THEN least(1, score * multiplier) ELSE score END AS risk,
       CASE WHEN multiplier > 1 THEN list_append(why, note) ELSE why END AS told
FROM q_intr_scored e JOIN q_risk USING (d) WHERE score >= 0.3
""")


part("q_intrusion_cards", f"""
SELECT 'проникновение' AS scenario, d, object_id, coalesce(parent_name, object_name) AS object_name, picket, CAST(NULL AS BIGINT) AS channel_id,
  round(risk + 1e-9, 6) AS probability, coalesce(parent_name, object_name) || ', ПК' || picket AS location,
  concat_ws('|', array_to_string(list_transform(told, lambda w: 'intrusion~' || w), '|'), {EPISODE}) AS evidence,
  CASE WHEN armed_trit = 1 THEN 'плановые работы: объект в этот момент был под охраной' ELSE '' END AS negatives,
  CASE WHEN armed_trit <> 0 THEN '' WHEN guard_unreliable THEN 'канал состояния охраны на объекте недостоверен (держит режим почти постоянно) — решение принято по времени суток и кратности, а не по режиму'
       ELSE 'канала состояния охраны на объекте нет — неизвестно, был ли он под охраной' END AS blind_spots,
  'Проверить целостность люков и дверей на участке, при подтверждении — вызвать группу реагирования.' AS recommendation,
  sample_name AS sensor_name, {ISO.format('first_t')} AS episode_at
FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY risk DESC, object_id, picket) AS place FROM q_intr_raised)
WHERE place <= 20
""")


@query("h11_intrusion_verdicts", with_parts("SELECT * FROM q_intrusion_cards"))
def h11(spark, sf):
    n = Network(spark, sf)
    return flat_evidence(verdicts.intrusion_verdicts(n.episodes, n.calendar, cfg=GUARDING))


# ---- thermal ---------------------------------------------------------------------

part("q_temp", """
SELECT object_id, picket, d, count(DISTINCT channel_id) AS n_channels, avg(num_avg) AS t_avg, min(num_min) AS t_min,
       max(num_max) AS t_max, max(t_last) AS last_seen
FROM q_fact_long JOIN q_dim_long USING (channel_id)
WHERE sensor_type = 'Датчик температуры' AND picket IS NOT NULL AND num_avg IS NOT NULL GROUP BY object_id, picket, d
""")
part("q_temp_near", """
SELECT t.*, (SELECT avg(o.t_avg) FROM q_temp o WHERE o.object_id = t.object_id AND o.d = t.d AND o.picket <> t.picket) AS t_neighbours
FROM q_temp t
""")
part("q_gap", """
SELECT object_id, picket, median(t_avg - t_neighbours) AS med_gap, count(*) AS n_days FROM q_temp_near
WHERE t_neighbours IS NOT NULL GROUP BY object_id, picket
""")
part("q_norm", """
SELECT object_id, picket, month(d) AS mon, median(t_avg) AS med_t, quantile_cont(t_avg, 0.1) AS p10_t, count(*) AS n_days
FROM q_temp GROUP BY object_id, picket, month(d)
""")
part("q_state", """
SELECT t.*, n.med_t, n.p10_t, n.n_days, g.med_gap, t_avg - med_t AS delta_norm, t_avg - t_neighbours AS delta_neighbours,
       t_avg - t_neighbours - med_gap AS excess_gap,
       CASE WHEN coalesce(n.n_days, 0) < 5 THEN 0
            WHEN t_min <= 3 OR round(med_t - t_avg, 9) >= 5 OR round(t_avg - t_neighbours - med_gap, 9) <= -4 THEN 1 ELSE -1 END AS trit
FROM q_temp_near t LEFT JOIN q_norm n ON n.object_id = t.object_id AND n.picket = t.picket AND n.mon = month(t.d)
LEFT JOIN q_gap g ON g.object_id = t.object_id AND g.picket = t.picket
""")


@query("t1_temperature_day", with_parts("""
SELECT object_id, picket, d, n_channels, round(t_avg + 1e-9, 6) AS t_avg, t_min, t_max, last_seen FROM q_temp"""))
def t1(spark, sf):
    return tidy(thermal.temperature_day(samples.fact_long(spark, sf), samples.dim_long(spark, sf)))


@query("t2_neighbour_norm", with_parts("""
SELECT object_id, picket, round(med_gap + 1e-9, 6) AS med_gap, n_days FROM q_gap"""))
def t2(spark, sf):
    return tidy(thermal.neighbour_norm(Heat(spark, sf).days))


@query("t3_monthly_norm", with_parts("""
SELECT object_id, picket, mon, round(med_t + 1e-9, 6) AS med_t, round(p10_t + 1e-9, 6) AS p10_t, n_days FROM q_norm"""))
def t3(spark, sf):
    return tidy(thermal.monthly_norm(Heat(spark, sf).days))


@query("t4_temperature_state", with_parts("""
SELECT object_id, picket, d, round(t_neighbours + 1e-9, 6) AS t_neighbours, round(delta_norm + 1e-9, 6) AS delta_norm,
       round(delta_neighbours + 1e-9, 6) AS delta_neighbours, round(excess_gap + 1e-9, 6) AS excess_gap, trit::BIGINT AS trit
FROM q_state"""))
def t4(spark, sf):
    d = Heat(spark, sf).days
    out = thermal.temperature_state(d, thermal.monthly_norm(d), thermal.neighbour_norm(d))
    return tidy(out.select("object_id", "picket", "d", "t_neighbours", "delta_norm", "delta_neighbours", "excess_gap", "trit"))


part("q_thermal_text", """
SELECT *, list_filter([
   CASE WHEN round(delta_norm, 9) <= -5 THEN 'температура ' || CAST(round_even(t_avg, 0) AS BIGINT) || ' °C — на ' || CAST(round_even(abs(delta_norm), 0) AS BIGINT) || ' ниже обычной для этой точки в этом месяце' END,
   CASE WHEN t_min <= 3 THEN 'минимум за сутки ' || CAST(round_even(t_min, 0) AS BIGINT) || ' °C — угроза подмораживания трубопроводов холодной воды'
        WHEN t_min <= 6 THEN 'минимум за сутки ' || CAST(round_even(t_min, 0) AS BIGINT) || ' °C — приближение к порогу подмораживания' END,
   CASE WHEN round(excess_gap, 9) <= -4 THEN 'на ' || CAST(round_even(round(abs(excess_gap), 9), 0) AS BIGINT) || ' °C холоднее соседних точек, чем обычно для этого места, — похоже на поступление наружного воздуха, а не на общее похолодание' END
  ], lambda w: w IS NOT NULL) AS said,
  CASE WHEN n_channels = 1 THEN 'температура измеряется одним датчиком — перепроверить показание нечем' ELSE '' END AS blind
FROM q_state
""")


@query("t5_thermal_phrases", with_parts("""
SELECT object_id, picket, d, array_to_string(said, '|') AS phrases, blind AS blind_spots FROM q_thermal_text"""))
def t5(spark, sf):
    return tidy(Heat(spark, sf).state.select("object_id", "picket", "d", thermal.thermal_phrases().alias("phrases"),
                                             thermal.thermal_blind_spots().alias("blind_spots")))
