"""Queries over labels, features, ranking metrics and the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.attach import with_row
from tritmarts.operators import controls, domains, explain, features, labels, marts, ranker, scores
from tritmarts.plans import catalog_marts, samples  # noqa: F401  catalog_marts holds shared oracle parts
from tritmarts.plans.oracle_parts import part, with_parts
from tritmarts.plans.registry import query, tidy
from tritmarts.plans.store import is_stored, settings_digest, stored
from tritmarts.settings import Labelling, Modelling
from tritmarts.sources.literal import inline_table

CFG = Labelling(sweep_min_channels=4, sweep_min_share=0.2,
                artifact_periods=(("1996-03-01", "1996-04-10"),),
                blackout_days=("1997-05-05", "1997-05-06"))
CFG72 = Labelling(horizon_hours=72, sweep_min_channels=4, sweep_min_share=0.2,
                  artifact_periods=CFG.artifact_periods, blackout_days=CFG.blackout_days)
FIT = Modelling(train_from="1997-01-01", train_to="1999-12-31", test_from="2000-01-01", test_to="2001-12-31",
                negatives_per_positive=2, test_days=731.0)


class World:
    """The long sample and the marts derived from it, each written on first use."""

    def __init__(self, spark, sf, cfg: Labelling = CFG):
        self.spark, self.sf, self.cfg = spark, sf, cfg

    def name(self, mart):
        """A mart is kept by its name and the settings it was built with."""
        return f"{mart}-{settings_digest(self.cfg)}"

    def _stored(self, name, build):
        return stored(self.spark, self.sf, self.name(name), build)

    @property
    def dim(self):
        return samples.dim_long(self.spark, self.sf)

    @property
    def fact(self):
        return samples.fact_long(self.spark, self.sf)

    @property
    def profile(self):
        return self._stored("profile_long", lambda: marts.channel_profile(self.fact))

    @property
    def domains(self):
        return self._stored("domains_long", lambda: domains.logical_domains(self.dim))

    @property
    def sweeps(self):
        return self._stored("sweeps_long", lambda: labels.sweep_days(self.fact, self.dim, self.cfg))

    @property
    def grid(self):
        return labels.grid(self.dim, self.profile, self.cfg)

    @property
    def labels(self):
        return self._stored("labels", lambda: labels.labels(
            self.grid, self.fact, self.dim, self.sweeps, self.cfg))

    @property
    def ahead(self):
        return self._stored("days_to_failure", lambda: labels.days_to_failure(self.grid, self.fact, self.dim, self.sweeps))

    @property
    def matrix(self):
        """The feature matrix for one reading: the mart where it is written, else only the columns that are read get computed."""
        if is_stored(self.spark, self.sf, self.name("features")):
            return self.features
        return self._matrix()

    @property
    def features(self):
        return self._stored("features", self._matrix)

    def _matrix(self):
        return features.feature_matrix(self.labels, self.fact, self.dim, self.profile, self.domains)

    def scored(self):
        """Labels with a fixed arithmetic score that has many ties."""
        return self.labels.withColumn("score", fixed_score())


def fixed_score():
    day = F.datediff("d", F.lit("1995-01-01").cast("date"))
    return F.pmod(F.col("channel_id") * 7919 + day * 104729, F.lit(1009)) / 1009.0


# ---- oracle parts -----------------------------------------------------------

part("q_sweeps", """
SELECT * FROM (
  SELECT tag_base, d, n_failed, n_total, n_failed / n_total AS share_failed
  FROM (SELECT tag_base, d, count(DISTINCT channel_id) AS n_failed
        FROM q_fact_long JOIN q_dim_long USING (channel_id)
        WHERE n_fault > 0 OR n_disabled > 0 GROUP BY tag_base, d)
  JOIN (SELECT tag_base, count(*) AS n_total FROM q_dim_long GROUP BY tag_base) USING (tag_base))
WHERE n_failed >= 4 OR share_failed >= 0.2
""")
part("q_grid", """
SELECT channel_id, CAST(day AS DATE) AS d
FROM (SELECT channel_id, unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS day
      FROM q_profile_long
      WHERE channel_id IN (SELECT min(channel_id) FROM q_dim_long GROUP BY twin_group)
        AND channel_id IN (SELECT channel_id FROM q_dim_long WHERE NOT (is_zone_aggregate OR is_power_type)))
WHERE day NOT BETWEEN DATE '1996-03-01' AND DATE '1996-04-10'
  AND day NOT IN (DATE '1997-05-05', DATE '1997-05-06')
""")
part("q_own_fail", """
SELECT f.channel_id, f.d FROM q_fact_long f JOIN q_dim_long dm USING (channel_id)
WHERE f.n_fault + f.n_disabled > 0
  AND NOT EXISTS (SELECT 1 FROM q_sweeps s WHERE s.tag_base = dm.tag_base AND s.d = f.d)
""")


def labels_sql(days: int) -> str:
    return f"""
SELECT g.channel_id, g.d, CAST(count(f.d) > 0 AS BIGINT) AS y
FROM q_grid g LEFT JOIN q_own_fail f
  ON f.channel_id = g.channel_id AND f.d BETWEEN g.d + 1 AND g.d + {days}
GROUP BY g.channel_id, g.d
"""


part("q_labels", labels_sql(1))
part("q_dense", """
SELECT l.channel_id, l.d, l.y, coalesce(n_ev, 0) AS n_ev, coalesce(n_fault + n_disabled, 0) AS n_fault,
       coalesce(n_undefined, 0) AS n_undefined, CAST(f.n_ev IS NOT NULL AS BIGINT) AS was_active,
       coalesce(trit_day, 0) AS trit_day
FROM q_labels l LEFT JOIN q_fact_long f USING (channel_id, d)
""")
part("q_rolled", """
SELECT *,
  CAST(sum(n_ev) OVER w AS BIGINT) AS ev_7d, CAST(sum(was_active) OVER w AS BIGINT) AS active_days_7d,
  CAST(sum(n_fault) OVER w AS BIGINT) AS fault_ev_7d, CAST(sum(n_undefined) OVER w AS BIGINT) AS undefined_ev_7d,
  CAST(count(*) FILTER (WHERE trit_day = 1) OVER w AS BIGINT) AS dev_days_7d,
  CAST(count(*) FILTER (WHERE was_active = 0) OVER w AS BIGINT) AS unknown_days_7d,
  CAST(count(*) FILTER (WHERE n_fault > 0) OVER (PARTITION BY channel_id ORDER BY d ROWS 29 PRECEDING) AS BIGINT) AS fault_days_30d,
  CAST(sum(n_ev) OVER q AS BIGINT) AS ev_90d, CAST(sum(n_fault) OVER q AS BIGINT) AS fault_90d,
  CAST(sum(was_active) OVER q AS BIGINT) AS active_days_90d
FROM q_dense
WINDOW w AS (PARTITION BY channel_id ORDER BY d ROWS 6 PRECEDING),
       q AS (PARTITION BY channel_id ORDER BY d ROWS 89 PRECEDING)
""")
part("q_streaked", """
SELECT *,
  coalesce(datediff('day', max(CASE WHEN was_active > 0 THEN d END) OVER past, d), 0) AS silence_days,
  coalesce(datediff('day', max(CASE WHEN n_fault > 0 THEN d END) OVER past, d), 9999) AS days_since_fault
FROM q_rolled WINDOW past AS (PARTITION BY channel_id ORDER BY d)
""")
part("q_near", """
SELECT object_id, picket, d, count(*) FILTER (WHERE trit_day = 1) / count(*) AS dev_share,
       count(*) FILTER (WHERE trit_day = 0) / count(*) AS silent_share
FROM q_fact_long JOIN q_dim_long USING (channel_id) WHERE picket IS NOT NULL GROUP BY object_id, picket, d
""")
part("q_loop", """
SELECT tag_base, d, count(*) FILTER (WHERE n_fault + n_disabled > 0) / count(*) AS base_failed_share
FROM q_fact_long JOIN q_dim_long USING (channel_id) GROUP BY tag_base, d
""")
part("q_domain_long", """
SELECT object_id, picket, count(*) AS n_channels,
       count(*) FILTER (WHERE sensor_type IN ('Тепловой датчик','Датчик температуры')) > 0 AS has_thermal
FROM q_dim_long WHERE picket IS NOT NULL AND NOT is_zone_aggregate GROUP BY object_id, picket
""")
part("q_features", """
SELECT s.channel_id, s.d, s.y,
  CAST(ev_7d AS DOUBLE) AS ev_7d, ev_7d / nullif(ev_90d * 7 / 90.0, 0) AS ev_ratio_7d,
  CAST(active_days_7d AS DOUBLE) AS active_days_7d, CAST(silence_days AS DOUBLE) AS silence_days,
  CASE WHEN active_days_90d > 0 THEN silence_days / (90.0 / active_days_90d) END AS silence_ratio,
  CAST(fault_ev_7d AS DOUBLE) AS fault_ev_7d, CAST(fault_days_30d AS DOUBLE) AS fault_days_30d,
  fault_ev_7d / nullif(fault_90d * 7 / 90.0, 0) AS fault_ratio_90d,
  CAST(least(days_since_fault, 9999) AS DOUBLE) AS days_since_fault,
  CAST(undefined_ev_7d AS DOUBLE) AS undefined_ev_7d, undefined_ev_7d / nullif(ev_7d, 0) AS undefined_share_7d,
  CAST(dev_days_7d AS DOUBLE) AS dev_days_7d, CAST(unknown_days_7d AS DOUBLE) AS unknown_days_7d,
  CAST(coalesce(g.n_channels, 1) AS DOUBLE) AS domain_size,
  coalesce(nb.dev_share, 0) AS domain_dev_share_7d, coalesce(nb.silent_share, 0) AS domain_silent_share,
  coalesce(lp.base_failed_share, 0) AS base_failed_share_7d,
  CAST(datediff('day', p.first_day, s.d) AS DOUBLE) AS channel_age_days,
  CAST(month(s.d) AS DOUBLE) AS month, CAST(isodow(s.d) > 5 AS DOUBLE) AS is_weekend
FROM q_streaked s
JOIN q_dim_long c ON c.channel_id = s.channel_id
JOIN q_profile_long p ON p.channel_id = s.channel_id
LEFT JOIN q_domain_long g ON g.object_id = c.object_id AND g.picket = c.picket
LEFT JOIN q_near nb ON nb.object_id = c.object_id AND nb.picket = c.picket AND nb.d = s.d
LEFT JOIN q_loop lp ON lp.tag_base = c.tag_base AND lp.d = s.d
""")
part("q_scored", """
SELECT *, (channel_id * 7919 + datediff('day', DATE '1995-01-01', d) * 104729) % 1009 / 1009.0 AS score FROM q_labels
""")
part("q_queue", "SELECT *, row_number() OVER (ORDER BY score DESC, channel_id, d) AS place FROM q_scored")

ROUNDED = ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in fv.FEATURE_NAMES)


# ---- labels -----------------------------------------------------------------

@query("l1_sweep_days", with_parts("""
SELECT tag_base, d, n_failed, n_total, round(share_failed + 1e-9, 6) AS share_failed FROM q_sweeps"""))
def l1(spark, sf):
    w = World(spark, sf)
    return tidy(labels.sweep_days(w.fact, w.dim, CFG))


@query("l2_calendar", with_parts("""
SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM q_fact_long"""))
def l2(spark, sf):
    return labels.calendar(World(spark, sf).fact)


@query("l3_twin_representatives", with_parts(
    "SELECT twin_group, min(channel_id) AS channel_id FROM q_dim_long GROUP BY twin_group"))
def l3(spark, sf):
    return labels.twin_representatives(samples.dim_long(spark, sf))


@query("l4_grid", with_parts("SELECT channel_id, d FROM q_grid"))
def l4(spark, sf):
    return World(spark, sf).grid


@query("l5_labels_24h", with_parts("SELECT channel_id, d, y FROM q_labels"))
def l5(spark, sf):
    w = World(spark, sf)
    return tidy(labels.labels(w.grid, w.fact, w.dim, w.sweeps, CFG))


@query("l5_labels_72h", with_parts(labels_sql(3)))
def l5_72(spark, sf):
    w = World(spark, sf)
    return tidy(labels.labels(w.grid, w.fact, w.dim, w.sweeps, CFG72))


@query("l6_label_balance", with_parts("""
SELECT count(*) AS channel_days, CAST(sum(y) AS BIGINT) AS positives,
       round(round(100.0 * sum(y) / count(*), 4) + 1e-9, 6) AS share_percent,
       round(round(100.0 * count(*) FILTER (WHERE y = 1 AND dayofweek(d) IN (0, 6)) / sum(y), 1) + 1e-9, 6) AS weekend_percent
FROM q_labels"""))
def l6(spark, sf):
    return tidy(labels.label_balance(World(spark, sf).labels))


# ---- features ---------------------------------------------------------------

@query("f1_dense_series", with_parts("SELECT * FROM q_dense"))
def f1(spark, sf):
    w = World(spark, sf)
    return tidy(features.dense_series(w.labels, w.fact))


SUMS = ["ev_7d", "active_days_7d", "fault_ev_7d", "undefined_ev_7d", "dev_days_7d", "unknown_days_7d",
        "fault_days_30d", "ev_90d", "fault_90d", "active_days_90d"]


@query("f2_rolling_sums", with_parts(f"SELECT channel_id, d, {', '.join(SUMS)} FROM q_rolled"))
def f2(spark, sf):
    w = World(spark, sf)
    return tidy(features.rolling_sums(features.dense_series(w.labels, w.fact)).select("channel_id", "d", *SUMS))


@query("f3_streaks", with_parts("SELECT channel_id, d, silence_days, days_since_fault FROM q_streaked"))
def f3(spark, sf):
    w = World(spark, sf)
    return tidy(features.streaks(features.dense_series(w.labels, w.fact))
                .select("channel_id", "d", "silence_days", "days_since_fault"))


@query("f4_neighbour_shares", with_parts("""
SELECT object_id, picket, d, round(dev_share + 1e-9, 6) AS dev_share, round(silent_share + 1e-9, 6) AS silent_share
FROM q_near"""))
def f4(spark, sf):
    return tidy(features.neighbour_shares(samples.fact_long(spark, sf), samples.dim_long(spark, sf)))


@query("f5_controller_shares", with_parts(
    "SELECT tag_base, d, round(base_failed_share + 1e-9, 6) AS base_failed_share FROM q_loop"))
def f5(spark, sf):
    return tidy(features.controller_shares(samples.fact_long(spark, sf), samples.dim_long(spark, sf)))


@query("f6_feature_matrix", with_parts(f"SELECT channel_id, d, y, {ROUNDED} FROM q_features"))
def f6(spark, sf):
    w = World(spark, sf)
    return tidy(features.feature_matrix(w.labels, w.fact, w.dim, w.profile, w.domains))


@query("f7_supported_evidence", with_parts("""
SELECT feature, count(*) AS n FROM (
  SELECT unnest(['ev_ratio_7d','silence_ratio','fault_ratio_90d','undefined_share_7d']) AS feature,
         unnest([ev_7d >= 5, silence_days >= 2, fault_ev_7d >= 3, undefined_ev_7d >= 3]) AS ok FROM q_features)
WHERE ok GROUP BY feature"""))
def f7(spark, sf):
    keep = list(fv.MIN_SUPPORT)
    sources = [s for s, _ in fv.MIN_SUPPORT.values()]
    rows = World(spark, sf).matrix
    cells = features.long_form(rows, ["channel_id", "d", *sources], keep)
    ok = features.is_supported(F.col("feature"), {s: F.col(s) for s in sources})
    return cells.filter(ok).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


AGREE = ("CASE WHEN v % 100 BETWEEN 11 AND 14 THEN '{2}' WHEN v % 10 = 1 THEN '{0}' "
         "WHEN v % 10 BETWEEN 2 AND 4 THEN '{1}' ELSE '{2}' END")


WHOLE = "CAST(round_even(x, 0) AS BIGINT)"
TENTH = "coalesce(printf('%.1f', round_even(x, 1)), 'nan')"
PERCENT = "coalesce(CAST(round_even(x * 100, 0) AS BIGINT)::VARCHAR, 'nan') || '%'"
DAYS = AGREE.format('сутки', 'суток', 'суток')


@query("f8_phrases", with_parts(f"""
SELECT feature, phrase, count(*) AS n FROM (
 SELECT feature, CASE feature
  WHEN 'days_since_fault' THEN CASE WHEN x < 1 THEN 'неисправность зафиксирована сегодня'
       ELSE 'последняя неисправность: ' || coalesce(v::VARCHAR, 'nan') || ' ' || {DAYS} || ' назад' END
  WHEN 'silence_days' THEN CASE WHEN x < 1 THEN 'канал выходил на связь сегодня'
       ELSE 'молчит ' || coalesce(v::VARCHAR, 'nan') || ' ' || {DAYS} || ' подряд' END
  WHEN 'is_weekend' THEN CASE WHEN x = 0 THEN 'будний день' ELSE 'выходной день' END
  WHEN 'active_days_7d' THEN 'канал выходил на связь ' || coalesce(v::VARCHAR, 'nan') || ' ' || {DAYS} || ' из 7'
  WHEN 'domain_size' THEN 'в этой точке ' || coalesce(v::VARCHAR, 'nan') || ' ' || {AGREE.format('канал','канала','каналов')}
  WHEN 'channel_age_days' THEN 'канал в эксплуатации ' || coalesce(v::VARCHAR, 'nan') || ' ' || {DAYS}
  WHEN 'ev_7d' THEN 'событий за 7 суток: ' || coalesce(v::VARCHAR, 'nan') || ' при обычных 0'
  WHEN 'ev_ratio_7d' THEN 'темп событий к личной норме канала: ×' || {TENTH}
  WHEN 'silence_ratio' THEN 'молчание превышает обычный для канала интервал в ' || {TENTH} || ' раза'
  WHEN 'fault_ev_7d' THEN 'сообщений о неисправности за 7 суток: ' || coalesce(v::VARCHAR, 'nan')
  WHEN 'fault_days_30d' THEN 'суток с неисправностью за месяц: ' || coalesce(v::VARCHAR, 'nan')
  WHEN 'fault_ratio_90d' THEN 'неисправностей в ' || {TENTH} || ' раза больше личной нормы канала'
  WHEN 'undefined_ev_7d' THEN 'потерь связи за 7 суток: ' || coalesce(v::VARCHAR, 'nan')
  WHEN 'undefined_share_7d' THEN 'доля событий без определённого состояния: ' || {PERCENT}
  WHEN 'dev_days_7d' THEN 'суток с отклонением за неделю: ' || coalesce(v::VARCHAR, 'nan') || ' из 7'
  WHEN 'unknown_days_7d' THEN 'суток без наблюдаемости за неделю: ' || coalesce(v::VARCHAR, 'nan') || ' из 7'
  WHEN 'domain_dev_share_7d' THEN 'соседей по точке в отклонении: ' || {PERCENT}
  WHEN 'domain_silent_share' THEN 'соседей по точке молчат: ' || {PERCENT}
  WHEN 'base_failed_share_7d' THEN 'каналов контроллера в отказе: ' || {PERCENT}
  WHEN 'month' THEN 'месяц ' || v
  END AS phrase
 FROM (SELECT feature, x, {WHOLE} AS v FROM (
   SELECT unnest([{", ".join(f"'{n}'" for n in fv.FEATURE_NAMES)}]) AS feature,
          unnest([{", ".join(f"{n}::DOUBLE" for n in fv.FEATURE_NAMES)}]) AS x FROM q_features)))
GROUP BY feature, phrase"""))
def f8(spark, sf):
    """Sentences of all features over every grid row."""
    cells = features.long_form(World(spark, sf).features, [], fv.FEATURE_NAMES)
    return (cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("phrase", features.phrase(F.col("feature"), F.col("value")))
            .groupBy("feature", "phrase").agg(F.sum("n").alias("n")))


# ---- metrics over a fixed score ---------------------------------------------

AT_K = """SELECT '{kind}@' || k AS metric, {expr} AS value
FROM (SELECT unnest([{ks}]) AS k), (SELECT count(*) AS n, sum(y) AS p FROM q_scored)"""
HITS = "(SELECT sum(y) FROM q_queue WHERE place <= k)"


def at_k(kind: str, expr: str, ks: str) -> str:
    return AT_K.format(kind=kind, expr=expr, ks=ks)


CURVE = """
SELECT score, sum(y) AS hits, count(*) AS n, sum(sum(y)) OVER (ORDER BY score DESC) AS tp,
       sum(count(*)) OVER (ORDER BY score DESC) AS taken FROM q_scored GROUP BY score"""


@query("m6_ranking_metrics", with_parts(f"""
SELECT metric, round(value + 1e-9, 6) AS value FROM (
  SELECT 'n' AS metric, count(*)::DOUBLE AS value FROM q_scored
  UNION ALL SELECT 'positives', sum(y)::DOUBLE FROM q_scored
  UNION ALL SELECT 'base_rate', avg(y) FROM q_scored
  UNION ALL SELECT 'pr_auc', sum(hits * tp / taken) / (SELECT sum(y) FROM q_scored) FROM ({CURVE})
  UNION ALL SELECT 'roc_auc', (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0)
                              / (sum(y) * (count(*) - sum(y)))
            FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM q_scored)
  UNION ALL {at_k('precision', HITS + ' / k', '50, 100, 500')}
  UNION ALL {at_k('lift', HITS + ' / k / (p / n)', '50, 100, 500')})"""))
def m6(spark, sf):
    return tidy(scores.ranking_metrics(World(spark, sf).scored()))


@query("m7_threshold_for_precision", with_parts(f"""
SELECT target, precision >= target AS achieved, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall,
       round(score + 1e-9, 6) AS threshold
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY precision >= target DESC,
               CASE WHEN precision >= target THEN recall ELSE precision END DESC, score) AS rn
      FROM (SELECT unnest([0.02, 0.99])::DOUBLE AS target, tp / taken AS precision, tp / (SELECT sum(y) FROM q_scored) AS recall, score
            FROM ({CURVE})))
WHERE rn = 1"""))
def m7(spark, sf):
    s = World(spark, sf).scored()
    rows = [scores.threshold_for_precision(s, t).withColumn("target", F.lit(t)) for t in (0.02, 0.99)]
    return tidy(rows[0].unionByName(rows[1]))


@query("m10_recall_price", with_parts("""
SELECT recall, place AS alerts, round(need / place + 1e-9, 6) AS precision, round(place / 731.0 + 1e-9, 6) AS alerts_per_day
FROM (SELECT recall, need, min(place) AS place
      FROM (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7])::DOUBLE AS recall, ceil(recall * (SELECT sum(y) FROM q_scored)) AS need),
           (SELECT place, sum(y) OVER (ORDER BY place) AS caught FROM q_queue)
      WHERE caught >= need GROUP BY recall, need)"""))
def m10(spark, sf):
    return tidy(scores.recall_price(World(spark, sf).scored(), (0.1, 0.2, 0.3, 0.5, 0.7), FIT.test_days))


@query("m10_precision_at_k", with_parts(f"""
SELECT metric, round(value + 1e-9, 6) AS value FROM (
  {at_k('precision', HITS + ' / k', '20, 50, 100, 200, 500, 1000')}
  UNION ALL {at_k('recall', HITS + ' / p', '20, 50, 100, 200, 500, 1000')})"""))
def m10_k(spark, sf):
    return tidy(scores.head_metrics(World(spark, sf).scored(), (20, 50, 100, 200, 500, 1000), ("precision", "recall")))


@query("q12_failure_metrics", with_parts(f"""
SELECT metric, round(value + 1e-9, 6) AS value FROM (
  {at_k('precision', HITS + ' / k', '10, 20, 50, 731')}
  UNION ALL {at_k('recall', HITS + ' / p', '10, 20, 50, 731')})"""))
def q12(spark, sf):
    """The last k is one check per day of the period."""
    return tidy(scores.head_metrics(World(spark, sf).scored(), (10, 20, 50, 731), ("precision", "recall")))


part("q_split", """
SELECT f.channel_id, f.d, f.y, CASE WHEN f.d >= DATE '2000-01-01' THEN 'test' ELSE 'train' END AS part
FROM q_features f,
     (SELECT floor(least(2 * sum(y), count(*) - sum(y)) / (count(*) - sum(y)) * 1000000) AS cut
      FROM q_features WHERE d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')
WHERE f.d BETWEEN DATE '1997-01-01' AND DATE '2001-12-31'
  AND (f.d >= DATE '2000-01-01' OR f.y = 1
       OR ('0x' || substr(md5(f.channel_id || '|' || f.d), 1, 12))::BIGINT % 1000000 < cut)
""")


@query("m1_temporal_split", with_parts("SELECT * FROM q_split"))
def m1(spark, sf):
    rows = ranker.temporal_split(World(spark, sf).matrix, FIT)
    return tidy(rows.select("channel_id", "d", "y", "part"))


@query("m2_prepared_matrix", with_parts("SELECT channel_id, d, y, " + ", ".join(
    f"round(coalesce({n}, -1) + 1e-9, 6) AS {n}" for n in fv.FEATURE_NAMES) + " FROM q_features"))
def m2(spark, sf):
    return tidy(ranker.prepare(World(spark, sf).matrix))


# ---- quality controls over a fixed score ------------------------------------

part("q_own_window", """
SELECT channel_id, d, CAST(sum(own) OVER (PARTITION BY channel_id ORDER BY d ROWS 6 PRECEDING) AS BIGINT) AS own_fault_7d
FROM (SELECT f.channel_id, f.d, CASE WHEN s.d IS NULL THEN n_fault + n_disabled ELSE 0 END AS own
      FROM q_fact_long f JOIN q_dim_long USING (channel_id)
      LEFT JOIN q_sweeps s ON s.tag_base = q_dim_long.tag_base AND s.d = f.d)
""")
part("q_strata", """
SELECT q.channel_id, q.d, q.y, q.score, q.place, f.fault_ev_7d AS fault, coalesce(o.own_fault_7d, 0) AS own
FROM q_queue q JOIN q_features f USING (channel_id, d) LEFT JOIN q_own_window o USING (channel_id, d)
""")
part("q_popul", """
SELECT 'fresh' AS population, * FROM q_strata WHERE fault = 0
UNION ALL SELECT 'own_fault', * FROM q_strata WHERE own > 0
UNION ALL SELECT 'sweep_only', * FROM q_strata WHERE fault > 0 AND own = 0
UNION ALL SELECT 'ongoing', * FROM q_strata WHERE fault > 0
UNION ALL SELECT 'all', * FROM q_strata
""")


def _strata_rows(spark, sf, once=False):
    w = World(spark, sf)
    rows = (w.matrix if once else w.features).select("channel_id", "d", "y", "fault_ev_7d").withColumn("score", fixed_score())
    return controls.with_own_fault(rows, controls.own_fault_window(w.fact, w.dim, w.sweeps))


@query("q8_own_fault_window", with_parts("SELECT * FROM q_own_window"))
def q8(spark, sf):
    w = World(spark, sf)
    return tidy(controls.own_fault_window(w.fact, w.dim, w.sweeps))


@query("q9_population_metrics", with_parts("""
SELECT population, n, p AS positives, round(p / n + 1e-9, 6) AS base_rate,
       round(h50 / 50 + 1e-9, 6) AS precision_50, round(h50 / 50 / (p / n) + 1e-9, 6) AS lift_50,
       round(h100 / 100 + 1e-9, 6) AS precision_100, round(h100 / 100 / (p / n) + 1e-9, 6) AS lift_100
FROM (SELECT population, count(*) AS n, CAST(sum(y) AS BIGINT) AS p, sum(y) FILTER (WHERE r <= 50) AS h50,
             sum(y) FILTER (WHERE r <= 100) AS h100
      FROM (SELECT *, row_number() OVER (PARTITION BY population ORDER BY score DESC, channel_id, d) AS r FROM q_popul)
      GROUP BY population)"""))
def q9(spark, sf):
    return tidy(scores.population_metrics(controls.exploded_strata(_strata_rows(spark, sf))))


@query("q10_queue_composition", with_parts("""
SELECT k, population AS stratum, count(*) FILTER (WHERE place <= k) AS rows,
       CAST(coalesce(sum(y) FILTER (WHERE place <= k), 0) AS BIGINT) AS hits
FROM q_popul, (SELECT unnest([50, 100, 500])::BIGINT AS k) GROUP BY k, population"""))
def q10(spark, sf):
    return tidy(scores.queue_composition(_strata_rows(spark, sf), controls.strata()))


@query("q10_positive_decomposition", with_parts("""
SELECT population AS stratum, CAST(sum(y) AS BIGINT) AS positives,
       round(sum(y) / (SELECT sum(y) FROM q_strata) + 1e-9, 6) AS share
FROM q_popul WHERE population IN ('fresh', 'ongoing') GROUP BY population"""))
def q10_split(spark, sf):
    parts = {k: v for k, v in controls.strata().items() if k in ("fresh", "ongoing")}
    return tidy(scores.positive_decomposition(_strata_rows(spark, sf, once=True), parts))


@query("q14_busiest_failure_day", with_parts("""
SELECT d, CAST(sum(y) AS BIGINT) AS failures FROM q_features GROUP BY d ORDER BY 2 DESC, 1 DESC LIMIT 1"""))
def q14(spark, sf):
    return tidy(controls.busiest_failure_day(World(spark, sf).matrix))


# ---- the trained model: what SQL can state about it ------------------------

_FITTED: dict = {}


def _fitted(spark, sf):
    """One trained forest and linear model per sample, shared by the queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        rows = ranker.prepare(ranker.temporal_split(World(spark, sf).features, FIT))
        train = rows.filter("part = 'train'").persist()
        _FITTED[key] = (ranker.train_forest(train, FIT), ranker.train_linear(train))
        train.unpersist()
    return _FITTED[key]


def _test_rows(spark, sf, once=False):
    rows = World(spark, sf).matrix if once else World(spark, sf).features
    return rows.filter(F.col("d").between(F.lit(FIT.test_from).cast("date"), F.lit(FIT.test_to).cast("date")))


def _scored_test(spark, sf):
    """Scores of the test period, written once for the queries that explain them."""
    return stored(spark, sf, f"scored_test-{settings_digest(CFG, FIT)}", lambda: ranker.score(
        _fitted(spark, sf)[0], ranker.prepare(_test_rows(spark, sf))))


TEST_KEYS = "FROM q_features WHERE d BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'"
#: metrics that follow from the labels alone; of the others SQL can state the range
FROM_LABELS = ["n", "positives", "base_rate"]


def _stated(metrics):
    """(metric, value, plausible): values that labels fix, and whether the others lie where they must."""
    value = F.col("value")
    plausible = F.when(F.col("metric").startswith("lift"), value >= 0).otherwise((value >= 0) & (value <= 1) | F.col("metric").isin(FROM_LABELS))
    return metrics.withColumn("plausible", F.coalesce(plausible, F.lit(False))).withColumn(
        "value", F.when(F.col("metric").isin(FROM_LABELS), value))


def metrics_sql(keys: str) -> str:
    names = ["n", "positives", "base_rate", "pr_auc", "roc_auc"] + [f"{m}@{k}" for k in (50, 100, 500) for m in ("precision", "lift")]
    return f"""SELECT metric, CASE metric WHEN 'n' THEN n WHEN 'positives' THEN p WHEN 'base_rate' THEN round(p / n + 1e-9, 6) END::DOUBLE AS value, true AS plausible
FROM (SELECT unnest({names}) AS metric), (SELECT count(*) AS n, sum(y) AS p {keys})"""


@query("m3_forest_tree_sizes", with_parts("""
SELECT unnest(range(300)) AS tree, true AS is_binary, true AS depth_met, true AS leaf_minimum_met"""))
def m3(spark, sf):
    """Trained forest as data: every tree is binary, as deep and as coarse as it was asked to be."""
    nodes = explain.node_table(_fitted(spark, sf)[0], spark)
    leaf = F.col("left") < 0
    per = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(leaf).alias("leaves"),
                                    F.min(F.when(leaf, F.col("rows"))).alias("smallest"))
    return tidy(per.select("tree", (F.col("nodes") == 2 * F.col("leaves") - 1).alias("is_binary"),
                           (F.col("leaves") <= 2 ** FIT.depth).alias("depth_met"),
                           (F.col("smallest") >= FIT.min_leaf).alias("leaf_minimum_met")))


@query("m4_linear_control_metrics", with_parts(metrics_sql(TEST_KEYS)))
def m4(spark, sf):
    rows = ranker.score(_fitted(spark, sf)[1], ranker.prepare(_test_rows(spark, sf)))
    return tidy(_stated(scores.ranking_metrics(rows)))


@query("m5_forest_scores", with_parts(f"SELECT channel_id, d, y, true AS is_mean_leaf_share {TEST_KEYS}"))
def m5(spark, sf):
    """Scores of the trained forest, each the mean share of the leaves its row falls to in the node table."""
    model = _fitted(spark, sf)[0]
    rows = ranker.score(model, ranker.prepare(_test_rows(spark, sf)))
    told = explain.leaf_share(explain.node_table(model, spark), rows, explain.node_bound(model))
    return tidy(rows.join(told, ["channel_id", "d"]).select(
        "channel_id", "d", "y", (F.abs(F.col("score") - F.col("leaf_share")) < 1e-9).alias("is_mean_leaf_share")))


@query("m6_forest_metrics", with_parts(metrics_sql(TEST_KEYS)))
def m6_forest(spark, sf):
    return tidy(_stated(scores.ranking_metrics(_scored_test(spark, sf))))


@query("m8_feature_importance", with_parts(
    f"SELECT unnest({fv.FEATURE_NAMES}) AS feature, true AS is_node_gain, 1.0::DOUBLE AS total"))
def m8(spark, sf):
    """Importances of the trained forest, each what the gains in its node table add up to."""
    model = _fitted(spark, sf)[0]
    rows = ranker.feature_importance(model, samples.table(spark, sf, "supplier"))
    told = explain.importance_of(explain.node_table(model, spark)).withColumnRenamed("importance", "gained")
    both = with_row(rows, rows.agg(F.sum("importance").alias("total"))).join(told, "feature", "left")
    near = F.abs(F.col("importance") - F.coalesce("gained", F.lit(0.0))) < 1e-9
    return tidy(both.select("feature", near.alias("is_node_gain"), "total"))


@query("m4_linear_scores", with_parts(f"SELECT channel_id, d, y, true AS is_logistic {TEST_KEYS}"))
def m4_scores(spark, sf):
    """Scores of the control model, each the logistic of its scaled and weighted features."""
    model = _fitted(spark, sf)[1]
    rows = ranker.score(model, ranker.prepare(_test_rows(spark, sf)))
    return tidy(rows.select("channel_id", "d", "y", (F.abs(F.col("score") - ranker.linear_score(model)) < 1e-9).alias("is_logistic")))


def _horizon_sql(hours: int) -> str:
    keys = f"FROM ({labels_sql(hours // 24)}) WHERE d BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'"
    more = "SELECT unnest(['target_precision_achieved', 'best_precision', 'recall_at_best']) AS metric, NULL::DOUBLE AS value, true AS plausible"
    return f"SELECT {hours} AS horizon_hours, * FROM ({metrics_sql(keys)} UNION ALL {more})"


HORIZONS = (24, 72, 168, 336)


@query("m9_horizon_sweep", with_parts(" UNION ALL ".join(map(_horizon_sql, HORIZONS))))
def m9(spark, sf):
    """Relabel, retrain and measure for each horizon, from one matrix."""
    world = World(spark, sf)
    matrix = features.feature_matrix(world.ahead.withColumnRenamed("ahead", "y"), world.fact, world.dim, world.profile, world.domains)
    scored = ranker.horizon_sweep(matrix, [h // 24 for h in HORIZONS], FIT)
    return tidy(_stated(scores.horizon_metrics(scored, FIT.target_precision)))


@query("x1_path_contributions", with_parts(f"SELECT channel_id, d, true AS additive {TEST_KEYS}"))
def x1(spark, sf):
    rows = explain.contributions(_fitted(spark, sf)[0], _scored_test(spark, sf))
    total = F.aggregate("contrib", F.col("bias"), lambda a, x: a + x)
    return rows.select("channel_id", "d", (F.abs(total - F.col("score")) < 1e-9).alias("additive"))


@query("x2_additivity_gap", with_parts(f"SELECT count(*) AS rows, true AS exact {TEST_KEYS}"))
def x2(spark, sf):
    gap = explain.additivity_gap(explain.contributions(_fitted(spark, sf)[0], _scored_test(spark, sf)))
    return gap.select("rows", (F.col("max_gap") < 1e-9).alias("exact"))


def _evidence(spark, sf):
    return stored(spark, sf, f"evidence-{settings_digest(CFG, FIT)}", lambda: explain.top_evidence(
        explain.contributions(_fitted(spark, sf)[0], _scored_test(spark, sf)), _test_rows(spark, sf)))


@query("x3_top_evidence", with_parts(f"SELECT channel_id, d, true AS few, true AS positive, true AS falling {TEST_KEYS}"))
def x3(spark, sf):
    told = explain.top_evidence(explain.contributions(_fitted(spark, sf)[0], _scored_test(spark, sf)), _test_rows(spark, sf))
    amounts = F.transform("evidence", lambda e: e["contribution"])
    return told.select("channel_id", "d", (F.size("evidence") <= 5).alias("few"), F.forall(amounts, lambda c: c > 0).alias("positive"),
                       (amounts == F.reverse(F.array_sort(amounts))).alias("falling"))


@query("x4_counterfactual", with_parts("SELECT 0 AS wrongly_told, 0 AS out_of_range"))
def x4(spark, sf):
    rows = explain.counterfactual(_fitted(spark, sf)[0], ranker.prepare(_test_rows(spark, sf)), _evidence(spark, sf))
    told = F.col("counterfactual").isNotNull()
    return tidy(rows.agg(F.count_if(told != (F.col("after") < F.col("before") - 0.01)).alias("wrongly_told"),
                         F.count_if(~F.col("after").between(0, 1)).alias("out_of_range")))


@query("x5_group_ablation", with_parts(
    f"SELECT unnest({[explain.UNCHANGED, *fv.ABLATION_GROUPS]}) AS \"group\", true AS plausible, true AS loss_adds_up"))
def x5(spark, sf):
    rows = explain.group_ablation(_fitted(spark, sf)[0], ranker.prepare(_test_rows(spark, sf)))
    base = rows.filter(F.col("group") == "исходно").agg(F.first("precision_50").alias("base"))
    p = F.col("precision_50")
    return with_row(rows, base).select("group", (p.between(0, 1) & F.col("precision_100").between(0, 1)).alias("plausible"),
                                       (F.abs(F.col("base") - p - F.col("loss")) < 1e-3).alias("loss_adds_up"))


# ---- explanations over two small fixed trees, stated in SQL -------------------

#: (tree, node, left, right, feature, threshold, share): splits on four features
SMALL_TREES = [
    (0, 0, 1, 2, "fault_ev_7d", 1.0, 0.30), (0, 1, -1, -1, None, 0.0, 0.10), (0, 2, 3, 4, "silence_days", 3.0, 0.60),
    (0, 3, -1, -1, None, 0.0, 0.50), (0, 4, -1, -1, None, 0.0, 0.90),
    (1, 0, 1, 2, "days_since_fault", 10.0, 0.25), (1, 1, -1, -1, None, 0.0, 0.40), (1, 2, 3, 4, "domain_size", 2.0, 0.12),
    (1, 3, -1, -1, None, 0.0, 0.05), (1, 4, -1, -1, None, 0.0, 0.20),
]


def _small_nodes(spark, sf):
    place = {n: i for i, n in enumerate(fv.FEATURE_NAMES)}
    rows = [(t, n, a, b, place.get(f, -1), x, s) for t, n, a, b, f, x, s in SMALL_TREES]
    return inline_table(spark, rows, ["tree", "node", "left", "right", "feature", "threshold", "share"])


def _small_scores(spark, sf, rows):
    """Rows with the small trees' score: bias plus contributions."""
    told = explain.contributions_of(_small_nodes(spark, sf), rows.withColumn("score", F.lit(0.0)), len(SMALL_TREES))
    total = F.aggregate("contrib", F.col("bias"), lambda a, x: a + x)
    return rows.join(told.select("channel_id", "d", total.alias("score")), ["channel_id", "d"])


def _small_told(spark, sf):
    scored = _small_scores(spark, sf, ranker.prepare(_test_rows(spark, sf)))
    return explain.contributions_of(_small_nodes(spark, sf), scored, len(SMALL_TREES))


def _small_sql(fault: str = "fault_ev_7d", silence: str = "silence_days") -> str:
    """Contributions of the small trees by hand."""
    return f"""
  CASE WHEN {fault} <= 1 THEN -0.1 ELSE 0.15 END AS c_fault, CASE WHEN {fault} <= 1 THEN 0 WHEN {silence} <= 3 THEN -0.05 ELSE 0.15 END AS c_silence,
  CASE WHEN since <= 10 THEN 0.075 ELSE -0.065 END AS c_since, CASE WHEN since <= 10 THEN 0 WHEN size <= 2 THEN -0.035 ELSE 0.04 END AS c_size"""


part("q_small", f"""
SELECT *, 0.275 + c_fault + c_silence + c_since + c_size AS score FROM (
  SELECT *, {_small_sql()} FROM (
    SELECT channel_id, d, y, fault_ev_7d, silence_days, days_since_fault, coalesce(days_since_fault, -1) AS since, coalesce(domain_size, -1) AS size
    FROM q_features WHERE d BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'))
""")
part("q_small_told", """
SELECT channel_id, d, c, feature, x, row_number() OVER (PARTITION BY channel_id, d ORDER BY c DESC, i) AS r FROM (
  SELECT channel_id, d, unnest([5, 3, 8, 13]) AS i, unnest([c_fault, c_silence, c_since, c_size]) AS c,
         unnest(['fault_ev_7d', 'silence_days', 'days_since_fault', 'domain_size']) AS feature,
         unnest([fault_ev_7d, silence_days, days_since_fault, size]::DOUBLE[]) AS x FROM q_small)
WHERE c > 0
""")


@query("x1_small_trees", with_parts("""
SELECT channel_id, d, round(0.275 + 1e-9, 6) AS bias, round(score + 1e-9, 6) AS score, round(c_fault + 1e-9, 6) AS c_fault,
       round(c_silence + 1e-9, 6) AS c_silence, round(c_since + 1e-9, 6) AS c_since, round(c_size + 1e-9, 6) AS c_size FROM q_small"""))
def x1_small(spark, sf):
    at = {"c_fault": "fault_ev_7d", "c_silence": "silence_days", "c_since": "days_since_fault", "c_size": "domain_size"}
    return tidy(_small_told(spark, sf).select("channel_id", "d", "bias", "score", *[
        F.col("contrib")[fv.FEATURE_NAMES.index(n)].alias(c) for c, n in at.items()]))


@query("x3_small_trees", with_parts("""
SELECT channel_id, d, string_agg(feature || '~' || printf('%.3f', c), '|' ORDER BY r) AS evidence FROM q_small_told WHERE r <= 5 GROUP BY channel_id, d"""))
def x3_small(spark, sf):
    told = explain.top_evidence(_small_told(spark, sf), _test_rows(spark, sf)).filter(F.size("evidence") > 0)
    return told.select("channel_id", "d", F.array_join(F.transform("evidence", lambda e: F.concat_ws(
        "~", e["feature"], F.format_string("%.3f", e["contribution"]))), "|").alias("evidence"))


#: the strongest raising feature of a row, ties by the order of features
_LEAD = """CASE WHEN top <= 0 THEN NULL WHEN c_silence = top THEN 'silence_days' WHEN c_fault = top THEN 'fault_ev_7d'
  WHEN c_since = top THEN 'days_since_fault' ELSE 'domain_size' END"""


@query("x4_small_trees", with_parts(f"""
SELECT channel_id, d, lead, round(score + 1e-9, 6) AS before, round(0.275 + c_fault + c_silence + c_since + c_size + 1e-9, 6) AS after, walked FROM (
  SELECT channel_id, d, lead, score, {_small_sql("CASE WHEN lead = 'fault_ev_7d' THEN 0 ELSE fault_ev_7d END",
                                                 "CASE WHEN lead = 'silence_days' THEN 0 ELSE silence_days END")},
         CASE WHEN lead = 'fault_ev_7d' THEN fault_ev_7d <> 0 WHEN lead = 'silence_days' THEN fault_ev_7d > 1 AND silence_days <> 0
              ELSE false END::BIGINT AS walked
  FROM (SELECT * EXCLUDE (c_fault, c_silence, c_since, c_size), {_LEAD} AS lead
        FROM (SELECT *, greatest(c_fault, c_silence, c_since, c_size) AS top FROM q_small)) WHERE lead IS NOT NULL)"""))
def x4_small(spark, sf):
    told = explain.top_evidence(_small_told(spark, sf), _test_rows(spark, sf))
    rows = explain.counterfactual_of(_small_nodes(spark, sf), ranker.prepare(_test_rows(spark, sf)), told, len(SMALL_TREES))
    return tidy(rows.select("channel_id", "d", "lead", "before", "after", "walked"))


#: per ablation group: the features of the small trees after muting, and the walks that met a changed one
_ABLATED = {
    "исходно": ("fault", "silence", "since", "size", "0"),
    "окружение": ("fault", "silence", "since", "1", "(since > 10 AND size <> 1)::INT"),
    "инфраструктура": ("fault", "silence", "since", "size", "0"), "связь": ("fault", "silence", "since", "size", "0"),
    "молчание": ("fault", "0", "since", "size", "(fault > 1 AND silence <> 0)::INT"),
    "самодиагностика": ("0", "silence", "0", "size", "(fault <> 0)::INT + (since <> 0)::INT"),
}


def _ablated_sql() -> str:
    rows = " UNION ALL ".join(f"""
  SELECT '{g}' AS "group", channel_id, d, y, {walked} AS walked,
         (CASE WHEN {fault} <= 1 THEN 0.1 WHEN {silence} <= 3 THEN 0.5 ELSE 0.9 END::DOUBLE
          + CASE WHEN {since} <= 10 THEN 0.4 WHEN {size} <= 2 THEN 0.05 ELSE 0.2 END::DOUBLE) / 2 AS score FROM x"""
                             for g, (fault, silence, since, size, walked) in _ABLATED.items())
    return f"""
SELECT "group", precision_50, precision_100, round(max(CASE WHEN "group" = 'исходно' THEN precision_50 END) OVER () - precision_50 + 1e-9, 4) AS loss, walked
FROM (SELECT "group", CASE WHEN sum(y) > 0 THEN sum(y) FILTER (place <= 50) / 50 END AS precision_50,
             CASE WHEN sum(y) > 0 THEN sum(y) FILTER (place <= 100) / 100 END AS precision_100, sum(walked)::BIGINT AS walked
      FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, channel_id, d) AS place
            FROM (WITH x AS MATERIALIZED (SELECT channel_id, d, y, fault_ev_7d AS fault, silence_days AS silence, since, size FROM q_small) {rows}))
      GROUP BY "group")"""


@query("x5_small_trees", with_parts(_ablated_sql()))
def x5_small(spark, sf):
    """Ablation over the small trees: precision, loss and the tree walks that were needed again."""
    return tidy(explain.group_ablation_of(_small_nodes(spark, sf), ranker.prepare(_test_rows(spark, sf, once=True)), len(SMALL_TREES)))


#: stumps on eight features that are supported at any amount: (feature, threshold, share below, share above), root share 0.3
WIDE_TREES = [("fault_ev_7d", 0.0, 0.1, 0.60), ("silence_days", 0.0, 0.2, 0.48), ("undefined_ev_7d", 0.0, 0.25, 0.54),
              ("dev_days_7d", 0.0, 0.15, 0.42), ("unknown_days_7d", 0.0, 0.2, 0.46), ("active_days_7d", 1.0, 0.452, 0.36),
              ("ev_7d", 2.0, 0.388, 0.332), ("domain_size", 1.0, 0.38, 0.516)]


def _wide_nodes(spark):
    rows = []
    for t, (f, cut, below, above) in enumerate(WIDE_TREES):
        rows += [(t, 0, 1, 2, fv.FEATURE_NAMES.index(f), cut, 0.3), (t, 1, -1, -1, -1, 0.0, below), (t, 2, -1, -1, -1, 0.0, above)]
    return inline_table(spark, rows, ["tree", "node", "left", "right", "feature", "threshold", "share"])


def _wide_sql() -> str:
    each = ", ".join(f"CASE WHEN coalesce({f}, -1) <= {cut} THEN ({below} - 0.3) / 8 ELSE ({above} - 0.3) / 8 END::DOUBLE" for f, cut, below, above in WIDE_TREES)
    return f"""
SELECT channel_id, d, n_raising, string_agg(feature || '~' || printf('%.4f', c), '|' ORDER BY r) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_id, d ORDER BY c DESC, i) AS r, count(*) OVER (PARTITION BY channel_id, d)::INT AS n_raising FROM (
    SELECT channel_id, d, unnest({[fv.FEATURE_NAMES.index(f) for f, *_ in WIDE_TREES]}) AS i, unnest({[f for f, *_ in WIDE_TREES]}) AS feature,
           unnest([{each}]) AS c FROM q_features WHERE d BETWEEN DATE '2000-01-01' AND DATE '2001-12-31') WHERE c > 0)
WHERE r <= 4 GROUP BY ALL"""


@query("x3_wide_trees", with_parts(_wide_sql()))
def x3_wide(spark, sf):
    """Four of up to eight raising features are told.

    A row alone with its channel and day is told in one pass; rows that share theirs meet each other's contributions.
    """
    nodes, bound = _wide_nodes(spark), 3 * len(WIDE_TREES)
    raising = F.size(F.filter("contrib", lambda c: c > 0)).alias("n_raising")
    alone, shared = explain.by_repetition(_test_rows(spark, sf))
    beside = alone.select("*", F.struct(*fv.FEATURE_NAMES).alias("raw"))
    best = explain.evidence_in_place(nodes, ranker.prepare(beside).withColumn("score", F.lit(0.0)), "raw", bound)
    told = explain.contributions_of(nodes, ranker.prepare(shared).withColumn("score", F.lit(0.0)), bound)
    met = explain.top_evidence(told, shared).filter(F.size("evidence") > 0).join(told.select("channel_id", "d", raising), ["channel_id", "d"])
    keys = ["channel_id", "d", "n_raising", "evidence"]
    both = best.select("channel_id", "d", raising, "evidence").unionByName(met.select(*keys))
    return both.select("channel_id", "d", "n_raising", F.array_join(F.transform("evidence", lambda e: F.concat_ws(
        "~", e["feature"], F.format_string("%.4f", e["contribution"]))), "|").alias("evidence"))
