"""Micro fixtures and invariants for operators."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators import (
    calendar, cards, cascades, contract, domains, explain, fire, geometry, intrusion, labels, marts, orders, ranker, reports, scores,
    verdicts)
from tritmarts.settings import Labelling, Modelling
from tritmarts.sources import readers, sinks

D = dt.date


def test_contract_and_fallback(spark):
    journal = spark.createDataFrame(
        [(1, "Дыма нет"), (1, fv.SMOKE_ON), (1, "Неисправен"), (1, "новое"), (2, "18,5"), (2, "-127"), (2, "01.01.1970 03:00:00"),
         (3, "Норма")], "channel_id long, raw_value string")
    dim = spark.createDataFrame([(1, fv.SMOKE), (2, fv.TEMPERATURE)], "channel_id long, sensor_type string")
    pairs = spark.createDataFrame([(fv.SMOKE, "Дыма нет", fv.NORM), (fv.SMOKE, fv.SMOKE_ON, fv.TRIGGER),
                                   (fv.SMOKE, "Неисправен", fv.FAULT), (fv.ORPHAN_TYPE, "Норма", fv.NORM)],
                                  "sensor_type string, raw_value string, cls string")
    got = {(r.channel_id, r.raw_value): (r.cls, r.trit) for r in contract.classify(journal, dim, pairs).collect()}
    assert got[(1, "Дыма нет")] == (fv.NORM, -1)
    assert got[(1, fv.SMOKE_ON)] == (fv.TRIGGER, 1)
    assert got[(1, "Неисправен")] == (fv.FAULT, 1)
    assert got[(1, "новое")] == (fv.GARBAGE, 0)
    assert got[(2, "18,5")] == (fv.NUMERIC, 0)
    assert got[(2, "-127")] == (fv.GARBAGE, 0)
    assert got[(2, "01.01.1970 03:00:00")] == (fv.GARBAGE, 0)
    assert got[(3, "Норма")] == (fv.GARBAGE, 0)
    named = contract.classify(journal, dim, pairs, orphan_type=fv.ORPHAN_TYPE).filter("channel_id = 3").first()
    assert named.cls == fv.NORM


def test_typed_contract_words_depend_on_the_type(spark):
    rows = [("Выключен", fv.PUMP, fv.NORM), ("Выключен", fv.SMOKE, fv.DISABLED), ("Обесточен", fv.PUMP, fv.FAULT),
            ("Обесточен", fv.PHASE, fv.TRIGGER), ("Включен", fv.FAN, fv.TRIGGER), ("Включен", fv.PHASE, fv.NORM),
            ("-1", fv.GAS, fv.GARBAGE), ("327.68", fv.GAS, fv.GARBAGE), ("12", fv.GAS, fv.NUMERIC), ("60", fv.TEMPERATURE, fv.GARBAGE),
            ("59.9", fv.TEMPERATURE, fv.NUMERIC), ("7", fv.UPS, fv.NUMERIC), ("7", fv.DOOR, fv.GARBAGE),
            ("05.03.2021 10:00:00", fv.GUARD, fv.GARBAGE), ("невиданное", fv.DOOR, fv.UNCOVERED)]
    df = spark.createDataFrame(rows, "raw string, kind string, want string")
    bad = df.withColumn("got", contract.typed_class(F.col("raw"), F.col("kind"))).filter("got <> want").collect()
    assert bad == []


def _fact(spark, rows):
    return spark.createDataFrame(rows, "channel_id long, d date, trit_day int")


def test_twin_synchrony_equals_pairwise_count(spark):
    rng = random.Random(3)
    members = [(g, g * 1000 + i * 17) for g, size in ((1, 2), (2, 90), (3, 5)) for i in range(size)]
    days = [(ch, D(2024, 1, 1) + dt.timedelta(day), rng.choice([-1, 0, 1]))
            for _, ch in members for day in range(12) if rng.random() < 0.2]
    dim = spark.createDataFrame([(g, ch, "имя", "тип", 99) for g, ch in members],
                                "twin_group long, channel_id long, sensor_name string, sensor_type string, twin_count int")
    got = {r.twin_group: (r.n_pairs, r.shared_days, round(r.sync_rate, 9))
           for r in domains.twin_synchrony(dim, _fact(spark, days)).collect()}
    by = {(ch, d): t for ch, d, t in days}
    for g in (1, 2, 3):
        chans = sorted(ch for gg, ch in members if gg == g)
        pairs, shared, same = set(), 0, 0
        for a, b in itertools.combinations(chans, 2):
            for d in {d for c, d in by if c == a}:
                if (b, d) in by:
                    pairs.add((a, b))
                    shared += 1
                    same += by[(a, d)] == by[(b, d)]
        if shared:
            assert got[g] == (len(pairs), shared, round(same / shared, 9))
        else:
            assert g not in got


def test_label_horizon_is_monotone(spark):
    fact = spark.createDataFrame(
        [(1, D(2024, 1, 1), 0, 0), (1, D(2024, 1, 5), 1, 0), (1, D(2024, 1, 9), 0, 0)],
        "channel_id long, d date, n_fault long, n_disabled long")
    dim = spark.createDataFrame([(1, "A", 1, False, False)],
                                "channel_id long, tag_base string, twin_group long, is_zone_aggregate boolean, is_power_type boolean")
    profile = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 9))], "channel_id long, first_day date, last_day date")
    none = spark.createDataFrame([], "tag_base string, d date")
    hits = {}
    for hours in (24, 72):
        cfg = Labelling(horizon_hours=hours, artifact_periods=(), blackout_days=("2024-01-08",))
        grid = labels.grid(dim, profile, cfg)
        rows = labels.labels(grid, fact, dim, none, cfg).collect()
        assert len(rows) == 8
        hits[hours] = {r.d.day for r in rows if r.y}
    assert hits == {24: {4}, 72: {2, 3, 4}}


def test_channel_profile(spark):
    fact = spark.createDataFrame([(1, D(2024, 1, 1), 2), (1, D(2024, 1, 4), 4)], "channel_id long, d date, n_ev long")
    r = marts.channel_profile(fact).first()
    assert (r.lifespan_days, r.active_share, r.mean_gap_days, r.median_ev_per_active_day) == (4, 0.5, 2.0, 3.0)


def test_metrics_with_ties(spark):
    rows = [(1, D(2024, 1, 1), 1, 0.9), (2, D(2024, 1, 1), 0, 0.9), (3, D(2024, 1, 1), 1, 0.4), (4, D(2024, 1, 1), 0, 0.1)]
    df = spark.createDataFrame(rows, "channel_id long, d date, y int, score double")
    m = {r.metric: r.value for r in scores.ranking_metrics(df, (1, 2)).collect()}
    assert m["pr_auc"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert m["roc_auc"] == pytest.approx(0.625)
    assert (m["precision@1"], m["precision@2"], m["lift@1"]) == (1.0, 0.5, 2.0)
    cut = scores.threshold_for_precision(df, 0.6).first()
    assert (cut.achieved, cut.threshold, cut.recall) == (True, 0.4, 1.0)
    assert scores.threshold_for_precision(df, 0.99).first().achieved is False


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), 0, 0.9)], "channel_id long, d date, y int, score double")
    m = {r.metric: r.value for r in scores.ranking_metrics(df, (1,)).collect()}
    assert (m["pr_auc"], m["roc_auc"], m["lift@1"]) == (0.0, None, 0.0)
    assert scores.recall_price(df, (0.5,), 10.0).count() == 0


def test_recall_price_resolves_ties_in_queue_order(spark):
    rng = random.Random(5)
    rows = [(ch, D(2024, 1, 1) + dt.timedelta(day), int(rng.random() < 0.3), rng.randrange(4) / 4)
            for ch in range(0, 5000, 97) for day in range(3)]
    df = spark.createDataFrame(rows, "channel_id long, d date, y int, score double")
    ordered = sorted(rows, key=lambda r: (-r[3], r[0], r[1]))
    total = sum(r[2] for r in rows)
    for recall, alerts in {r.recall: r.alerts for r in scores.recall_price(df, (0.1, 0.5, 0.9), 10.0).collect()}.items():
        need, caught = -(-round(recall * total * 1000) // 1000), 0
        for place, r in enumerate(ordered, 1):
            caught += r[2]
            if caught >= need:
                break
        assert alerts == place


def test_forest_explanations_add_up(spark):
    rng = random.Random(1)
    rows = [(i, D(2024, 1, 1), int(i % 3 == 0), *[float(rng.randrange(6) + (i % 3 == 0)) for _ in fv.FEATURE_NAMES]) for i in range(600)]
    df = spark.createDataFrame(rows, "channel_id long, d date, y int, " + ", ".join(f"`{n}` double" for n in fv.FEATURE_NAMES))
    cfg = Modelling(trees=5, depth=4, min_leaf=5)
    model = ranker.train_forest(ranker.prepare(df), cfg)
    scored = ranker.score(model, ranker.prepare(df))
    contrib = explain.contributions(model, scored)
    assert explain.additivity_gap(contrib).first().max_gap < 1e-12
    gained = {r.feature: r.importance for r in explain.importance_of(explain.node_table(model, spark)).collect()}
    given = {r.feature: r.importance for r in ranker.feature_importance(model, df).collect()}
    assert all(abs(gained.get(n, 0.0) - v) < 1e-12 for n, v in given.items()) and abs(sum(gained.values()) - 1) < 1e-9
    linear = ranker.train_linear(ranker.prepare(df))
    off = F.max(F.abs(F.col("score") - ranker.linear_score(linear)))
    assert ranker.score(linear, ranker.prepare(df)).agg(off).first()[0] < 1e-12
    told = explain.top_evidence(contrib, df, k=4)
    assert told.filter(F.size("evidence") > 4).count() == 0
    eased = explain.counterfactual(model, ranker.prepare(df), told)
    assert eased.filter("counterfactual IS NOT NULL AND after > before - 0.01").count() == 0
    plain = explain.group_ablation(model, ranker.prepare(df), (50, 100)).collect()
    assert {r.group for r in plain} == {"исходно", *fv.ABLATION_GROUPS}
    # partial rescoring against scoring all changed rows from the start
    names = [n for n, _, up in fv.FEATURES if up]
    lead = told.filter(F.size("evidence") > 0).select("channel_id", F.col("evidence")[0]["feature"].alias("lead"))
    zeroed = ranker.prepare(df).join(lead, "channel_id").withColumns(
        {n: F.when(F.col("lead") == n, F.lit(0.0)).otherwise(F.col(n)) for n in names})
    full = {r.channel_id: r.score for r in ranker.score(model, zeroed).collect()}
    assert {r.channel_id for r in eased.collect()} == set(full)
    assert all(abs(r.after - full[r.channel_id]) < 1e-12 and r.walked <= 5 for r in eased.collect())
    assert any(0 < r.walked < 5 for r in eased.collect())
    for group, features in fv.ABLATION_GROUPS.items():
        quiet = {n: F.lit(1.0 if n == "domain_size" else -1.0 if n in fv.MUTED_AS_MISSING else 0.0) for n in features}
        best = ranker.score(model, ranker.prepare(df).withColumns(quiet)).orderBy(F.col("score").desc(), "channel_id").limit(50)
        row = next(r for r in plain if r.group == group)
        assert row.precision_50 == best.agg(F.sum("y") / 50).first()[0] and 0 <= row.walked < 5 * 600
    assert next(r for r in plain if r.group == "исходно").walked == 0


def test_fire_scores(spark):
    rows = [(3, 10, 1, False, 0.1), (2, 1, -1, False, 0.1), (1, 1, 0, False, 0.1), (1, 1, -1, False, 0.1), (5, 50, 1, True, 0.8)]
    df = spark.createDataFrame(rows, "n_smoke_ch int, n_smoke_ev int, confirm_trit int, is_sweep boolean, base_share double")
    score, why = fire.fire_score()
    got = df.select(F.round(score, 6).alias("s"), why.alias("w")).collect()
    assert [r.s for r in got] == [0.95, 0.15, 0.1, 0.0, 0.0]
    assert len(got[0].w) == 3 and "80%" in got[4].w[0]


def test_intrusion_scores(spark):
    rows = [(3, 1, 7, True, 2, 0, 600), (1, -1, 1, False, 12, 0, 60), (2, 1, 201, False, 12, 0, 60), (3, 1, 7, True, 1, 0, 14401)]
    df = spark.createDataFrame(rows, "n_types int, armed_trit int, n_triggers int, is_night boolean, min_hour int, first_t int, last_t int")
    df = df.withColumn("types", F.array(F.lit(fv.DOOR)))
    score, why = intrusion.intrusion_score()
    got = df.select(F.round(score, 6).alias("s"), why.alias("w")).collect()
    assert [r.s for r in got] == [1.0, 0.0, 0.0, 0.0]
    assert "дребезгу" in got[2].w[0] and "4.0 ч" in got[3].w[0]


def test_calendar_breaks_and_due_dates(spark):
    cal = calendar.calendar_dim(spark, "2025-12-01", "2026-12-31")
    days = {r.d: r for r in cal.collect()}
    assert days[D(2026, 1, 3)].break_length == 8 and days[D(2026, 1, 12)].break_length == 0
    assert days[D(2026, 5, 9)].multiplier == 1.35
    assert days[D(2026, 12, 30)].note.startswith("через 2 сут")
    rows = spark.createDataFrame([(1, D(2025, 12, 28), D(2026, 1, 5))], "id int, d date, due date")
    moved = calendar.adjust_due_dates(rows, cal).first()
    assert moved.due == D(2025, 12, 31) and moved.calendar_note.startswith("срок сдвинут на 31.12")


def test_priorities(spark):
    rows = [(0.1, fv.FAILURE, 60, True, fv.EMERGENCY), (0.6, fv.FIRE, None, False, fv.EMERGENCY), (0.9, fv.FAILURE, 60, False, fv.HIGH),
            (0.7, fv.FAILURE, 8, False, fv.MEDIUM), (0.7, fv.FAILURE, None, False, fv.HIGH), (0.5, fv.INTRUSION, 1, False, fv.LOW)]
    df = spark.createDataFrame(rows, "p double, s string, i int, c boolean, want string")
    assert df.filter(orders.priority(F.col("p"), F.col("s"), F.col("i"), F.col("c")) != F.col("want")).count() == 0


def brute_cascades(stamps):
    out, group = [], []
    for s in sorted(stamps):
        if group and s[0] - group[0][0] > 120:
            out.append(group)
            group = []
        group.append(s)
    out.append(group)
    return sorted((g[0][0], len(g), g[-1][0] - g[0][0]) for g in out
                  if len(g) >= 4 and len({p for _, p in g}) >= 2)


@pytest.mark.parametrize("gap", [5, 40, 90, 400])
def test_cascades_match_a_plain_walk(spark, gap):
    rng = random.Random(gap)
    start = int(dt.datetime(2024, 1, 1, 23, 50, tzinfo=dt.timezone.utc).timestamp())
    t, stamps = start, []
    for _ in range(300):
        t += rng.randrange(0, 2 * gap)
        stamps.append((t, rng.randrange(5)))
    rows = [("объект", dt.datetime.fromtimestamp(s, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"), p) for s, p in stamps]
    got = cascades.detect_cascades(spark.createDataFrame(rows, "object_name string, ts string, picket int")).collect()
    read = lambda at: int(dt.datetime.fromisoformat(at).replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted((read(r["at"]), r.n_signs, r.span_seconds) for r in got) == brute_cascades(stamps)


def test_titles(spark):
    rows = [(fv.FAILURE, "Н1", fv.SMOKE, "объект Гамма", 7), (fv.FAILURE, None, "Прочее", "ПС объект Ро", None), (fv.FIRE, "Н1", None, "Узел", 3),
            (fv.INTRUSION, None, None, None, None)]
    df = spark.createDataFrame(rows, "scenario string, sensor_name string, sensor_type string, object_name string, picket int")
    got = [r[0] for r in df.select(cards.title()).collect()]
    assert got == ["Прогноз отказа дымового датчика Н1 на объекте Гамма, ПК7", "Прогноз отказа датчика на объекте Ро (ПС)",
                   "Возможное задымление на объекте Узел, ПК3", "Возможное проникновение"]


def test_incubation_buckets_hold_every_known_value(spark):
    df = spark.createDataFrame([(x,) for x in [0, 1, 7, 8, 30, 31, 60, 61, 100, None]], "incubation_days int")
    got = {r.bucket: r.n for r in reports.incubation_histogram(df).collect()}
    assert list(got.values()) == [1, 2, 2, 2, 2] and sum(got.values()) == 9


def test_scope_without_assignments_is_everything(spark):
    v = spark.createDataFrame([(1, 10), (2, 20)], "id int, object_id int")
    users = spark.createDataFrame([(1, False), (2, False), (3, True)], "user_id int, is_global boolean")
    own = spark.createDataFrame([(1, 10), (3, 10)], "user_id int, object_id int")
    assert [reports.visible_to(v, users, own, u).count() for u in (1, 2, 3)] == [1, 2, 2]


def test_axis_and_points(spark):
    dim = spark.createDataFrame([("О", None, "Зюзино ПК0", 0), ("О", None, "Ясенево ПК100", 100)],
                                "object_name string, parent_name string, sensor_name string, picket int")
    row = geometry.axis_lines(dim).first()
    assert row.toponym == "Зюзино" and row.length_m == 1000
    assert (row.lat1 + row.lat2) / 2 == pytest.approx(55.6560)
    lat, lon = geometry.picket_position()
    at = geometry.axis_lines(dim).withColumn("picket", F.lit(500)).select(lat, lon).first()
    assert at[0] == pytest.approx(row.lat2) and at[1] == pytest.approx(row.lon2)


def _card(spark):
    df = spark.range(1).select(
        F.lit(5).alias("id"), F.lit("2024-01-01").alias("created_at"), F.lit(fv.FIRE).alias("scenario"), F.lit("О").alias("object_name"),
        F.lit(7).alias("picket"), F.lit(None).cast("long").alias("channel_id"), F.lit(0.5).alias("probability"), F.lit(24).alias("horizon_hours"),
        F.lit(fv.STATUS_NEW).alias("status"), F.lit("т;т").alias("title"), F.lit("2024-01-01").alias("first_sign_at"),
        F.lit(0).alias("incubation_days"), F.lit("смотреть").alias("recommendation"),
        F.array(verdicts.sign("fire", "задымление", F.lit(1), F.lit(0.1), F.lit("дым"), F.lit("2024-01-01"))).alias("evidence"),
        F.array(F.lit("слепо")).alias("blind_spots"))
    return df.withColumn("timeline", cards.timeline(F.col("evidence")))


def test_csv_has_mark_title_and_crlf(spark, tmp_path):
    sinks.write_lines(sinks.verdict_csv(_card(spark)), str(tmp_path / "csv"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = data.decode("utf-8").split("\r\n")
    assert data.startswith(b"\xef\xbb\xbf") and lines[0].endswith(";рекомендация")
    assert lines[1] == '5;2024-01-01;пожар;О;7;;0.5000;24;новый;"т;т";2024-01-01;0;дым;слепо;смотреть'


def test_xml_keeps_the_structure(spark, tmp_path):
    sinks.write_xml(_card(spark), str(tmp_path / "xml"))
    body = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "xml").glob("part-*")))
    assert '<verdicts count="1">' in body and '<verdict id="5">' in body
    assert '<item feature="fire" contribution="0.100000" since="2024-01-01">дым</item>' in body and '<mark at="2024-01-01" kind="признак">' in body


def test_geojson_is_longitude_first(spark):
    points = spark.createDataFrame([("О", 7, fv.FIRE, 0.5, "т", 55.71, 37.55)],
                                   "object_name string, picket int, scenario string, probability double, title string, lat double, lon double")
    shapes = spark.createDataFrame([("О", None, False, 0, 10, 100, 55.0, 37.0, 56.0, 38.0, 1, 0.5)],
                                   "object_name string, toponym string, anchor_known boolean, picket_min int, picket_max int, length_m int,"
                                   " lat1 double, lon1 double, lat2 double, lon2 double, n_cards int, max_probability double")
    rows = [r.value for r in sinks.geojson_features(shapes, points).collect()]
    assert '"coordinates":[37.55,55.71]' in rows[1] and '"coordinates":[[37.0,55.0],[38.0,56.0]]' in rows[0]
    wkt = [r.wkt for r in sinks.wkt_rows(shapes, points).collect()]
    assert wkt == ["LINESTRING(37.000000 55.000000, 38.000000 56.000000)", "POINT(37.550000 55.710000)"]


def test_dictionary_row_count_is_enforced(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",".join(readers.CHANNEL_COLUMNS) + '\r\n1,С,Т,"имя\nс ""переносом""",A-1,2\r\n', "utf-8")
    row = readers.read_channels(spark, str(path), expected_rows=1).first()
    assert row.sensor_name.replace("\r", "") == 'имя\nс "переносом"' and row.object_id == 2
    with pytest.raises(ValueError):
        readers.read_channels(spark, str(path), expected_rows=2)


def test_contract_reader_skips_patterns(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("тип_датчика,значение,семантический_класс\nТ,<ЧИСЛО>,МУСОР\nТ,Норма,НОРМА\n", "utf-8")
    assert [tuple(r) for r in readers.read_contract(spark, str(path)).collect()] == [("Т", "Норма", "НОРМА")]
