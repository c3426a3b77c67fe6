"""Small made tables for cases that the samples do not hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions.ordering import running_totals
from tritmarts.operators import calendar, cards, cascades, controls, domains
from tritmarts.plans.store import settings_digest
from tritmarts.settings import Cards, Labelling


def test_incident_metrics_keep_scenarios_without_truth(spark):
    day = dt.date(2024, 1, 5)
    truth = spark.createDataFrame([(1, "задымление", day, 10)], "event_no long, scenario string, d date, picket int")
    dim = spark.createDataFrame([(1, 10, fv.SMOKE), (2, 30, fv.DOOR), (3, 30, fv.HATCH)], "channel_id long, picket int, sensor_type string")
    fact = spark.createDataFrame([(1, day, 1), (2, dt.date(2024, 1, 6), 2), (3, dt.date(2024, 1, 6), 1)], "channel_id long, d date, n_trigger long")
    smoke = spark.createDataFrame([], "d date, is_sweep boolean")
    got = {r.scenario: r for r in controls.incident_metrics(truth, fact, dim, smoke).collect()}
    assert set(got) == set(fv.INCIDENT_TYPES)
    assert (got["задымление"].events, got["задымление"].detected, got["задымление"].recall) == (1, 1, 1.0)
    wrong = got["проникновение"]
    assert (wrong.events, wrong.false_alarms, wrong.false_confirmed, wrong.recall, wrong.precision) == (0, 2, 1, 0.0, 0.0)
    assert wrong.types_in_place == sorted([fv.DOOR, fv.HATCH]) and got["подтопление"].types_in_place == []


def plain_cascades(stamps, window=120, least=4):
    out, group = [], []
    for t in sorted(stamps):
        if group and (t - group[0]).total_seconds() > window:
            out.append(group)
            group = []
        group.append(t)
    return [(g[0], len(g), (g[-1] - g[0]).total_seconds()) for g in [*out, group] if len(g) >= least]


@pytest.mark.parametrize("seed", [1, 2])
def test_cascades_walk_long_islands_like_one_pass(spark, seed):
    draw = random.Random(seed)
    at, stamps = dt.datetime(2024, 1, 1, 10), []
    for _ in range(900):
        at += dt.timedelta(seconds=draw.choice([0, 0.25, 3, 40, 119.5, 120, 121 if draw.random() < 0.02 else 60]))
        stamps.append(at)
    rows = [("o", t.isoformat() + draw.choice(["", "+00:00", "Z"]), i % 5) for i, t in enumerate(stamps)]
    rows += [("o", "2024-01-01", 1), ("o", "not a time at all", 1), ("o", None, 2), ("p", "2024-01-01T12:00:00.123456+03:00", 1)]
    got = cascades.detect_cascades(spark.createDataFrame(rows, "object_name string, ts string, picket int"), Cards(cascade_pickets=1)).collect()
    assert sorted((dt.datetime.fromisoformat(r.at), r.n_signs, r.span_seconds) for r in got) == plain_cascades(stamps)


def test_an_island_of_many_hours_is_no_group(spark, monkeypatch):
    """2,000 hours without a gap beyond the window, walked in blocks; the groups handed to Python are blocks."""
    draw = random.Random(5)
    at, stamps = dt.datetime(2024, 1, 1), []
    while at < dt.datetime(2024, 1, 1) + dt.timedelta(hours=2000):
        at += dt.timedelta(seconds=draw.randint(60, 120))
        stamps.append(at)
    sizes = spark.sparkContext.accumulator(0)
    plain = cascades._exits

    def counted(window, block):
        inner = plain(window, block)

        def run(pdf):
            if len(pdf) > 70:
                sizes.add(1)
            return inner(pdf)
        return run
    monkeypatch.setattr(cascades, "_exits", counted)
    df = spark.createDataFrame([("o", t.isoformat(), i % 3) for i, t in enumerate(stamps)], "object_name string, ts string, picket int")
    cfg = Cards(cascade_pickets=1, cascade_points=2)
    got = cascades.detect_cascades(df, cfg).collect()
    assert sorted((dt.datetime.fromisoformat(r.at), r.n_signs, r.span_seconds) for r in got) == plain_cascades(stamps, least=2)
    assert sizes.value == 0 and not hasattr(cascades, "_chain")


def test_a_window_longer_than_an_hour(spark):
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i) for i in range(60)]
    df = spark.createDataFrame([("o", t.isoformat(), i) for i, t in enumerate(stamps)], "object_name string, ts string, picket int")
    got = cascades.detect_cascades(df, Cards(cascade_seconds=5400, cascade_points=2)).collect()
    assert sorted((dt.datetime.fromisoformat(r.at), r.n_signs, r.span_seconds) for r in got) == plain_cascades(stamps, 5400, 2)


def test_due_dates_far_ahead_and_outside_the_calendar(spark):
    rows = spark.createDataFrame([(dt.date(2026, 3, 1), dt.date(2026, 5, 5)), (dt.date(2027, 1, 2), dt.date(2027, 1, 5)), (None, None)], "d date, due date")
    got = {r.d: r.due for r in calendar.adjust_due_dates(rows, calendar.calendar_of(rows)).collect()}
    # the first long break after 1 March 2026 starts on Saturday 7 March, next to the holiday of 8 March
    first = calendar.calendar_of(rows).filter(F.col("d") == "2026-03-01").first().next_break
    assert got[dt.date(2026, 3, 1)] == first - dt.timedelta(days=1)
    assert got[dt.date(2027, 1, 2)] == dt.date(2027, 1, 2) and got[None] is None
    short = calendar.calendar_dim(spark, "2026-01-01", "2026-12-31")
    with pytest.raises(Exception, match="does not cover"):
        calendar.adjust_due_dates(rows, short).collect()


def test_many_cards_of_one_risk_are_ranked_by_id(spark):
    draw = random.Random(3)
    ids = draw.sample(range(-10**12, 10**12), 500)
    df = spark.createDataFrame([(i, "o", 0.95) for i in ids], "id long, object_name string, probability double")
    got = {r.id: r.place for r in cards.ranked_cards(df).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}


def test_running_totals_at_two_partition_counts(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.randrange(3), draw.randrange(4), i, draw.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, a int, b int, i int, v long")
    want, total = {}, {}
    for k, a, b, i, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = running_totals(df, [F.col("a"), F.col("b"), F.col("i")], ["v"], key=["k"])
            assert out.columns == [*df.columns, "v_cum"] and {r.i: r.v_cum for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_twin_pairs_that_met_against_all_pairs(spark):
    draw = random.Random(5)
    days = {c: frozenset(draw.sample(range(12), draw.choice([0, 1, 1, 2, 5]))) for c in range(1000, 1400)}
    dim = spark.createDataFrame([(c, 2, c % 3, "n", "t") for c in days], "channel_id long, twin_count long, twin_group long, sensor_name string, sensor_type string")
    fact = spark.createDataFrame([(c, dt.date(2024, 1, 1) + dt.timedelta(days=d), 1) for c, x in days.items() for d in x], "channel_id long, d date, trit_day int")
    got = {r.twin_group: r.n_pairs for r in domains.twin_synchrony(dim, fact).collect()}
    assert got == {g: sum(bool(days[a] & days[b]) for a in days for b in days if a < b and a % 3 == b % 3 == g) for g in range(3)}


def test_settings_name_their_marts():
    assert settings_digest(Labelling()) == settings_digest(Labelling())
    assert settings_digest(Labelling()) != settings_digest(Labelling(sweep_min_channels=21))


def test_feature_matrix_deals_the_grid_once(spark):
    """Above the one exchange by channel, windows and joins move no grid row again."""
    from tritmarts.plans.catalog_ranking import World
    from tritmarts.operators import features
    w = World(spark, "/root/testdata/sf0.001")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = features.feature_matrix(w.labels, w.fact, w.dim, w.profile, w.domains)
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = next(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line)
    assert any("Window" in line for line in lines[:dealt])
    assert not any("Exchange" in line for line in lines[:dealt])
