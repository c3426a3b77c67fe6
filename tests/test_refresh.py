"""One more year imported into existing marts against a full build; an asked day; cascades in orders; reports."""

import datetime as dt
import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_job import SF, _write
from tritmarts import fixed_values as fv, job
from tritmarts.functions.numbers import clock
from tritmarts.operators import cards, cascades, orders, refresh
from tritmarts.plans import samples
from tritmarts.settings import Guarding, Labelling, Modelling, Pumping, Smoke
from tritmarts.sources import readers

SETTINGS = job.Settings(
    labelling=Labelling(sweep_min_channels=40, artifact_periods=(), blackout_days=()),
    modelling=Modelling(train_from="2024-01-01", train_to="2025-12-31", test_from="2026-01-01", test_to="2026-01-31", trees=5, depth=4),
    pumping=Pumping(min_starts=1, min_excess=1, min_days=1), smoke=Smoke(sweep_share=0.9), guarding=Guarding(stuck_min_switches=1))
MARTS = ["journal", "fact", "object_day", "pump_day", "armed_interval", "smoke", "fire_candidate", "profile", "features", "guard_health",
         "intrusion_event", "pump_anomaly", "temperature_state"]


def rows_of(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v
    return sorted(repr([(c, plain(r[c])) for c in sorted(df.columns)]) for r in df.collect())


def files_of(folder, *years):
    return {str(p): p.stat().st_mtime_ns for y in years for p in Path(folder).glob(f"year={y}/*.parquet")}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("refresh"))
    journal = samples.journal(spark, SF).withColumn("t", clock(F.col("t_sec"))).withColumn(
        "d", F.add_months("d", (12 * F.pmod(F.xxhash64("channel_id", "d"), F.lit(3))).cast("int")))
    for year in (2024, 2025, 2026):
        _write(journal.filter(F.year("d") == year), readers.JOURNAL_COLUMNS, f"{folder}/journal-{year}")
    sources = job.Sources(
        [f"{folder}/journal-{y}" for y in (2024, 2026)],
        _write(samples.channels(spark, SF), readers.CHANNEL_COLUMNS, f"{folder}/channels"),
        _write(samples.objects(spark, SF), readers.OBJECT_COLUMNS, f"{folder}/objects"),
        _write(samples.contract(spark), readers.CONTRACT_COLUMNS, f"{folder}/contract"))
    job.build_marts(spark, sources, f"{folder}/grown", SETTINGS)
    before = {n: files_of(f"{folder}/grown/{n}", 2024) for n in ("journal", "fact", "object_day", "pump_day", "armed_interval")}
    later = files_of(f"{folder}/grown/journal", 2026)
    grown = job.refresh(spark, replace(sources, journal=f"{folder}/journal-2025"), f"{folder}/grown", SETTINGS)
    whole = job.build_marts(spark, replace(sources, journal=[f"{folder}/journal-{y}" for y in (2024, 2025, 2026)]), f"{folder}/whole", SETTINGS)
    return folder, grown, whole, before, later


@pytest.mark.parametrize("name", MARTS)
def test_a_year_in_between_equals_a_full_build(built, name):
    _, grown, whole, _, _ = built
    want = rows_of(getattr(whole, name))
    assert rows_of(getattr(grown, name)) == want and want


def test_files_of_other_years_stay(built):
    folder, _, _, before, later = built
    assert all(before.values()) and later
    assert before == {n: files_of(f"{folder}/grown/{n}", 2024) for n in before}
    assert files_of(f"{folder}/grown/journal", 2026) == later


def test_edges_matter(built):
    """Without the last rows of the year before, starts and intervals across New Year would be lost."""
    _, grown, _, _, _ = built
    crossing = grown.armed_interval.filter(F.year(F.timestamp_seconds("t_from")) < F.year(F.timestamp_seconds("t_to")))
    assert crossing.count() > 0


def test_touched_years():
    assert refresh.touched_years([2025], [2023, 2024, 2026, 2027]) == [2025, 2026]
    assert refresh.touched_years([2028], [2023, 2027]) == [2028] and refresh.touched_years([2023, 2024], []) == [2023, 2024]


def test_rows_per_imported_year(spark, built, tmp_path):
    folder, grown, _, _, _ = built
    target = str(tmp_path / "journal")
    per_year = {r.year: r.n for r in grown.journal.groupBy("year").agg(F.count("*").alias("n")).collect()}
    first = readers.import_journal(spark, f"{folder}/journal-2024", target)
    assert [(r.year, r["rows"]) for r in first.collect()] == [(2024, per_year[2024])]
    again = readers.import_journal(spark, [f"{folder}/journal-2025", f"{folder}/journal-2026"], target)
    assert {r.year: r["rows"] for r in again.collect()} == {y: per_year[y] for y in (2025, 2026)}
    assert readers.read_journal(spark, target).count() == sum(per_year.values())


def test_an_asked_day_with_reports(spark, built, tmp_path):
    folder, grown, _, _, _ = built
    model = job.train(grown, f"{folder}/model")
    day = grown.features.filter("d >= '2026-01-05'").agg(F.min("d").cast("string")).first()[0]
    users = spark.createDataFrame([(1, "A. Chief", True), (2, "B. Tech", False)], "user_id int, full_name string, is_global boolean")
    out = job.publish(spark, grown, model, str(tmp_path / "out"), day=day, desk=job.Desk(users=users))
    made = grown.put(f"verdicts-{day}", lambda: None)
    failures = made.filter(F.col("scenario") == fv.FAILURE)
    assert {str(r.d) for r in made.select("d").distinct().collect()} == {day}
    assert failures.count() == min(SETTINGS.cards.failure_limit, grown.features.filter(F.col("d") == day).count())

    def report(name):
        return spark.read.parquet(out[f"report_{name}"])
    total = made.count()
    assert report("register").count() == total
    assert report("summary").filter("indicator = 'total'").first().value == total
    assert report("feed_0").select("scenario").distinct().count() <= 1
    assert report("feed").count() == report("feed_new").count() == min(100, total)
    assert report("queue_counters").first().verdicts == total
    assert {r.user_id: r.visible for r in report("visible_counts").collect()} == {1: total, 2: total}
    assert report("work_orders").count() == total and report("incubation").count() == len(fv.INCUBATION_BUCKETS)


def test_cascades_make_emergencies(spark):
    draw = random.Random(2)
    start = dt.datetime(2024, 5, 1, 12)
    rows = []
    for i in range(60):
        at = [start + dt.timedelta(seconds=draw.choice([0, 0, 1, 50]) + 600 * draw.randrange(8)) for _ in range(draw.randrange(3))]
        rows.append((i, draw.choice(["a", "b", None]), draw.randrange(4), 0.1, [(t.isoformat(), "sign", "text") for t in at] + [("2024-05-01", "day", "x")]))
    made = spark.createDataFrame(rows, "id long, object_name string, picket int, probability double, timeline array<struct<ts:string,kind:string,text:string>>")
    made = made.withColumn("sensor_name", F.lit("s")).withColumn("channel_id", F.col("id"))
    got = {r.id: r.cascade for r in cards.with_cascade(made).collect()}
    found = [(r.object_name, dt.datetime.fromisoformat(r["at"]), r.span_seconds) for r in cascades.detect_cascades(cards.signs(made)).collect()]
    want = {}
    for i, name, _, _, timeline in rows:
        times = [dt.datetime.fromisoformat(ts) for ts, *_ in timeline if len(ts) > 10]
        want[i] = any(o == (name or fv.NO_OBJECT) and a <= t <= a + dt.timedelta(seconds=s) for o, a, s in found for t in times)
    assert got == want and set(got.values()) == {True, False}
    level = orders.priority(F.col("probability"), F.lit(fv.FAILURE), F.lit(60), F.col("cascade"))
    assert {(r.cascade, r.p) for r in cards.with_cascade(made).select("cascade", level.alias("p")).collect()} == {
        (True, fv.EMERGENCY), (False, fv.LOW)}
