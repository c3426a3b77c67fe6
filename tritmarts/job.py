"""The whole job on a user's data: source files in; marts, model, verdicts, cards and exports out.

    sources = Sources(journal="…/journal/*.csv", channels="…/channels.csv", objects="…/objects.csv", contract="…/contract.csv")
    marts = build_marts(spark, sources, "…/marts")
    model = train(marts, "…/models/failure")            # or load_model("…/models/failure") on a later day
    publish(spark, marts, model, "…/out")

    marts = refresh(spark, replace(sources, journal="…/journal/2027.csv"), "…/marts")    # one more year
    publish(spark, marts, load_model("…/models/failure"), "…/out/2027-03-01", day="2027-03-01")

Every mart is written below the given folder and read back, so each step starts from files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators import (
    calendar, cards, domains, explain, features, fire, geometry, intrusion, labels, marts as rollup, orders, pumps, ranker,
    reports, thermal, verdicts)
from tritmarts.operators.refresh import armed_intervals, edge_rows, pump_days, touched_years
from tritmarts.settings import Cards, Guarding, Labelling, Modelling, Pumping, Smoke
from tritmarts.sources import readers, sinks


@dataclass(frozen=True)
class Sources:
    journal: str | list[str]
    channels: str
    objects: str
    contract: str


@dataclass(frozen=True)
class Settings:
    labelling: Labelling = field(default_factory=Labelling)
    modelling: Modelling = field(default_factory=Modelling)
    pumping: Pumping = field(default_factory=Pumping)
    smoke: Smoke = field(default_factory=Smoke)
    guarding: Guarding = field(default_factory=Guarding)
    cards: Cards = field(default_factory=Cards)


class Marts:
    """Marts below one folder; each is written when it is first asked for or found there."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        self._read: dict[str, DataFrame] = {}

    def put_years(self, name: str, rows: DataFrame, year: Column | None = None) -> DataFrame:
        """Write the partitions of the years of ``rows`` and read the whole mart, without the year unless rows have it."""
        dated = rows if year is None else rows.withColumn("year", year)
        path = readers.write_years(dated, f"{self.folder}/{name}")
        found = readers.read_mart(self.spark, path)
        self._read[name] = found if year is None else found.drop("year")
        return self._read[name]

    def put(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._read:
            path = readers.write_mart(build(), f"{self.folder}/{name}")
            self._read[name] = readers.read_mart(self.spark, path)
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = readers.read_mart(self.spark, f"{self.folder}/{name}")
        return self._read[name]


def build_marts(spark: SparkSession, sources: Sources, folder: str, settings: Settings = Settings()) -> Marts:
    """Import the journal and roll it up: day marts, labels, features and what the detectors need.

    For a new ``folder``, or one whose dictionary, contract or settings have changed: then all years
    in the sources are rolled up again.
    """
    m = Marts(spark, folder, settings)
    imported = readers.import_journal(spark, sources.journal, f"{m.folder}/journal")
    return _roll_up(m, sources, [r.year for r in imported.collect()])


def refresh(spark: SparkSession, sources: Sources, folder: str, settings: Settings = Settings()) -> Marts:
    """Import more years and bring the marts up to date.

    Day marts of other years keep their files; only the year after an imported one is rolled up again, since
    its first rows have new predecessors.  What looks at a channel's whole life starts from the day marts.
    """
    m = Marts(spark, folder, settings)
    before = {r.year for r in m.journal.select("year").distinct().collect()}  # partition names
    imported = [r.year for r in readers.import_journal(spark, sources.journal, f"{m.folder}/journal").collect()]
    return _roll_up(Marts(spark, folder, settings), sources, touched_years(imported, before))


def _roll_up(m: Marts, sources: Sources, years: list[int]) -> Marts:
    spark, s = m.spark, m.settings
    channels, objects = readers.read_channels(spark, sources.channels), readers.read_objects(spark, sources.objects)
    contract = readers.read_contract(spark, sources.contract)
    year = F.year("d")
    rows = m.journal.filter(F.col("year").isin(years)).drop("year")
    m.put("dim", lambda: rollup.with_twins(rollup.channel_dimension(channels, objects)))
    m.put_years("fact", rollup.fact_channel_day(rows, channels, contract), year)
    days = m.fact.filter(year.isin(years))
    m.put_years("object_day", rollup.fact_object_day(days, m.dim), year)
    m.put("profile", lambda: rollup.channel_profile(m.fact))
    m.put("domains", lambda: domains.logical_domains(m.dim))
    m.put("sweeps", lambda: labels.sweep_days(m.fact, m.dim, s.labelling))
    m.put("labels", lambda: labels.labels(labels.grid(m.dim, m.profile, s.labelling), m.fact, m.dim, m.sweeps, s.labelling))
    m.put("features", lambda: features.feature_matrix(m.labels, m.fact, m.dim, m.profile, m.domains))
    edges = m.put_years("edges", edge_rows(rows, m.dim))
    m.put_years("pump_day", pump_days(rows, edges, m.dim, years), year)
    m.put("pump_anomaly", lambda: pumps.pump_anomaly(m.pump_day, pumps.pump_baseline(m.pump_day), s.pumping))
    smoke = fire.smoke_events(rows, m.dim, s.smoke)
    m.put_years("smoke", smoke, year)
    m.put_years("fire_candidate", fire.fire_candidates(
        m.smoke.filter(year.isin(years)), fire.heat_events(rows, m.dim, s.smoke), m.domains, s.smoke), year)
    m.put_years("armed_interval", armed_intervals(rows, edges, m.dim, years))
    m.put("guard_health", lambda: intrusion.guard_health(m.armed_interval, s.guarding))
    m.put("intrusion_event", lambda: intrusion.intrusion_events(
        m.journal, m.dim, m.armed_interval, m.guard_health, s.guarding))
    m.put("temperature_day", lambda: thermal.temperature_day(m.fact, m.dim))
    m.put("temperature_state", lambda: thermal.temperature_state(
        m.temperature_day, thermal.monthly_norm(m.temperature_day), thermal.neighbour_norm(m.temperature_day)))
    m.put("calendar", lambda: calendar.calendar_of(m.fact.select("d", F.date_add("d", 60).alias("due"))))
    return m


def train(m: Marts, path: str) -> RandomForestClassificationModel:
    """Fit the failure ranker on the training period and save it."""
    cfg = m.settings.modelling
    rows = ranker.prepare(ranker.temporal_split(m.features, cfg)).filter("part = 'train'").persist()
    try:
        model = ranker.train_forest(rows, cfg)
    finally:
        rows.unpersist()
    ranker.save_model(model, path)
    return model


def load_model(path: str) -> RandomForestClassificationModel:
    return ranker.load_model(path)


def verdict_cards(m: Marts, model: RandomForestClassificationModel, day: str | None = None) -> DataFrame:
    """Cards of all four scenarios, titled and dated: of the asked day, or failures of the test period and every episode."""
    s, cfg = m.settings, m.settings.modelling
    name = f"-{day}" if day else ""
    first, last = (day, day) if day else (cfg.test_from, cfg.test_to)

    def asked(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("d") == F.lit(day).cast("date")) if day else rows

    period = m.features.filter(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    scored = ranker.score(model, ranker.prepare(period))
    head = m.put(f"scored_head{name}", lambda: verdicts.score_days(scored, m.dim, m.domains, s.cards.failure_limit))
    told = m.put(f"explained_head{name}", lambda: explain.top_evidence(
        explain.contributions(model, head), period, s.cards.evidence))
    change = explain.counterfactual(model, head, told).select("channel_id", "d", "counterfactual")
    failures = verdicts.failure_verdicts(head, told.join(change, ["channel_id", "d"], "left"), m.smoke, m.temperature_state,
                                         m.fact, m.dim)
    rows = (failures
            .unionByName(verdicts.pump_verdicts(asked(m.pump_anomaly), m.pump_day, pumps.network_days(m.pump_anomaly, s.pumping),
                                                m.dim, s.cards.pump_limit))
            .unionByName(verdicts.fire_verdicts(asked(m.fire_candidate), m.dim, s.cards.fire_limit))
            .unionByName(verdicts.intrusion_verdicts(asked(m.intrusion_event), m.calendar, s.cards.intrusion_limit, s.guarding)))
    made = cards.enrich(rows, m.fact)
    key = F.xxhash64("scenario", "d", "object_id", "picket", "channel_id")
    made = (made.withColumn("id", key).withColumn("status", F.lit(fv.STATUS_NEW))
            .withColumn("created_at", F.col("d").cast("string")))
    return cards.with_cascade(m.put(f"made_cards{name}", lambda: made), s.cards)


@dataclass(frozen=True)
class Desk:
    """What people decided about cards, and who they are; any table may be absent.

    decisions: verdict_id, action, reason_id, user_id, decided_at; reasons: reason_id, title; users: user_id, full_name,
    is_global; assignments: user_id, object_id.
    """

    decisions: DataFrame | None = None
    reasons: DataFrame | None = None
    users: DataFrame | None = None
    assignments: DataFrame | None = None

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        kinds = {"decisions": "verdict_id long, action string, reason_id int, user_id int, decided_at string",
                 "reasons": "reason_id int, title string", "users": "user_id int, full_name string, is_global boolean",
                 "assignments": "user_id int, object_id long"}
        found = getattr(self, name)
        return spark.createDataFrame([], kinds[name]) if found is None else found


def write_reports(spark: SparkSession, made: DataFrame, drafts: DataFrame, out: str, desk: Desk = Desk(),
                  feed_limit: int = 100) -> dict[str, str]:
    """Register, summaries, feeds per status and scenario, and counters of the cards, each as a table below ``out``."""
    users = desk.table(spark, "users")
    register = reports.verdict_register(made, desk.table(spark, "decisions"), desk.table(spark, "reasons"), users)
    path = readers.write_mart(register, f"{out}/register")
    register = readers.read_mart(spark, path)
    by_author = drafts.withColumn("author_id", F.lit(None).cast("int")).withColumn("created_at", F.col("d").cast("string"))
    tables = {
        "summary": reports.summary(register), "observability": reports.observability(register),
        "work_orders": reports.work_order_register(by_author, users), "feed": reports.verdict_feed(made, limit=feed_limit),
        "feed_new": reports.verdict_feed(made, status=fv.STATUS_NEW, limit=feed_limit),
        **{f"feed_{i}": reports.verdict_feed(made, scenario=k, limit=feed_limit) for i, k in enumerate(fv.SCENARIO_TITLE)},
        "visible_counts": reports.visible_counts(made, users, desk.table(spark, "assignments")),
        "queue_counters": reports.queue_counters(made), "object_scenarios": reports.object_scenario_matrix(made),
        "incubation": reports.incubation_histogram(made), "linear_scheme": reports.linear_scheme(made),
    }
    return {"register": path, **{n: readers.write_mart(df, f"{out}/{n}") for n, df in tables.items()}}


def publish(spark: SparkSession, m: Marts, model: RandomForestClassificationModel, out: str, day: str | None = None,
            desk: Desk = Desk()) -> dict[str, str]:
    """Write cards, multicards, work orders, reports and all exports, of the asked day or the test period; their paths by name."""
    out = out.rstrip("/")
    made = m.put(f"verdicts-{day}" if day else "verdicts", lambda: verdict_cards(m, model, day))
    lines = geometry.axis_lines(m.dim, m.settings.cards)
    shapes = geometry.object_geometry(cards.multicards(made), lines)
    points = geometry.verdict_points(made, lines)
    drafts = readers.write_mart(orders.drafts(made, m.calendar), f"{out}/orders")
    exports = {
        "cards": sinks.write_json(made.withColumn("card", verdicts.render_card()), f"{out}/cards"),
        "multicards": sinks.write_json(cards.multicard_documents(made, m.settings.cards), f"{out}/multicards"),
        "orders": drafts,
        "csv": sinks.write_lines(sinks.verdict_csv(made), f"{out}/verdicts-csv"),
        "xml": sinks.write_xml(made, f"{out}/verdicts-xml"),
        "geojson": sinks.write_geojson(shapes, points, f"{out}/geojson"),
        "wkt": sinks.write_lines(sinks.wkt_csv(shapes, points), f"{out}/wkt"),
    }
    told = write_reports(spark, made, readers.read_mart(spark, drafts), f"{out}/reports", desk)
    return {**exports, **{f"report_{n}": p for n, p in told.items()}}
