"""Steps whose tasks stay small: the day roll-up, incidents against their truth, written exports."""

import datetime as dt

from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators import controls, marts
from tritmarts.sources import sinks
from tritmarts.sources.literal import inline_table

DAY = dt.date(2024, 1, 1)


def test_journal_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(marts, "SLICE_ROWS", 25, raising=False)
    i = F.col("id")
    journal = spark.range(200).select(
        (i % 3).alias("channel_id"), F.date_add(F.lit(DAY), (i % 10).cast("int")).alias("d"), i.cast("int").alias("t_sec"),
        (i % 2 == 0).alias("is_alarm"), F.when(i % 5 == 0, "Неисправен").otherwise("Норма").alias("raw_value"))
    channels = spark.range(3).select(i.alias("channel_id"), F.lit(fv.GAS).alias("sensor_type"))
    contract = inline_table(spark, [(fv.GAS, "Неисправен", fv.FAULT), (fv.GAS, "Норма", fv.NORM)], ["sensor_type", "raw_value", "cls"])
    fact = marts.fact_channel_day(journal, channels, contract)
    assert fact.rdd.getNumPartitions() == 8
    rows = fact.collect()
    assert len(rows) == 30 and sum(r.n_ev for r in rows) == 200
    assert (sum(r.n_fault for r in rows), sum(r.n_norm for r in rows), sum(r.n_alarm for r in rows)) == (40, 160, 100)


def _incidents(spark, truth, triggers):
    """Metrics of true events (event_no, picket) and triggers (picket, sensor type) of one day of smoke."""
    truth = inline_table(spark, [(n, "задымление", DAY, p) for n, p in truth], ["event_no", "scenario", "d", "picket"])
    fact = inline_table(spark, [(c, DAY, 1) for c in range(len(triggers))], ["channel_id", "d", "n_trigger"])
    dim = inline_table(spark, [(c, p, kind) for c, (p, kind) in enumerate(triggers)], ["channel_id", "picket", "sensor_type"])
    smoke = inline_table(spark, [(DAY, False)], ["d", "is_sweep"])
    return controls.incident_metrics(truth, fact, dim, smoke)


def test_incidents_of_one_place_share_what_is_seen_there(spark):
    """Events 1 and 2 see two types; 3 sees one type twice; 4 stands at two places with a type each; 5 sees nothing."""
    out = _incidents(spark, [(1, 10), (2, 10), (3, 20), (4, 30), (4, 40), (5, 60)],
                     [(8, fv.SMOKE), (12, fv.HEAT), (19, fv.SMOKE), (21, fv.SMOKE), (30, fv.SMOKE), (41, fv.HEAT), (80, fv.HEAT)])
    row = out.filter("scenario = 'задымление'").first()
    assert (row.events, row.detected, row.confirmed, row.false_alarms) == (6, 4, 3, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    assert not any("Generate explode(sequence(" in line and "event_no" in line for line in plan.split("\n"))


def test_exports_can_be_written_compressed(spark, tmp_path):
    cards = spark.range(20).select(F.col("id"), F.lit("отказ").alias("scenario"), F.lit(None).cast("string").alias("title"))
    plain = sinks.write_json(cards, str(tmp_path / "plain"))
    packed = sinks.write_json(cards, str(tmp_path / "packed"), "gzip")
    assert list((tmp_path / "packed").glob("part-*.json.gz")) and not list((tmp_path / "packed").glob("part-*.json"))
    assert list((tmp_path / "plain").glob("part-*.json"))
    shape = "id long, scenario string, title string"
    told = [sorted(map(tuple, spark.read.schema(shape).json(at).collect())) for at in (plain, packed)]
    assert told[0] == told[1] == [(n, "отказ", None) for n in range(20)]
    lines = sinks.write_lines(spark.createDataFrame([("а",), ("б",)], "value string"), str(tmp_path / "lines"), "\n", "gzip")
    assert sorted(r.value for r in spark.read.text(lines).collect()) == ["а", "б"]
