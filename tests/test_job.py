"""The whole job from source CSV files to exports, on the smallest sample."""

import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tritmarts import fixed_values as fv, job
from tritmarts.functions.numbers import clock
from tritmarts.plans import samples
from tritmarts.session import local_scratch
from tritmarts.settings import Guarding, Labelling, Modelling, Pumping, Smoke
from tritmarts.sources import readers

SF = "/root/testdata/sf0.001"


def _write(df, columns, path):
    titles = {v: k for k, v in columns.items()}
    df.select(*[F.col(c).alias(titles[c]) for c in titles]).write.option("header", True).option("escape", '"').csv(path)
    return path


def _joined(path):
    return "".join(p.read_text(encoding="utf-8-sig") for p in sorted(Path(path).glob("part-*")))


def test_sources_to_exports(spark, tmp_path):
    folder = str(tmp_path)
    sources = job.Sources(
        _write(samples.journal(spark, SF).withColumn("t", clock(F.col("t_sec"))), readers.JOURNAL_COLUMNS, f"{folder}/journal"),
        _write(samples.channels(spark, SF), readers.CHANNEL_COLUMNS, f"{folder}/channels"),
        _write(samples.objects(spark, SF), readers.OBJECT_COLUMNS, f"{folder}/objects"),
        _write(samples.contract(spark), readers.CONTRACT_COLUMNS, f"{folder}/contract"))
    settings = job.Settings(
        labelling=Labelling(sweep_min_channels=40, artifact_periods=(), blackout_days=()),
        modelling=Modelling(train_from="2024-01-01", train_to="2024-01-20", test_from="2024-01-21", test_to="2024-01-31", trees=5, depth=4),
        pumping=Pumping(min_starts=1, min_excess=1, min_days=1), smoke=Smoke(sweep_share=0.9), guarding=Guarding(stuck_min_switches=1))
    marts = job.build_marts(spark, sources, f"{folder}/marts", settings)
    assert marts.journal.count() == samples.journal(spark, SF).count()
    model = job.train(marts, f"{folder}/model")
    again = job.load_model(f"{folder}/model")
    assert again.getNumTrees == model.getNumTrees == 5 and again.toDebugString == model.toDebugString
    out = job.publish(spark, job.Marts(spark, f"{folder}/marts", settings), again, f"{folder}/out")
    found = [json.loads(line) for p in Path(out["cards"]).glob("part-*") for line in p.read_text().splitlines()]
    assert {c["scenario"] for c in found} >= {fv.FAILURE}
    documents = [json.loads(line) for p in Path(out["multicards"]).glob("part-*") for line in p.read_text().splitlines()]
    assert sum(len(d["cards"] or []) for d in documents) == len(found)
    verdicts = ET.fromstring(_joined(out["xml"]))
    assert int(verdicts.get("count")) == len(verdicts) == len(found)
    shapes = json.loads(_joined(out["geojson"]))
    assert shapes["type"] == "FeatureCollection" and "CRS84" in shapes["crs"]["properties"]["name"]
    assert _joined(out["csv"]).count("\n") >= len(found) + 1


def test_scratch_needs_a_shared_folder_outside_one_process():
    assert local_scratch("local[4]")
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://x"):
        with pytest.raises(RuntimeError):
            local_scratch(master)
