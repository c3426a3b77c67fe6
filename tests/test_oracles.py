"""Every registered query with an oracle agrees with it on the smallest sample."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


# one or two queries of each area; tools/check_oracle.py runs all of them
PICKED = ["c1_classify", "c4_refine_normal", "e2_twin_groups", "e3_fact_channel_day", "e6_twin_synchrony", "l5_labels_72h",
          "f6_feature_matrix", "p3_pump_anomaly",
          "h5_fire_verdicts", "h8_intrusion_events", "t4_temperature_state", "k4_due_dates", "v5_temperature_evidence",
          "v6_precedents", "d1_sign_onsets", "d7_merged_timeline", "d8_cascades", "o4_drafts", "g3_picket_positions",
          "r2_summary", "q11_incident_metrics", "s6_verdict_csv",
          "e7_synchrony_buckets", "q1_sensor_behaviour", "q5_pump_statistics",
          "q5_intrusion_statistics", "g1_toponyms", "d6_ranked_cards", "x3_wide_trees", "x4_small_trees", "x5_small_trees"]


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
