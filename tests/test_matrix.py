"""The feature matrix: what is moved and computed for it, and its shares against plain counting."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators import controls, features, ranker
from tritmarts.plans import catalog_ranking, registry, store

DAY0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(11)
    places = {c: (draw.choice([1, 2, None]), draw.choice([5, 6, None]), f"S{c % 2}") for c in range(9)}
    facts = [(c, DAY0 + dt.timedelta(days=n), 3, draw.randrange(2), 0, draw.randrange(2), draw.choice([-1, 0, 1]))
             for c in places for n in range(30) if draw.random() < 0.7]
    y = [(c, DAY0 + dt.timedelta(days=n), int(draw.random() < 0.2)) for c in places for n in range(30)]
    return places, facts, (
        spark.createDataFrame(y, "channel_id long, d date, y int"),
        spark.createDataFrame(facts, "channel_id long, d date, n_ev long, n_fault long, n_disabled long, n_undefined long, trit_day int"),
        spark.createDataFrame([(c, *p) for c, p in places.items()], "channel_id long, object_id long, picket int, tag_base string"),
        spark.createDataFrame([(c, DAY0) for c in places], "channel_id long, first_day date"),
        spark.createDataFrame([(1, 5, 2)], "object_id long, picket int, n_channels long"))


def test_shares_against_plain_counting(world):
    places, facts, tables = world
    got = {(r.channel_id, r.d): r for r in features.feature_matrix(*tables).collect()}
    assert len(got) == 9 * 30
    for (c, d), r in got.items():
        here = [f for f in facts if f[1] == d and None not in places[c][:2] and places[f[0]][:2] == places[c][:2]]
        wired = [f for f in facts if f[1] == d and places[f[0]][2] == places[c][2]]
        want = (sum(f[6] == 1 for f in here), sum(f[6] == 0 for f in here), sum(f[3] > 0 for f in wired))
        n = (len(here) or 1, len(here) or 1, len(wired) or 1)
        assert (r.domain_dev_share_7d, r.domain_silent_share, r.base_failed_share_7d) == pytest.approx([a / b for a, b in zip(want, n)])


def test_only_labels_and_facts_are_dealt_and_two_passes_look_back(world):
    plan = features.feature_matrix(*world[2])._jdf.queryExecution()
    union = next(n for n in _nodes(plan.optimizedPlan()) if n.nodeName() == "Union")
    assert union.children().size() == 2
    assert sum(n.nodeName() == "Window" for n in _nodes(plan.optimizedPlan())) == 2


def _nodes(node):
    yield node
    for i in range(node.children().size()):
        yield from _nodes(node.children().apply(i))


def test_one_reading_writes_no_matrix(spark, world, monkeypatch):
    tables = dict(zip(("labels", "fact", "dim", "profile", "domains"), world[2]))
    for name, table in tables.items():
        monkeypatch.setattr(catalog_ranking.World, name, table)
    told = catalog_ranking.q14(spark, "rows of a test").collect()
    w = catalog_ranking.World(spark, "rows of a test")
    assert not store.is_stored(spark, w.sf, w.name("features"))
    assert told == catalog_ranking.tidy(controls.busiest_failure_day(w.features)).collect()
    assert store.is_stored(spark, w.sf, w.name("features"))
    assert w.matrix.inputFiles() == w.features.inputFiles() and w.matrix.filter(F.col("y").isNull()).isEmpty()


def test_prepared_and_rounded_code_is_short_enough_to_be_compiled(spark, world):
    """The JVM never compiles a method of more than 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows no code before it runs
    try:
        rows = registry.tidy(ranker.prepare(features.feature_matrix(*world[2])))
        explained = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explained)]
    assert sizes and max(sizes) < 8000


ODD = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -1.0, 3.0, 2.0 ** 60, 1e300, 0.1234565, -0.1234565, 0.5, 1 / 3, -2 / 3, 1234567.8912345, 5e-7, -1e-9]


def test_rounding_and_filling_of_odd_numbers(spark):
    rows = spark.createDataFrame([(i, *ODD[i:], *ODD[:i]) for i in range(len(ODD))], "i int, " + ", ".join(f"`x.{n}` double" for n in range(len(ODD))))
    names = [f"x.{n}" for n in range(len(ODD))]
    want = rows.select(F.col("i").cast("bigint"), *[F.round(F.col(f"`{n}`") + 1e-9, 6).alias(n) for n in names])
    assert list(map(repr, registry.tidy(rows).collect())) == list(map(repr, want.collect()))
    few = [f"`{n}`" for n in names[:registry.FEW]]
    assert list(map(repr, registry.tidy(rows.select(*few)).collect())) == list(map(repr, want.select(*few).collect()))
    named = spark.createDataFrame([(x,) * len(fv.FEATURE_NAMES) for x in ODD], ", ".join(f"{n} double" for n in fv.FEATURE_NAMES))
    filled = [-1.0 if x is None or not math.isfinite(x) else x for x in ODD]
    assert [tuple(r) for r in ranker.prepare(named).collect()] == [(x,) * len(fv.FEATURE_NAMES) for x in filled]
