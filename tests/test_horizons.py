"""Labels of every horizon from one distance, and one matrix for all horizons against a run of its own for each."""

import datetime as dt
import random
import re
from dataclasses import replace

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from tritmarts.functions.written import written
from tritmarts.operators import labels, ranker, scores
from tritmarts.operators.features import feature_matrix
from tritmarts.plans.catalog_ranking import CFG, FIT, World
from tritmarts.settings import Labelling

SF = "/root/testdata/sf0.01"
DAY0 = dt.date(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def small(spark):
    draw = random.Random(7)
    facts = {(c, n): draw.random() < 0.05 for c in range(12) for n in range(200) if draw.random() < 0.6}
    fact = spark.createDataFrame([(c, day(n), 5, int(bad), 0) for (c, n), bad in facts.items()],
                                 "channel_id long, d date, n_ev long, n_fault long, n_disabled long")
    dim = spark.createDataFrame([(c, c % 3) for c in range(12)], "channel_id long, tag_base long")
    sweeps = spark.createDataFrame([(0, day(17)), (1, day(60)), (2, day(61))], "tag_base long, d date")
    off = {40, 41, 42, 90}  # days off the grid still fail
    days = spark.createDataFrame([(c, day(n)) for c in range(12) for n in range(200) if n not in off], "channel_id long, d date")
    own = {(c, n) for (c, n), bad in facts.items() if bad and (c % 3, n) not in {(0, 17), (1, 60), (2, 61)}}
    return days, fact, dim, sweeps, own


def test_distance_to_the_next_failure(small):
    days, fact, dim, sweeps, own = small
    got = {(r.channel_id, (r.d - DAY0).days): r.ahead for r in labels.days_to_failure(days, fact, dim, sweeps).collect()}
    assert len(got) == days.count()
    for (c, n), ahead in got.items():
        later = [m - n for k, m in own if k == c and m > n]
        assert ahead == min(later, default=labels.NO_FAILURE)


@pytest.mark.parametrize("hours", [24, 72, 168, 336])
def test_labels_are_comparisons(small, hours):
    days, fact, dim, sweeps, _ = small
    cfg = Labelling(horizon_hours=hours)
    ahead = labels.days_to_failure(days, fact, dim, sweeps)
    want = sorted(map(tuple, labels.labels(days, fact, dim, sweeps, cfg).collect()))
    assert sorted(map(tuple, labels.labels_within(ahead, cfg).collect())) == want and any(y for *_, y in want)


def one_tree(train, cfg):
    rows = ranker.balanced(ranker.assemble(train)).withColumn("y", F.col("y").cast("double"))
    return DecisionTreeClassifier(labelCol="y", weightCol="weight", maxDepth=4, minInstancesPerNode=cfg.min_leaf).fit(rows)


def test_sweep_equals_a_run_of_its_own(spark):
    """A decision tree of under 10,000 rows depends on nothing but its rows, so all metrics must agree."""
    world, horizons = World(spark, SF), [1, 7]
    fit = replace(FIT, train_from="1999-10-01")
    from tritmarts.operators.features import feature_matrix
    shared = feature_matrix(world.ahead.withColumnRenamed("ahead", "y"), world.fact, world.dim, world.profile, world.domains)
    got = {(r.horizon_hours, r.metric): r.value
           for r in scores.horizon_metrics(ranker.horizon_sweep(shared, horizons, fit, one_tree), 0.7).collect()}
    for n in horizons:
        own = World(spark, SF, Labelling(**{**CFG.__dict__, "horizon_hours": n * 24}))
        rows = written(ranker.prepare(ranker.temporal_split(own.features, fit)), "own_split")
        model = one_tree(rows.filter("part = 'train'"), fit)
        test = ranker.score(model, rows.filter("part = 'test'"))
        want = {(r.horizon_hours, r.metric): r.value for r in scores.horizon_metrics({n: test}, 0.7).collect()}
        assert {k: v for k, v in got.items() if k[0] == n * 24} == pytest.approx(want, rel=1e-9, nan_ok=True)
        assert want[n * 24, "positives"] > 0


def test_matrix_holds_every_split(spark):
    world, horizons = World(spark, SF), [1, 3]
    base = world.ahead.withColumnRenamed("ahead", "y").withColumns({n: F.lit(0.0) for n in ranker.fv.FEATURE_NAMES})
    told = ranker.horizon_matrix(base, horizons, FIT)
    for n in horizons:
        own = base.withColumn("y", labels.within(F.col("y"), n))
        want = ranker.temporal_split(own, FIT).groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
        got = told.agg(F.count_if(f"train_{n}").alias("train"), F.sum(F.when(F.col(f"train_{n}"), F.col(f"y_{n}"))).alias("train_y"),
                       F.count_if("is_test").alias("test"), F.sum(F.when(F.col("is_test"), F.col(f"y_{n}"))).alias("test_y")).first()
        assert {r.part: (r.n, r.y) for r in want} == {p: (got[p], got[f"{p}_y"]) for p in ("train", "test")}


def test_code_of_the_choice_is_short_enough_to_be_compiled(spark):
    """The JVM never compiles a method of more than 8,000 bytes."""
    world = World(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows no code before it runs
    try:
        rows = feature_matrix(world.ahead.withColumnRenamed("ahead", "y"), world.fact, world.dim, world.profile, world.domains)
        told = ranker.horizon_matrix(rows, [1, 3, 7, 14], FIT)
        explained = told._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explained)]
    assert sizes and max(sizes) < 8000
