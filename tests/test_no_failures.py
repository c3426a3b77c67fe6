"""Training where the period holds no failure, so that no row is left to learn from."""

from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators import explain, ranker
from tritmarts.settings import Modelling

CFG = Modelling(train_from="2020-01-01", train_to="2020-01-05", test_from="2020-01-06", test_to="2020-01-09", trees=3, depth=2)


def _days(spark, y):
    return (spark.range(40).select((F.col("id") % 4).alias("channel_id"),
                                   F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("d"), y.alias("y"),
                                   *[(F.col("id") * (i + 1) % 7).cast("double").alias(n) for i, n in enumerate(fv.FEATURE_NAMES)]))


def _parts(spark, y):
    rows = ranker.prepare(ranker.temporal_split(_days(spark, y), CFG))
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


def test_without_failures_every_score_is_zero(spark):
    train, test = _parts(spark, F.lit(0))
    assert train.count() == 0
    forest, linear = ranker.train_forest(train, CFG), ranker.train_linear(train)
    for model in (forest, linear):
        told = ranker.score(model, test).select("channel_id", "d", "score").collect()
        assert len(told) == 16 and {r.score for r in told} == {0.0}
    assert {r.s for r in test.select(ranker.linear_score(linear).alias("s")).collect()} == {0.0}
    nodes = explain.node_table(forest, spark).collect()
    assert [(r.tree, r.left, r.share, r["rows"]) for r in sorted(nodes)] == [(t, -1, 0.0, 20) for t in range(3)]
    told = explain.contributions(forest, ranker.score(forest, test)).collect()
    assert len(told) == 16 and all(r.bias == 0.0 and not any(r.contrib) for r in told)


def test_with_failures_alone_every_score_is_one(spark):
    train, test = _parts(spark, F.lit(1))
    assert train.count() == 20
    for model in (ranker.train_forest(train, CFG), ranker.train_linear(train)):
        assert {r.score for r in ranker.score(model, test).select("score").collect()} == {1.0}


def test_horizons_without_failures(spark):
    rows = _days(spark, F.lit(None).cast("int"))
    scored = ranker.horizon_sweep(rows, [1, 3], CFG)
    assert {d: {r.score for r in df.collect()} for d, df in scored.items()} == {1: {0.0}, 3: {0.0}}
