"""Quantiles by rank selection against Spark's own aggregate and hand-made cases."""

import random

from pyspark.sql import functions as F

from tritmarts.functions.quantiles import grouped_quantiles
from tritmarts.operators import calibration

NAMED = {"least": 0.0, "p10": 0.1, "median": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}


def test_equal_to_percentile(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([0, 1]), draw.choice([None, draw.random() * 10 ** draw.randint(-3, 6), 7.0]))
            for _ in range(5000)] + [("single", 0, 3.25), ("none", 0, None), ("b", 2, float("inf"))]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    want = df.filter("v IS NOT NULL").groupBy("k", "j").agg(*[F.percentile("v", p).alias(n) for n, p in NAMED.items()])
    got = grouped_quantiles(df, ["k", "j"], F.col("v"), NAMED)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ("none", 0) not in {(r.k, r.j) for r in got.collect()}


def test_whole_table(spark):
    df = spark.createDataFrame([(i * 37 % 1001,) for i in range(1001)], "v int")
    assert grouped_quantiles(df, [], F.col("v"), {"m": 0.5, "p": 0.9}).collect() == [(500.0, 900.0)]
    assert grouped_quantiles(df.filter("false"), [], F.col("v"), {"m": 0.5}).collect() == []


def test_no_group_is_gathered(spark):
    """A group of many values is many slices: nothing but counts and sums by key reaches the last task."""
    df = spark.range(50_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 49_999).alias("v"))
    assert grouped_quantiles(df, ["k"], F.col("v"), {"m": 0.5}).first().m == df.agg(F.percentile("v", 0.5)).first()[0]


def test_statistics_of_nothing(spark):
    pumps = calibration.pump_statistics(spark.createDataFrame([], "n_starts long"))
    assert [tuple(r) for r in pumps.collect()] == [(None,) * 5] and pumps.columns == ["mean", "median", "p90", "p99", "max"]
    events = spark.createDataFrame([], "n_triggers long, n_types int, first_t int, last_t int, is_night boolean")
    assert [tuple(r) for r in calibration.intrusion_statistics(events).collect()] == [(None,) * 5]
