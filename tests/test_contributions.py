"""Contributions of trees: how their rows reach Python, and rows with gaps."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.operators import explain, ranker
from tritmarts.sources.literal import inline_table


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contributions_travel_as_arrow(spark):
    nodes = inline_table(spark, [(0, 0, 1, 2, 0, 1.0, 0.3), (0, 1, -1, -1, -1, 0.0, 0.1), (0, 2, -1, -1, -1, 0.0, 0.6)],
                         ["tree", "node", "left", "right", "feature", "threshold", "share"])
    first = fv.FEATURE_NAMES[0]
    rows = inline_table(spark, [(1, "2020-01-01", 0.5, 1.0), (2, "2020-01-02", None, 1.5), (None, None, 0.0, None)],
                        ["channel_id", "d", "score", first]).select(
        F.col("channel_id").cast("int").alias("channel_id"), F.col("d").cast("date").alias("d"), F.col("score").cast("double").alias("score"),
        F.col(first).cast("double").alias(first), *[F.lit(0).alias(n) for n in fv.FEATURE_NAMES[1:]])
    out = explain.contributions_of(nodes, rows, 3)
    assert "MapInArrow" in _plan(out)
    told = {r.channel_id: r for r in out.collect()}
    assert told[1].d == datetime.date(2020, 1, 1) and told[2].score is None and told[None].d is None
    assert {k: round(r.contrib[0], 9) for k, r in told.items()} == {1: -0.2, 2: 0.3, None: 0.3}
    assert all(np.isclose(r.bias, 0.3) and not any(r.contrib[1:]) and len(r.contrib) == len(fv.FEATURE_NAMES) for r in told.values())


def _tree(spark, rows):
    return inline_table(spark, rows, ["tree", "node", "left", "right", "feature", "threshold", "share"])


def _days(spark, keys):
    """Rows whose features differ by row, some of them NULL."""
    rows = [(c, f"2020-01-{d:02d}", (i % 2), *[None if (i + j) % 5 == 0 else float((i * 3 + j) % 7) for j in range(len(fv.FEATURE_NAMES))])
            for i, (c, d) in enumerate(keys)]
    table = inline_table(spark, rows, ["channel_id", "d", "y", *fv.FEATURE_NAMES])
    return table.select(F.col("channel_id").cast("long").alias("channel_id"), F.col("d").cast("date").alias("d"), F.col("y").cast("int").alias("y"),
                        *[F.col(n).cast("double").alias(n) for n in fv.FEATURE_NAMES])


SPLITS = [(0, 0, 1, 2, 3, 2.0, 0.3), (0, 1, -1, -1, -1, 0.0, 0.1), (0, 2, -1, -1, -1, 0.0, 0.6),
          (1, 0, 1, 2, 13, 3.0, 0.2), (1, 1, -1, -1, -1, 0.0, 0.4), (1, 2, -1, -1, -1, 0.0, 0.1), (2, 0, -1, -1, -1, 0.0, 0.5)]


def test_evidence_in_place_is_that_of_the_join(spark):
    """Rows alone with their channel and day are told without a join; the others are set apart, those without a key left out."""
    rows = _days(spark, [(1, 1), (1, 2), (2, 1), (3, 1), (3, 1), (None, 4), (4, 2), (5, 2)])
    alone, shared = explain.by_repetition(rows)
    assert sorted(r.channel_id for r in alone.collect()) == [1, 1, 2, 4, 5]
    assert [r.channel_id for r in shared.collect()] == [3, 3]
    assert explain.by_repetition(alone)[0].count() == 5 and explain.by_repetition(alone)[1].count() == 0
    nodes = _tree(spark, SPLITS)
    beside = ranker.prepare(alone.select("*", F.struct(*fv.FEATURE_NAMES).alias("raw"))).withColumn("score", F.lit(0.0))
    got = explain.evidence_in_place(nodes, beside, "raw", len(SPLITS))
    assert "MapInArrow" in _plan(got) and "Join" not in _plan(got).split("MapInArrow")[0]
    told = explain.contributions_of(nodes, ranker.prepare(alone).withColumn("score", F.lit(0.0)), len(SPLITS))
    want = explain.top_evidence(told, alone).filter(F.size("evidence") > 0)
    assert sorted(map(repr, got.drop("contrib").collect())) == sorted(map(repr, want.collect())) and not want.isEmpty()


def test_ablation_looks_only_at_trees_that_met_a_change(spark):
    """Scores and walks as by walking every tree anew; the rows reach Python as Arrow."""
    x = np.array([[float((i * 5 + j) % 7) for j in range(len(fv.FEATURE_NAMES))] for i in range(50)])
    trees = explain._trees(_tree(spark, SPLITS).toPandas())
    once = explain._Rescored(trees, x)
    for places in ([3], [13], [3, 13], [5], []):
        muted = x.copy()
        muted[:, places] = 0.0
        score, walked = once.after(muted)
        assert (score == explain._Rescored(trees, muted).score).all()
        assert walked.tolist() == [sum(p in places and row[p] != 0 for p in (3, 13)) for row in x]
    assert once.after(x)[0] is not once.score
    rows = ranker.prepare(_days(spark, [(c, d) for c in range(4) for d in range(1, 29)]))
    seen, kept = [], explain.written
    try:
        explain.written = lambda df, name: seen.append(df) or kept(df, name)
        told = explain.group_ablation_of(_tree(spark, SPLITS), rows, len(SPLITS)).collect()
    finally:
        explain.written = kept
    assert "MapInArrow" in _plan(seen[0]) and len(told) == 6
