"""Hand-computed cases for trits, numbers, wording and ordered helpers."""

import random

import pytest
from pyspark.sql import functions as F

from tritmarts import fixed_values as fv
from tritmarts.functions import text, trits
from tritmarts.functions.numbers import clock, measured, moment, to_number
from tritmarts.functions import ordering
from tritmarts.functions.ordering import running_totals, with_nearest, with_neighbour
from tritmarts.operators import geometry


def column(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_confirm_and_escalate(spark):
    pairs = [(1, -1), (1, 1), (1, 0), (0, -1), (-1, 1), (None, 1)]
    got = column(spark, pairs, "a int, b int", trits.confirm(F.col("a"), F.col("b")), trits.escalate(F.col("a"), F.col("b")))
    assert got == [(-1, 1), (1, 1), (0, 1), (-1, 0), (-1, 1), (0, 1)]


def test_negate_and_known(spark):
    got = column(spark, [(1,), (0,), (-1,)], "a int", trits.negate(F.col("a")), trits.is_known(F.col("a")))
    assert got == [(-1, True), (0, False), (1, True)]


def test_zscore_is_two_sided_and_blind_without_value(spark):
    got = column(spark, [(2.0,), (-2.5,), (1.9,), (float("nan"),), (None,)], "z double", trits.of_zscore(F.col("z")))
    assert got == [(1,), (1,), (-1,), (0,), (0,)]


def test_staleness(spark):
    rows = [(101.0, 10.0), (99.0, 10.0), (5.0, 0.0), (None, 10.0), (5.0, None)]
    got = column(spark, rows, "a double, i double", trits.of_staleness(F.col("a"), F.col("i")))
    assert got == [(1,), (-1,), (0,), (0,), (0,)]


def test_confirmation_sentences(spark):
    rows = [(1, 1), (1, 0), (0, 1), (1, -1), (-1, 1), (-1, -1)]
    said = [r[0] for r in column(spark, rows, "a int, b int", trits.confirmation_sentence(
        F.lit("А"), F.col("a"), F.lit("Б"), F.col("b")))]
    assert said[0].startswith("подтверждено: А и Б")
    assert said[1].startswith("подтвердить нечем: А показывает отклонение, но Б недоступен")
    assert said[2].startswith("подтвердить нечем: Б показывает отклонение, но А недоступен")
    assert said[3].startswith("не подтверждено: А сработал, но Б в норме")
    assert said[4].startswith("не подтверждено: Б сработал, но А в норме")
    assert said[5] == "норма: А и Б в пределах нормы"


def test_numbers(spark):
    raw = [("12,5",), ("-127",), ("151",), ("5d",), ("1e1",), ("Норма",), (" 7 ",), (None,), ("-40",)]
    got = column(spark, raw, "v string", to_number(F.col("v")), measured(F.col("v")))
    assert got == [(12.5, 12.5), (-127.0, None), (151.0, None), (None, None), (10.0, 10.0), (None, None), (7.0, 7.0),
                   (None, None), (-40.0, -40.0)]


def test_clock_and_moment(spark):
    got = column(spark, [("2024-01-05", 3661), ("2024-01-05", None)], "d string, t int", clock(F.col("t")),
                 moment(F.to_date("d"), F.col("t")))
    assert got == [("01:01:01", "2024-01-05T01:01:01"), (None, None)]


@pytest.mark.parametrize("n,form", [(0, "many"), (1, "one"), (2, "few"), (4, "few"), (5, "many"), (11, "many"), (12, "many"),
                                    (14, "many"), (21, "one"), (22, "few"), (25, "many"), (101, "one"), (111, "many"), (1002, "few")])
def test_noun_agreement(spark, n, form):
    assert column(spark, [(n,)], "n int", text.agree(F.col("n"), ("one", "few", "many"))) == [(form,)]


def test_rounding_goes_to_even(spark):
    got = column(spark, [(2.5,), (3.5,), (0.145,)], "x double", text.whole(F.col("x")), text.percent(F.col("x")))
    assert got == [("2", "250%"), ("4", "350%"), ("0", "14%")]


def test_every_class_has_a_state(spark):
    got = dict(column(spark, [(c,) for c in fv.CLASS_TRIT] + [("новый класс",)], "c string", "c", trits.of_class(F.col("c"))))
    assert got == {**fv.CLASS_TRIT, "новый класс": 0}


def brute_previous(rows):
    out, last = {}, {}
    for ch, t in sorted(rows):
        out[(ch, t)] = last.get(ch)
        last[ch] = t
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_neighbour_across_segments_matches_brute_force(spark, parts):
    rows = [(ch, (ch * 37 + i * i * 13) % 500) for ch in range(4) for i in range(25)] + [(9, i) for i in range(200)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "ch int, t int").repartition(parts).withColumn("seg", F.floor(F.col("t") / 10))
    got = {(r.ch, r.t): (r.prev.t if r.prev else None) for r in with_neighbour(df, ["ch"], "seg", ["t"], ["t"]).collect()}
    assert got == brute_previous(rows)
    ahead = {(r.ch, r.t): (r.nx.t if r.nx else None)
             for r in with_neighbour(df, ["ch"], "seg", ["t"], ["t"], "nx", forward=True).collect()}
    assert {(c, n): t for (c, t), n in ahead.items() if n is not None} == {k: v for k, v in got.items() if v is not None}


def test_running_totals_match_a_global_sort(spark):
    rows = [(i, (i * 7919 % 101) / 101.0, i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s double, n int")
    got = {r.id: r.n_cum for r in running_totals(df, [F.col("s").desc(), F.col("id")], ["n"]).collect()}
    total, want = 0, {}
    for i, _, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += n
        want[i] = total
    assert got == want


def exchanges(df):
    """Exchanges of the plan, and of the plans of tables written on the way."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in line]


def test_running_totals_move_rows_twice(spark, monkeypatch):
    """Dealt by ranges once and by slices once, for one sort column or five; the sums of slices move beside."""
    plans = []
    plain = ordering.written
    monkeypatch.setattr(ordering, "written", lambda df, name: (plans.append(df), plain(df, name))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for width in (1, 5):
            df = spark.range(1000).select("id", F.lit("k").alias("k"), *[F.pmod("id", F.lit(w + 2)).alias(f"o{w}") for w in range(width)])
            out = running_totals(df, [F.col(f"o{w}") for w in range(width)] + [F.col("id")], ["id"], key=["k"])
            assert len(exchanges(plans[-1])) == 1
            # the rows by slice; the sums by slice, then by key to see what is before, then back to the rows
            assert len(exchanges(out)) == 4
            assert [r.id_cum for r in out.orderBy(F.desc("id_cum")).limit(1).collect()] == [999 * 500]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_one_hot_key_is_many_slices(spark):
    rows = spark.range(20_000).select("id", F.lit("hot").alias("k"), F.lit(1).cast("long").alias("one"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = running_totals(rows, [F.col("id")], ["one"], key=["k"])
        assert dealt.where("one_cum <> id + 1").count() == 0
        slices = rows.repartitionByRange("k", "id").withColumn("s", F.spark_partition_id()).groupBy("s").count().collect()
        assert len(slices) == 4 and max(r["count"] for r in slices) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("reach", [0, 3, 50])
def test_nearest_marks_of_both_sides(spark, reach):
    draw = random.Random(reach)
    marks = sorted({(draw.choice("ab"), draw.randrange(60)) for _ in range(25)})
    points = sorted({(draw.choice("abc"), draw.randrange(60)) for _ in range(120)})
    got = with_nearest(spark.createDataFrame(points, "k string, at int"),
                       spark.createDataFrame([(k, p, f"{k}{p}") for k, p in marks], "k string, at int, label string"), ["k"], "at", ["label"], reach)
    want = {}
    for k, p in points:
        near = min(((abs(q - p), q) for j, q in marks if j == k and abs(q - p) <= reach), default=None)
        want[k, p] = near and (*near, f"{k}{near[1]}")
    rows = got.collect()
    assert len(rows) == len(points) and {(r.k, r["at"]): r.nearest and tuple(r.nearest) for r in rows} == want


def test_place_stems_are_counted_in_one_pass(spark):
    stems = [stem.lower() for stem, _, _ in fv.DISTRICT_ANCHORS]
    assert not any(a != b and b.startswith(a) for a in stems for b in stems)
    draw = random.Random(1)
    rows = [(draw.choice("xyz"), "".join(draw.choice([draw.choice(stems), draw.choice(stems)[:-1].upper(), " ", "-", "1"]) for _ in range(8)))
            for _ in range(300)] + [("none", "nothing"), ("none", None)]
    dim = spark.createDataFrame([(n, n, s, 1) for n, s in rows], "parent_name string, object_name string, sensor_name string, picket int")
    counts = {}
    for n, s in rows:
        for i, stem in enumerate(stems):
            counts.setdefault(n, [0] * len(stems))[i] += (s or "").lower().count(stem)
    want = {n: fv.DISTRICT_ANCHORS[max(range(len(c)), key=lambda i: (c[i], -i))][0] if max(c) else None for n, c in counts.items()}
    out = geometry.toponyms(dim)
    assert {r.object_name: r.toponym for r in out.collect()} == want
    assert "replace(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_scratch_is_removed_when_asked(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from tritmarts.functions import written as scratch
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(scratch, "_MADE", {})
    df = scratch.written(spark.range(10), "numbers")
    kept = tmp_path / "of-others"
    kept.mkdir()
    assert df.count() == 10 and len(list(Path(tmp_path).glob("numbers-*"))) == 1
    assert scratch.remove_scratch(spark) == 1 and list(tmp_path.iterdir()) == [kept]
    assert scratch.remove_scratch(spark) == 0
