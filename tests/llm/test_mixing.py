"""The mixture against plain resharing, its bounds, and the draws of the splitting tree."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tritmarts.llm import mixing, oracles


def reshared(sizes):
    """Targets by sharing out again what is above the ceilings, until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def table(spark, seed, n=400):
    draw = random.Random(seed)
    rows = [(None, None, "a"), (5, "", None), (6, "one two\x0bthree\x1ffour five", None), (6, "one two\x0bthree\x1ffour five", None)]
    for i in range(n):
        source = draw.choice(["hot"] * 6 + ["a", "b", "Ä", "z", "𐀀", "￮", None])
        rows.append((100 + i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.choice([0, 1, 5, 80, 300]))), source))
    return rows, spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                       "doc_id long, text string, source string, size int, block string, shards int")


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_draws(spark, seed):
    rows, df = table(spark, seed)
    got = mixing.report(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    want = reshared(sizes)
    by_id = {i: (t, s) for i, t, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        text, source = by_id[r.doc_id]
        assert r.size == size(text) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], 2 * r.size)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source]
    assert sorted(map(str, mixing.report(df.repartition(7)).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("make", [lambda i, s: (None, "w " * 50), lambda i, s: (7, "w " * 50), lambda i, s: (None, f"{i} " * 50),
                                  lambda i, s: (7, "w " * (40 if i % 3 else 60))])
def test_rows_that_are_alike_meet_the_target(spark, make):
    """Null ids, one id repeated, equal texts: the words taken come within a document of the target."""
    rows = [(*make(i, s), "abcd"[s]) for s, n in enumerate([600, 1000, 1400, 1000]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.report(df).collect()
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    sources = {}
    for _, text, source in rows:
        sources.setdefault(source, 0)
        sources[source] += len(text.split())
    want = reshared(sources)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[round(r.target, 3)] += r.taken
        target[round(r.target, 3)] = r.target
    goal = defaultdict(float)
    for w in want.values():
        goal[round(w, 3)] += w
    assert set(taken) == set(goal)
    for t in goal:
        assert abs(taken[t] - goal[t]) <= 60 * 2
    assert sorted(map(str, mixing.report(df.repartition(3)).collect())) == sorted(map(str, got))
    documents = df.toArrow()  # noqa: F841, the SQL reads it
    stated = duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({oracles.OP1})").fetchall()
    assert Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == Counter(stated)


def test_mixture_holds_the_draws(spark):
    _, df = table(spark, 3, 150)
    want = defaultdict(int)
    for r in mixing.drawn(df).select("row.doc_id", "shards").collect():
        want[r.doc_id] += len(r.shards)
        assert all(0 <= s < 64 for s in r.shards)
    mixed = mixing.mixture(df)
    assert mixed.columns == df.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in want.items() if v}


def test_tree_keeps_quotas_and_draws_without_replacement(spark):
    quotas = {"a": 1000, "b": 50, "c": 7, "d": 0, "e": 2000}
    df = spark.createDataFrame(list(quotas.items()), "skey string, quota long")
    first = []
    for seed in range(40):
        starts = {r.skey: r.starts for r in mixing.splitting_tree(df, 3, seed).collect()}
        counts = {k: [b - a for a, b in zip(s, [*s[1:], quotas[k]])] for k, s in starts.items()}
        assert all(len(c) == 8 and min(c) >= 0 and sum(c) == quotas[k] for k, c in counts.items())
        whole = [sum(c[i] for c in counts.values()) for i in range(8)]
        assert max(whole) - min(whole) <= 1  # 3057 blocks in 8 shards
        first.append(sum(counts["a"][:4]))
    mean = sum(first) / len(first)
    spread = sum((x - mean) ** 2 for x in first) / (len(first) - 1)
    total, good = sum(quotas.values()), quotas["a"]
    wanted = (total // 2) * good / total * (1 - good / total) * (total - total // 2) / (total - 1)
    assert abs(mean - 500) < 4 * (wanted / len(first)) ** 0.5
    assert 0.4 * wanted < spread < 2 * wanted


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.report(empty).collect() == [] and mixing.mixture(empty).collect() == []
