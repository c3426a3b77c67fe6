"""Shared runs of words against all windows of all documents."""

import random
import re
from collections import defaultdict

import pytest

from tritmarts.llm import passages, runs


def test_against_all_windows(spark):
    draw = random.Random(6)

    def words(n):
        return [f"w{draw.randrange(5000)}" for _ in range(n)]

    run, copy = words(60), words(254)
    rows = [(-1, None), (-2, ""), (None, "short"), (1, " ".join(copy)), (2, "\n".join(" ".join(copy[i:i + 9]) for i in range(0, 254, 9)).upper()),
            (3, " ".join(words(80) + run + words(90))), (4, "\n".join([" ".join(words(70)), " ".join(words(20) + run + words(200))])),
            (5, " ".join(words(40) + run[:49] + words(40))), (6, " ".join(run[:50])), (7, " ".join(words(70) * 2)),
            (8, "é " * 60), (9, "é " * 70), (10, " ".join(words(30) + copy[100:160] + run[3:58])), (11, "x" * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, places string")
    got = runs.repeated_runs(df).collect()
    tokens = {d: (t or "").lower().split() for d, t in rows}
    seen = defaultdict(set)
    for d, w in tokens.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i:i + 50])].add(d)
    want = {(d, i + k) for d, w in tokens.items() for i in range(len(w) - 49) if len(seen[tuple(w[i:i + 50])]) > 1 for k in range(50)}
    assert sorted((r.doc_id, r.word + k) for r in got for k in range(r.n_words)) == sorted(want)
    texts = dict(rows)
    gone = {(r.doc_id, r.word + k) for r in got if r.removed for k in range(r.n_words)}
    for r in got:
        assert re.split(r"\s+", texts[r.doc_id][r.start:r.end].lower()) == tokens[r.doc_id][r.word:r.word + r.n_words]
        assert tokens[r.kept_doc_id][r.kept_word:r.kept_word + r.n_words] == tokens[r.doc_id][r.word:r.word + r.n_words]
        assert r.removed == ((r.doc_id, r.word) != (r.kept_doc_id, r.kept_word))
    assert {d for d, _ in gone} == {2, 4, 6, 9, 10}
    assert not {(r.doc_id) for r in passages.repeated_passages(df).collect()} & {2, 3, 4}  # what lines alone do not see


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    assert runs.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
