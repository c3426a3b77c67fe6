"""Repeated paragraphs against all pairs."""

import random

import numpy as np
import pytest

from tritmarts.llm import passages


def words_of(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def plain_sets(line):
    w = line.encode().lower().split()  # ASCII letters only
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_against_all_pairs(spark):
    draw = random.Random(1)
    rows = [(-1, None), (-2, ""), (None, "short"), (5000, "\n\n"), (5001, "x" * 50000)]
    base = [words_of(draw, draw.randint(50, 130)) for _ in range(12)]
    for i in range(60):
        lines = [" ".join(words_of(draw, draw.choice([5, 30, 60, 90]))) for _ in range(draw.randint(0, 3))]
        if draw.random() < 0.6:
            w = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 2, 6])):
                w[draw.randrange(len(w))] = f"e{draw.randrange(9999)}"
            lines.insert(draw.randint(0, len(lines)), ("  " if i % 7 == 0 else "") + " ".join(w).upper() if i % 5 == 0 else "\t".join(w))
        rows.append((i, "\n".join(lines)))
    alone = " ".join(words_of(draw, 70))
    rows += [(7000, alone + "\n" + alone), (3, rows[8][1]), (8000, "é " * 60), (8001, "É " * 60), (8002, "é " * 60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, cluster_id int")
    got = passages.repeated_passages(df).collect()

    lines = [(d, p, line) for d, t in rows for p, line in enumerate((t or "").split("\n")) if len(line.split()) >= 50]
    sets = [plain_sets(line) for *_, line in lines]
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {}
    for g in set(group):
        members = [lines[i] for i in range(len(lines)) if group[i] == g]
        if len({d for d, *_ in members}) > 1:
            kept = min((d, p) for d, p, _ in members)
            for d, p, _ in members:
                want[d, p] = (kept, (d, p) != kept)
    assert {(r.doc_id, r.paragraph) for r in got} == set(want)
    assert all(((r.kept_doc_id, r.kept_paragraph), r.removed) == want[r.doc_id, r.paragraph] for r in got)
    texts = {d: t for d, t in rows if d != 3}
    assert all(len(texts[r.doc_id][r.start:r.end].split()) == r.n_words for r in got if r.doc_id != 3)
    out = {r.doc_id: r.text for r in passages.without_passages(df).collect()}
    for d, t in rows:
        left = [line for p, line in enumerate((t or "").split("\n")) if not want.get((d, p), (0, False))[1]]
        assert out[d] == (None if t is None else "\n".join(left))


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8 ** passages.ROWS) ** passages.BANDS >= passages.RECALL
    draw = np.random.default_rng(2)
    hit = 0
    for _ in range(300):
        both, a, b = draw.integers(0, 2**63, 160, dtype=np.uint64), draw.integers(0, 2**63, 20, dtype=np.uint64), draw.integers(0, 2**63, 20, dtype=np.uint64)
        hit += bool((passages.band_values(np.concatenate([both, a])) == passages.band_values(np.concatenate([both, b]))).any())
    assert hit >= 295


def test_bucket_links_merge_like_all_pairs():
    sets = [np.arange(i, i + 20, dtype=np.uint32) for i in (0, 100, 2, 4, 101, 50)]
    links = passages.bucket_links(list(range(6)), sets)
    assert {frozenset(x) for x in links} == {frozenset({2, 0}), frozenset({3, 2}), frozenset({4, 1})}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages.repeated_passages(df).collect() == [] and len(passages.without_passages(df).collect()) == len(rows)
