"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tritmarts.llm import spellings

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(spellings.RUNS.join("[]") + "+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made_documents(seed, n_docs=60):
    draw = random.Random(seed)
    stems = ["".join(draw.choices("ab" + chr(0xE9), k=draw.randint(6, 9))) for _ in range(40)]
    weights = [1.0 / (i + 1) ** 2 for i in range(len(stems))]

    def word():
        w = draw.choices(stems, weights)[0]
        if draw.random() < 0.1:
            at = draw.randrange(len(w))
            w = w[:at] + draw.choice(["", "a", "bb"]) + w[at + draw.randint(0, 1):]
        return w.upper() if draw.random() < 0.05 else w
    return [(i, draw.choice([" ", "-", "1"]).join(word() for _ in range(draw.randint(0, 120)))) for i in range(n_docs)]


@pytest.mark.parametrize("bucket", [spellings.BUCKET, 3])
def test_variants(spark, bucket):
    rows = made_documents(8) + [(None, "nothing nothing nothings nothings"), (90, None), (91, ""), (92, "a" * 9000 + " " + "a" * 9000),
                                (92, "b" + "a" * 8999), (92, "b" + "a" * 8999), (93, "É" * 7), (93, "É" * 7), (93, "ÉÉÉÉÉÉÉ" + chr(0xD7))]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, word string, n int")
    want = plain_variants(rows)
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)
    assert found(spellings.variants(df, bucket=bucket)) == want


@pytest.mark.parametrize("bucket", [512, 2])
def test_near_pairs_are_whole_and_met_once(spark, bucket):
    draw = random.Random(2)
    words = {"".join(draw.choices("ab", k=draw.randint(1, 9))) for _ in range(400)} | {"c" * 12, "c" * 13, "c" * 14}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spellings.near_pairs(df, bucket).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_crowded_half_is_dealt_again(spark):
    """3,000 words of one first half and one length: no place of more than 64 is compared within itself."""
    draw = random.Random(6)
    words = {"commonstart" + "".join(draw.choices("abcdefgh", k=11)) for _ in range(3000)}
    words |= {w[:-1] + "z" for w in list(words)[:50]}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in spellings.near_pairs(df, 64).collect()}
    masks = Counter(w[:i] + "*" + w[i + 1:] for w in words for i in range(len(w)))
    assert len(got) == sum(n * (n - 1) // 2 for n in masks.values())


def test_chains_end_at_the_root(spark):
    steps = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    forms = spark.createDataFrame(list(zip(steps, steps[1:])), "word string, form string")
    assert {r.word: r.root for r in spellings._roots(forms).collect()} == dict.fromkeys(steps[:-1], steps[-1])


def test_empty_table(spark):
    df = spellings.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns == COLUMNS and df.collect() == []


def test_long_runs_are_words_too(spark):
    df = spark.createDataFrame([(1, "y" * 50_000), (1, "y" * 50_000)], "doc_id long, text string")
    assert [r.n for r in spellings.variants(df).select(F.length("word").alias("k"), "n").collect()] == [2]
