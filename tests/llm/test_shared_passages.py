"""Shared passages against every window and every line."""

import random

import duckdb
import pytest

from tritmarts.llm import oracles, shared_passages


def test_as_the_sql_states(spark):
    draw = random.Random(9)

    def words(n):
        return [f"w{draw.randrange(4000)}" for _ in range(n)]

    def broken(w, n):
        return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    passage, copied, near = words(80), words(200), words(90)
    edited = [*near[:40], "other", *near[41:]]
    rows = [(-1, None), (-2, ""), (1, broken(words(30) + passage + words(40), 10)), (2, " ".join(words(70) + passage + words(5))),
            (3, broken(copied, 9).upper()), (4, " ".join(copied) + "\n"), (5, " ".join(words(300))), (6, " ".join(near)), (7, "  " + "\t".join(edited)),
            (8, " ".join(["again"] * 130)), (9, "é " + " ".join(["again"] * 70)), (10, " ".join(words(20) + passage[:49] + words(20))),
            (11, " ".join(passage[30:] + copied[:50] + passage[:50])), (12, "x" * 60000)]
    for i in range(60):
        w = words(20)
        for _ in range(draw.randint(0, 3)):
            source = draw.choice([passage, copied, near])
            at = draw.randrange(len(source) - 60)
            w += source[at:at + draw.randint(45, 75)] + words(draw.randint(0, 15))
        rows.append((100 + i, broken(w, draw.choice([7, 60, 400]))))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, unit string, row int")
    out = shared_passages.shared_passages(df)
    got = sorted(tuple(r) for r in out.collect())
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    want = duckdb.sql(oracles.OP7_PASSAGES)
    assert want.columns == out.columns
    assert got == sorted(want.fetchall())
    found = {r[0] for r in got}
    assert {1, 2, 3, 4, 6, 7, 8, 9, 11} <= found and not {-1, -2, 5, 10, 12} & found
    texts = dict(rows)
    assert all(len(texts[r[0]][r[3]:r[4]].split()) == r[5] for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a " * 60), (None, "a " * 60)]])
def test_without_passages_or_ids(spark, rows):
    out = shared_passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.unit for r in out} == ({"line", "run"} if len(rows) == 2 else set())
