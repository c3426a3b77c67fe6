"""Both vector operators against all pairs."""

import math

import numpy as np
import pytest

from tritmarts.llm import embedding_dedup, rabitq


def vectors(seed, n=300, dim=16):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = centres[draw.integers(12)] + draw.standard_normal(dim) * draw.choice([0.0, 0.02, 0.08, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v * draw.choice([1, 3])], int(draw.integers(3))))
    odd = [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [math.nan] + [1.0] * (dim - 1), 1), (1003, [math.inf] * dim, 1),
           (1004, [None] + [1.0] * (dim - 1), 1), (1005, rows[0][1], None), (1020, [1.0, 2.0], 1), (1040, [2.0, 4.0], 1), (1041, [1.0], 2),
           (1042, [], 2), (None, rows[1][1], 1), (3, rows[3][1], rows[3][2]), (1060, rows[5][1], rows[5][2])]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank int, unit string")


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("blocks, cell, sample", [((16384, 8192), 4096, 1 << 20), ((3, 40), 4096, 640), ((3, 40), 30, 1600),
                                                  ((1024, 8192), 10, 1 << 20)])
def test_search(spark, monkeypatch, blocks, cell, sample):
    monkeypatch.setattr(rabitq, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(rabitq, "VECTOR_BLOCK", blocks[1])
    monkeypatch.setattr(rabitq, "CELL", cell)
    monkeypatch.setattr(rabitq, "SAMPLE_NUMBERS", sample)
    rows = vectors(1)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rabitq.search(frame(spark, rows)).collect())
    known = {i: v for i, v, _ in rows if i is not None and good(v)}
    want = []
    for q, a in known.items():
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in known.items() if i != q and len(v) == len(a))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])]
    want.sort()
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_estimates_stay_within_bounds():
    draw = np.random.default_rng(4)
    values = draw.standard_normal((2000, 64))
    bits, length, f = rabitq.encode(values)
    query = draw.standard_normal(64)
    signs = np.unpackbits(bits, axis=1, count=64).astype(float) * 2 - 1
    estimate = signs @ (query @ rabitq.rotation(64)) * length / f / 8
    slack = rabitq.EPSILON * np.sqrt(1 - f * f) / f / np.sqrt(63) * length * np.linalg.norm(query)
    assert (np.abs(estimate - values @ query) <= slack).mean() > 0.999
    assert (slack / (length * np.linalg.norm(query))).mean() < 0.5


@pytest.mark.parametrize("dim", [3, 64, 100, 130])
def test_bit_counts_give_the_products_with_rounded_queries(dim):
    draw = np.random.default_rng(dim)
    values, asked = draw.standard_normal((200, dim)), draw.standard_normal((9, dim))
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    bits, _, _ = rabitq.encode(values)
    code = rabitq.words(bits)
    got, left = rabitq.estimates(asked, code, np.bitwise_count(code).sum(axis=1).astype(np.float32))
    signs = np.unpackbits(bits, axis=1, count=dim).astype(float) * 2 - 1
    step = np.ptp(asked, axis=1, keepdims=True) / (2 ** rabitq.QUERY_BITS - 1)
    low = asked.min(axis=1, keepdims=True)
    rounded = low + step * np.rint((asked - low) / step)
    assert np.allclose(got, rounded @ signs.T, atol=1e-4)
    assert np.allclose(left, np.linalg.norm(asked - rounded, axis=1))


def test_queries_visit_only_cells_that_can_hold_a_neighbour(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "CELL", 30)
    draw = np.random.default_rng(8)
    centres = 3 * draw.standard_normal((10, 16))
    rows = [(i, [float(x) for x in centres[i % 10] + 0.1 * draw.standard_normal(16)], 0) for i in range(600)]
    met = []
    searched = rabitq.written
    monkeypatch.setattr(rabitq, "written", lambda df, name: met.append((name, searched(df, name))) or met[-1][1])
    got = {(r.query_id, r.vec_id) for r in rabitq.search(frame(spark, rows)).collect()}
    values = np.array([r[1] for r in rows])
    for q in range(0, 600, 20):
        score = values @ values[q]
        score[q] = -np.inf
        assert {(q, int(i)) for i in np.argsort(-score)[:20]} <= got
    tables = dict(met)
    assert tables["visits"].count() < 0.5 * 30 * tables["cells"].count()


@pytest.mark.parametrize("cell, block", [(2048, 1024), (20, 8), (6, 1024)])
def test_near_duplicates(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(2)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame(spark, rows)).collect()}
    named = {i: (v, lab) for i, v, lab in rows if i is not None}
    usable = [i for i, (v, lab) in named.items() if good(v) and lab is not None]
    links = {i: set() for i in named}
    for a in usable:
        for b in usable:
            (x, p), (y, q) = named[a], named[b]
            if a != b and p == q and len(x) == len(y):
                if np.dot(x, y) / math.sqrt(np.dot(x, x)) / math.sqrt(np.dot(y, y)) >= 0.98:
                    links[a].add(b)
    least = {}
    for i in sorted(named):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in least:
                least[j] = i
                todo += links[j]
    assert got == {i: (len(links[i]), least[i], least[i] == i) for i in named}
    assert max(len(x) for x in links.values()) > 5


@pytest.mark.parametrize("kind", ["string", "long", "date"])
def test_labels_of_any_type(spark, kind):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [1.0, 0.02], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "vec_id", "embedding", f"cast({'date_from_unix_date(label)' if kind == 'date' else 'label'} as {kind}) as label")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (2, 1)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rabitq.search(empty).collect() == []
    assert embedding_dedup.near_duplicates(empty).collect() == []
