"""SimHash near-duplicates against all pairs."""

import random
import re

import pytest
import xxhash

from tritmarts.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "One", "one TWO three", "a b c d", "a b c d e", "É é x\x0by z\x1fq ß a a a a a", "  x   y a b c"])
def test_fingerprint_matches_plain(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_long_text_in_chunks():
    draw = random.Random(1)
    text = " ".join(draw.choice("ab cd ef gh Ij".split()) for _ in range(40000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_pair_in_radius_shares_a_bucket():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    draw = random.Random(3)
    assert len(masks) == 31
    for _ in range(3000):
        apart = sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4)))
        assert any(apart & m == 0 for m in masks)


def test_large_bucket_is_connected_like_all_pairs(monkeypatch):
    import numpy as np
    monkeypatch.setattr(simhash, "BLOCK", 16)
    draw = random.Random(5)
    bases = [draw.getrandbits(64) for _ in range(6)]
    values = {draw.choice(bases) ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for _ in range(400)}
    array = np.array(sorted(values), np.uint64)
    x, y = simhash.bucket_links(array, 4)
    got = {i: i for i in range(len(array))} | dict(zip(x.tolist(), y.tolist()))
    assert got == plain_components({i: int(v) for i, v in enumerate(array)}, 4)


def test_documents_against_all_pairs(spark):
    draw = random.Random(2)
    rows = [(-1, None), (7, ""), (None, "null id text"), (3, "same text here twice"), (3, "same text here twice")]
    for base in range(12):
        words = [f"w{draw.randrange(9999)}" for _ in range(300)]
        for copy in range(4):
            edited = list(words)
            for _ in range(copy):
                edited[draw.randrange(300)] = "edit"
            rows.append((100 + base * 10 + copy, " ".join(edited)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    prints = {i: plain_fingerprint(t) for i, (_, t) in enumerate(rows)}
    roots = plain_components(prints, 4)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[roots[i]] = min(doc_id, least.get(roots[i], doc_id))
    want = [(rows[i][0], f"{prints[i]:016x}", least.get(roots[i])) for i in prints]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
