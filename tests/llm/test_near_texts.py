"""Near-duplicate documents and the pipeline's stage against brute-force Jaccard."""

import random

import corpus_pipeline
from tests.llm.test_passages import plain_sets
from tests.llm.test_simhash import plain_fingerprint
from tritmarts.llm import near_texts


def plain_groups(texts, threshold=0.8):
    sets = {i: plain_sets(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_stage_keeps_one_of_each_jaccard_group(spark):
    draw = random.Random(4)
    texts = {}
    for base in range(15):
        words = [f"w{draw.randrange(9999)}" for _ in range(draw.choice([3, 40, 150, 400]))]
        for copy in range(5):
            edited = list(words)
            for _ in range(len(words) * copy // 150):
                edited[draw.randrange(len(words))] = f"e{draw.randrange(9999)}"
            joined = ("\n" if copy % 2 else " ").join(edited)
            texts[base * 10 + copy] = joined.upper() if copy == 3 else joined
    want = plain_groups(texts)
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert any((prints[i] ^ prints[want[i]]).bit_count() > 4 for i in texts)  # what op2's digests do not see
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in near_texts.near_texts(docs).collect()}
    assert got == want
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_blank_texts_are_alike(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (None, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_texts.near_texts(docs).collect()} == {
        (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)}


def test_linked_fingerprints_meet_without_a_common_band(spark, monkeypatch):
    """Of texts that share no band the linked fingerprints alone bring the pair to the comparison, which still decides."""
    words = [f"w{i}" for i in range(400)]
    edited = [*words[:-1], "x"]
    texts = {1: " ".join(words), 2: " ".join(edited), 3: " ".join(f"v{i}" for i in range(400)), 4: "\t".join(words).upper(),
             5: " ".join(words[:200] * 40 + words[200:300]), 6: " ".join(words[:200] * 40 + words[300:])}
    print_of = lambda t: near_texts.fingerprint(t.encode(), near_texts.SHINGLE_WORDS)
    assert 0 < (print_of(texts[1]) ^ print_of(texts[2])).bit_count() <= 4
    assert (print_of(texts[5]) ^ print_of(texts[6])).bit_count() <= 4 and plain_groups({i: texts[i] for i in (5, 6)}) == {5: 5, 6: 6}
    monkeypatch.setattr(near_texts, "shared_buckets", lambda classes: near_texts_none(classes))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_texts.near_texts(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def near_texts_none(classes):
    return classes.selectExpr("0 AS band", "0L AS value", "digest").where("false")
