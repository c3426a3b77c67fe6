"""The stages of the pipeline, each against a plain version on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_packing import check_layout, one_by_one
from tests.llm.test_near_texts import plain_groups
from tests.llm.test_secrets import plain as plain_secrets
from tritmarts.llm import secrets
from tritmarts.llm.tables import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 34 %%", "en", "src1", 8),
                                 (None, "no id here but words", "en", "src1", 20),
                                 (9004, "the words of that and then token = 'abcdefgh' the end of it", "en", "src1", 60)], docs.schema)
    docs = written(docs.union(odd).union(docs.where("doc_id < 3")), "test_docs")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixture", "packing"]

    kept = written(stages["language"](spark, docs, SF), "test_kept")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9001, 9002, 9003}

    single = written(stages["near_duplicates"](spark, kept, SF), "test_single")
    roots = plain_groups({r.doc_id: r.text for r in kept.collect() if r.doc_id is not None})
    assert single.columns == docs.columns
    assert Counter(r.doc_id for r in single.collect() if r.doc_id is not None) == Counter(set(roots.values()))

    masked = written(stages["secrets"](spark, single, SF), "test_masked")
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == docs.columns
    hits = 0
    for r in single.collect():
        found = plain_secrets(r.text)[4]
        hits += bool(found)
        assert (texts[r.doc_id] == r.text) == (not found)
        assert plain_secrets(texts[r.doc_id])[4] == ""
    assert hits and all(secrets.MARK in texts[r.doc_id] for r in single.collect() if plain_secrets(r.text)[4])

    mixed = written(stages["mixture"](spark, masked, SF), "test_mixed")
    draws = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(draws.values()) <= {1, 2}

    packed = stages["packing"](spark, mixed, SF).collect()
    check_layout(packed)
    pieces = defaultdict(int)
    for r in packed:
        pieces[r.doc_id] += r.piece == 0
    assert pieces == draws
    assert len({r.sequence_id for r in packed}) == one_by_one([r.length for r in packed], 1024)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
