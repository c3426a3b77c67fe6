"""Rows of the near-duplicate stage whose doc_id is repeated or null."""

import corpus_pipeline


def test_one_row_of_each_component_whatever_its_id(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(1, text("a")), (7, text("a")), (7, text("b")), (8, text("c")), (8, text("d")), (8, text("d")),
            (None, text("e")), (None, text("e")), (None, text("a")), (None, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.text[0], r.doc_id) for r in kept.collect())
    assert got == [("a", 1), ("b", 7), ("c", 8), ("d", 8), ("e", None), ("f", None)]
