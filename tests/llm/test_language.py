"""Language identification: held-out accuracy, undefined texts, and what a prediction may depend on."""

from pyspark.sql import functions as F

from tritmarts.llm import language

SAMPLE = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SAMPLE)
    got = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(0 <= r.score <= 1 for r in got)
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(SAMPLE)
    hidden = docs.withColumn("lang", F.when(language.fold() == 0, F.lit("xx")).otherwise(F.col("lang")))
    answer = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in language.report(df).collect())
    assert answer(docs) == answer(hidden.repartition(5))


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %% \n", "en"), (None, "the words are here", "en"), (5, "the words are here", "en"),
            (6, "les mots sont ici", "fr"), (7, "des mots et encore", "fr"), (8, "more words are there", "en"), (8, "more words are there", "en"),
            (9, "the " * 200000, None), (11, "日本", None)]
    df = spark.createDataFrame([(*r, 0.5, "z") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r.doc_id: r for r in language.report(df).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[None].held_out is False and got[None].lang_pred == got[5].lang_pred
    assert all(r.lang_pred in ("en", "fr", "und") for r in got.values())
    told = language.identify(df, language.learn(df)).select("row.*").columns
    assert told == df.columns


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.report(empty).collect() == []
    bare = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.report(bare).collect()] == [("und", 0.0)]
