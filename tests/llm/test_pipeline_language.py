"""Rejection by language, with no label and with two or many languages."""

import numpy as np
import pytest

import corpus_pipeline
from tritmarts.llm import language

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_without_labels_documents_with_letters_stay(spark):
    rows = [(1, "some words"), (2, None), (3, ""), (4, "12 %%"), (5, "日本")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()) == [1, 5]


@pytest.mark.parametrize("n", [2, 4, 40])
def test_sureness_does_not_depend_on_the_number(n):
    typical, alike, none = np.full(n, -1.0), np.full(n, 2 / n - 1), np.zeros(n)
    typical[1] = 1.0
    half = (typical + alike) / 2
    assert np.allclose(language.sureness(np.stack([typical, alike, none, half])), [1, 0, 0, 0.5])


def test_unknown_script_is_rejected(spark):
    rows = [(i, f"the words of that {w} and this are in the house", "en") for i, w in enumerate("abcdefghijklm")]
    rows += [(100 + i, f"les mots de cette {w} et dans la maison sont", "fr") for i, w in enumerate("abcdefghijklm")]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in [*rows, (999, "日本語", None)]], COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert got == {i for i, *_ in rows}
