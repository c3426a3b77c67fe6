"""The kernel regression against plain kernel ridge over sets of n-grams, without bins, landmarks or batches."""

import duckdb
import numpy as np
import pytest

from tritmarts.llm import language


def grams(text):
    """The distinct 1- to 4-grams of a text in lower case between two spaces, a run of what is not a letter being one space."""
    line = ""
    for c in text.lower():
        line += c if c.isalpha() else "" if line.endswith(" ") else " "
    line = f" {line} "
    return {line[i:i + n] for n in range(1, 5) for i in range(len(line) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql("SELECT lang, text FROM '/root/testdata/sf0.01/documents.parquet' "
                      "WHERE lang IS NOT NULL AND regexp_matches(text, '[a-z]') ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("ridge", [0.05, language.RIDGE])
def test_all_rows_as_landmarks_are_plain_kernel_ridge(texts, ridge):
    known, asked = texts[:120], texts[120:320]
    model = language.fit([(lang, np.packbits(language.presence(t))) for lang, t in known], landmarks=len(known), ridge=ridge)
    assert model.languages == sorted({lang for lang, _ in known})
    seen = np.array([language.presence(t) for _, t in asked], np.float64)
    got = seen / np.sqrt(seen.sum(axis=1, keepdims=True)) @ model.weights
    sets = [grams(t) for _, t in known]
    wanted = np.array([[1.0 if lang == x else -1.0 for x in model.languages] for lang, _ in known])
    dual = np.linalg.solve(kernel(sets, sets) + ridge * np.eye(len(sets)), wanted)
    plain = kernel([grams(t) for _, t in asked], sets) @ dual
    assert np.abs(got - plain).max() < 0.05  # grams that share a bin
    assert (got.argmax(axis=1) == plain.argmax(axis=1)).all()


def test_bins_are_the_distinct_grams(texts):
    for _, text in texts[:100]:
        n = len(grams(text))
        assert n * (1 - n / language.BINS) - 10 <= language.presence(text).sum() <= n
