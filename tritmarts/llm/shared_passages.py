"""Passages that documents share: lines that are alike, and stretches of equal words wherever lines begin and end.

Two kinds of paragraphs meet.  A line is compared as a whole: MinHash bands tuned for recall, exact
Jaccard, components (``passages``).  Every window of ``least_words`` words is a paragraph too; the least hash of
its pieces is its MinHash, which equal windows share, and colliding windows are verified by counting them (``runs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tritmarts.llm.passages import LEAST_WORDS, THRESHOLD, repeated_passages
from tritmarts.llm.runs import repeated_runs


def shared_passages(docs: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of at least ``least_words`` words of ``docs`` (doc_id, text) that more than one document has.

    Rows (doc_id, unit, place, start, end, n_words, kept_doc_id, kept_place, removed).  Unit ``line`` is a line alike to
    ``threshold`` to one of another document, place its number; unit ``run`` is a stretch of equal words, place
    the number of its first word.  Start and end are code points (end exclusive).  Both kinds may cover the same words.  What is not removed is the first of
    its kind.  Null and empty texts have no rows, null ids are each a document, rows of one doc_id are one.
    Of rows that repeat a text and a null doc_id the runs stay.  Other columns are not read.
    """
    lines = repeated_passages(docs, threshold, least_words).select(
        "doc_id", F.lit("line").alias("unit"), F.col("paragraph").cast("int").alias("place"), "start", "end", F.col("n_words").cast("int"),
        "kept_doc_id", F.col("kept_paragraph").cast("int").alias("kept_place"), "removed")
    runs = repeated_runs(docs, least_words).select(
        "doc_id", F.lit("run").alias("unit"), F.col("word").alias("place"), "start", "end", F.col("n_words").cast("int"),
        "kept_doc_id", F.col("kept_word").alias("kept_place"), "removed")
    return lines.unionByName(runs)
