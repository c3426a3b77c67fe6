"""Spelling variants: words one edit apart, found by asymmetric chunks.

Of two words one edit apart the shorter (or, of equal lengths, either) gives two
disjoint chunks, its first and its second half.  The edit touches only one of
them, so the other is found in the longer word as a positional gram: the first
half at its own place, the second shifted by the difference of lengths, zero or
one.  Words therefore meet in an equi join on (length, chunk, gram); each meeting
is verified by edit distance inside the join, so only near pairs leave it.

Where many words share a chunk, the edit is known to lie in the other half, which
is cut into two chunks again, and so on: those words then share the chunk and a
half of the rest.  A rest of one letter is shared by no more words than there are letters.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.llm.tables import written

RUNS = f"A-Za-z{chr(0xC0)}-{chr(0xFF)}"
#: fewest code points and fewest occurrences of a word
MIN_LENGTH, MIN_COUNT = 7, 2
#: a form occurs at least so many times as often
TIMES = 10
#: one in so many occurrences loses a letter
LOSES = 31
#: a meeting place of more words is dealt again
BUCKET = 512
_PLACE = ["length", "lo", "hi", "gram"]


def misspelt(run: Column, doc_id: Column) -> Column:
    """``run``, or without one letter where the checksum of "doc_id:run" is divisible by ``LOSES``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % LOSES == 0, F.concat(F.left(run, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    Runs below ``min_length`` can give no word, so they are never made.
    """
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[{RUNS}]{{{min_length},}}"), F.lit(0)))
    lower = docs.select("doc_id", runs.alias("run")).select(
        "doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    return (lower.select(misspelt(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row twice: with the edit in the second half of [lo, hi), and in the first.

    ``gram`` stands for what is shared then: all before lo, and as much of the
    end as lies behind hi in a word of ``length``.
    """
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    cut = rows.withColumn("part", F.explode(parts)).select("word", "n", "longer", "length", "part.lo", "part.hi")
    return cut.withColumn("gram", F.xxhash64("length", "lo", "hi", F.left("word", F.col("lo")),
                                             F.right("word", F.col("length") - F.col("hi"))))


def _met(rows: DataFrame) -> DataFrame:
    """Near pairs (a, n_a, b, n_b) of rows that share a gram, each pair once.

    An insertion into a row of equal letters can be told of both halves; it counts
    for the second, so a pair met in a first half must differ before its end.
    """
    a = rows.where("longer = 0").select(*_PLACE, F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.select(*_PLACE, F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    once = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    here = (F.col("hi") == F.col("length")) | (F.left("a", F.col("hi")) != F.left("b", F.col("hi")))
    return (a.join(b, _PLACE).where(once & here & (F.levenshtein("a", "b", 1) == 1))
            .select("a", "n_a", "b", "n_b"))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, n_a, b, n_b) of ``words`` (word, n) that differ by one inserted, deleted or replaced code point, each pair once.

    Words are distinct.  A place of more than ``bucket`` words is dealt again by
    halves of the part in which its words may differ, until that is one letter.
    """
    rows = (words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("length", F.length("word") - F.col("longer")).where("length > 0")
            .select("word", "n", "longer", "length", F.lit(0).alias("lo"), F.col("length").alias("hi")))
    found = None
    while True:
        dealt = _halves(rows)
        crowded = written(dealt.groupBy(*_PLACE).agg(F.count("*").alias("here"), F.count_if(F.col("longer") == 0).alias("shorter"))
                          .where(f"here > {bucket} AND shorter > 0 AND hi - lo > 1").select(*_PLACE), "crowded_places")
        last = crowded.isEmpty()
        met = _met(dealt if last else dealt.join(crowded, _PLACE, "left_anti"))
        found = met if found is None else found.union(met)
        if last:
            return found
        rows = written(dealt.join(crowded, _PLACE, "left_semi"), "crowded_words")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form); counts grow along forms, so they never return."""
    ways = written(forms.select("word", F.col("form").alias("to")), "forms")
    while True:
        on = ways.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if ways.join(on, "to", "left_semi").isEmpty():
            return ways.withColumnRenamed("to", "root")
        ways = written(ways.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to")), "forms")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES,
             bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text).

    A word's form is its most frequent near word (of equals the smallest in code
    points), if it occurs ``times`` as often; its root is where forms lead to.
    Null and empty texts have no words, a null doc_id counts as an empty one,
    repeated rows count each, other columns are not read, an empty table gives no row.
    """
    all_words = written(words(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_length, min_count), "words")
    pairs = near_pairs(all_words, bucket)
    best = (pairs.select(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("other"))
            .union(pairs.select("b", "n_a", "a")).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")))
    is_form = -F.col("best.less") >= times * F.col("n")
    told = written(all_words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "word_forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
