"""Runs of words that occur in more than one document, wherever their lines begin and end.

A window is ``least_words`` words in a row (A-Z in lower case; any white space between).
Texts are winnowed first: the least hash of the 25-word pieces in each window is kept, so two texts that
share a window share a kept hash.  Around shared hashes only, all windows are hashed anew and
counted: a window counts if more than one document has it.  Its first place is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.llm.passages import LEAST_WORDS, _lists
from tritmarts.llm.tables import in_small_batches, row_key, written

#: odd bases of the polynomial hashes of pieces and of windows
PIECE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xC2B2AE3D27D4EB4D
#: keys of rows that are sent to all executors; where there are more, texts meet their keys by a join alone
MAX_SENT_KEYS = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _word_hashes(text: str | None) -> np.ndarray:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def _grams(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` words in a row."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    powers = np.full(len(words), base, np.uint64)
    powers[0] = 1
    inverse = np.full(len(words), pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)])
    value = (sums[n:] - sums[:-n]) * np.cumprod(inverse, dtype=np.uint64)[:len(words) - n + 1]
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def _anchors(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = least_words // 2
        for batch in batches:
            kept = []
            for text in batch.column("text"):
                grams = _grams(_word_hashes(text.as_py()), piece, PIECE_BASE)
                width = least_words - piece + 1
                kept.append(np.unique(_least_of(grams, width)).view(np.int64) if len(grams) >= width else np.empty(0, np.int64))
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), _lists(kept, pa.int64())],
                                                 names=["doc_id", "body", "anchors"])
    return run


def _windows(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = least_words // 2
        for batch in batches:
            starts, hashes = [], []
            for text, shared in zip(batch.column("text"), batch.column("anchors")):
                words = _word_hashes(text.as_py())
                value = _grams(words, least_words, WINDOW_BASE)
                wanted = np.array(shared.as_py(), np.int64).view(np.uint64)
                hit = np.isin(_grams(words, piece, PIECE_BASE), wanted)
                near = ~_least_of(~hit, least_words - piece + 1)  # a window with a shared piece
                at = np.flatnonzero(near)
                starts.append(at.astype(np.int32))
                hashes.append(value[at].view(np.int64))
            if starts:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "several", "body")), _lists(starts, pa.int32()),
                                                  _lists(hashes, pa.int64())], names=["doc_id", "several", "body", "starts", "hashes"])
    return run


def segments(at: np.ndarray, named: np.ndarray, first: np.ndarray, first_at: np.ndarray, own: np.ndarray,
             doc_id: int | None, least_words: int) -> list[tuple]:
    """(first word, words, kept doc_id, kept word, removed) from the repeated windows of one text.

    A word goes to the least first place of the windows over it.  A window that overlaps its own first place stays.
    """
    stays = own & (at - first_at < least_words)
    named, first = np.where(stays, doc_id is not None, named), np.where(stays, doc_id or 0, first)
    step = np.where(stays, 0, first_at - at)
    order = np.lexsort((at, step, first, named, stays))
    at, keys = at[order], np.stack([step, first, named, stays])[:, order]
    starts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0).any(axis=0) | (np.diff(at) > least_words)) + 1])
    low, high = at[starts], at[np.concatenate([starts[1:], [len(at)]]) - 1] + least_words
    base = low.min()
    owner = np.full(high.max() - base, -1)
    for k in reversed(range(len(starts))):  # the first in order has the last word
        owner[low[k] - base:high[k] - base] = k
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]).tolist()
    out = []
    for x, y in zip(cuts, cuts[1:]):
        if (k := owner[x]) >= 0:
            ahead, kept, name, here = keys[:, starts[k]].tolist()
            word = x + int(base)
            out.append((word, y - x, kept if name else None, word + ahead, not here))
    return out


def _rows(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        names = ["doc_id", "word", "start", "end", "n_words", "kept_doc_id", "kept_word", "removed"]
        for batch in batches:
            rows = []
            places = batch.column("places")
            starts, ids, first_starts, same = (places.values.field(i) for i in range(4))
            columns = [starts.to_numpy().astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False),
                       ids.fill_null(0).to_numpy(), first_starts.to_numpy().astype(np.int64), same.to_numpy(zero_copy_only=False)]
            offsets = places.offsets.to_pylist()
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                spans = [m.span() for m in _WORD.finditer(text.as_py())]
                at, named, first, first_at, own = (c[offsets[i]:offsets[i + 1]] for c in columns)
                own = own & (~named if doc_id is None else named & (first == doc_id))
                found = segments(at, named, first, first_at, own, doc_id, least_words)
                rows += [(doc_id, word, spans[word][0], spans[word + n - 1][1], n, kept, kept_word, removed)
                         for word, n, kept, kept_word, removed in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
    return run


def _across(df: DataFrame, key: str, first: Column) -> DataFrame:
    """(key, first) of the keys that more than one document has; ``first`` is a struct led by doc_id, null ids are each their own."""
    least = df.groupBy(key).agg(F.min(first).alias("first"), F.max("doc_id").alias("high"),
                                F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    return least.where("first.doc_id < high or unnamed > 1 or (unnamed > 0 and high is not null)").select(key, "first")


def _rows_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is not in ``rows``, before their texts travel; all of them if the keys are too many to send."""
    keys = rows.select("body")
    return docs.join(F.broadcast(keys), "body", "left_semi") if rows.count() <= MAX_SENT_KEYS else docs


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs of at least ``least_words`` equal words of ``docs`` (doc_id, text) that more than one document has.

    Rows (doc_id, word, start, end, n_words, kept_doc_id, kept_word, removed): a stretch of words from number
    ``word`` on and its code points (end exclusive).  Stretches that are removed name the place of the same words in the smallest
    (doc_id, word) with the window; the others stay and name themselves.  A run over several
    first places is several stretches in a row.  Null ids are each a document, rows of one doc_id are one.
    """
    keyed = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("body", row_key("text"))
    kept = written(keyed.mapInArrow(_anchors(least_words), "doc_id long, body long, anchors array<long>"), "run_anchors")
    anchors = kept.select("doc_id", "body", F.explode("anchors").alias("anchor"))
    shared = _across(anchors, "anchor", F.struct("doc_id"))
    by_body = anchors.join(shared, "anchor", "left_semi").groupBy("body").agg(F.collect_set("anchor").alias("anchors"))
    # equal texts are one body, led by their least doc_id
    high, unnamed = F.max("doc_id"), F.count_if(F.col("doc_id").isNull())
    bodies = kept.groupBy("body").agg(F.min(F.struct("doc_id")).alias("least"), (
        (F.min("doc_id") < high) | (unnamed > 1) | ((unnamed > 0) & high.isNotNull())).alias("several"))
    candidates = written(by_body.join(bodies, "body").select("body", "least.doc_id", F.coalesce("several", F.lit(False)).alias("several"),
                                                             "anchors"), "run_candidates")
    texts = _rows_of(keyed.select("body", "text"), candidates).dropDuplicates(["body"])
    windows = written(texts.join(candidates, "body").select("doc_id", "several", "body", "text", "anchors").mapInArrow(
        _windows(least_words), "doc_id long, several boolean, body long, starts array<int>, hashes array<long>"), "run_windows")
    each = windows.select("doc_id", "several", "body", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select(
        "doc_id", "several", "body", F.col("w.starts").alias("at"), F.col("w.hashes").alias("hash"))
    nameless = F.when(F.col("doc_id").isNull(), F.col("body"))
    first = each.groupBy("hash").agg(
        F.min(F.struct("doc_id", F.col("at").alias("first_at"), F.col("body").alias("first_body"))).alias("first"), F.max("doc_id").alias("high"),
        F.min(nameless).alias("a"), F.max(nameless).alias("b"), F.bool_or("several").alias("several")).where(
        "first.doc_id < high or a < b or (a is not null and high is not null) or several").select("hash", "first")
    places = written(each.select("body", "at", "hash").join(first, "hash").groupBy("body").agg(F.collect_list(F.struct(
        "at", "first.doc_id", "first.first_at", (F.col("body") == F.col("first.first_body")).alias("same"))).alias("places")), "run_places")
    return _rows_of(keyed, places).join(places, "body").select("doc_id", "text", "places").mapInArrow(
        _rows(least_words), "doc_id long, word int, start long, end long, n_words int, kept_doc_id long, kept_word int, removed boolean")
