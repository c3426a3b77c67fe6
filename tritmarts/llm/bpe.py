"""Byte-pair encoding with a priority queue of merges, and decoding.

A word is a doubly linked list of symbols.  Every adjacent pair that the
vocabulary can merge waits in a queue by (rank, place); the least one is taken,
skipped if one of its symbols has changed since, and otherwise merged, which
queues the pairs on both sides of the new symbol.  That costs n log n for a word
of n bytes, so a text without white space is no special case.

Words are found by the normalizer and the splitting rule of the tokenizer file.
White space is never part of a word there, so a text is handled as its parts
between white space, whose ids are remembered by each worker process, as are those of their words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tritmarts.llm.tables import in_small_batches

TOKENIZER = "word_bpe_49k.json"
#: parts and words of at most so many characters are remembered, so many of each; then the memory starts anew
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
#: rows of ids handed back to Spark at once
ROWS_OUT = 64
#: white space of the splitting rule; the separators 1C to 1F do not belong to it
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PARTS = re.compile("[^" + "".join(map(chr, _BLANKS)) + "]+")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Remembered(dict):
    """Ids of pieces of text, as little-endian bytes, worked out when first asked for."""

    def __init__(self, work_out):
        super().__init__()
        self.work_out = work_out

    def __missing__(self, piece: str) -> bytes:
        ids = self.work_out(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Vocabulary, merge ranks, normalizer, splitting rule and added tokens of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, added = told["model"], told["added_tokens"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-pair model")
        if told["decoder"] is not None or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("the file asks for a decoder or for added tokens of a kind that is not known here")
        rules = Tokenizer.from_file(path)
        self.normalize, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.vocabulary = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = self.vocabulary
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in added}
        self.at_added = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")")
        strings = {i: w for names in (ids, self.added) for w, i in names.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.words, self.parts = _Remembered(self._word_ids), _Remembered(self._part_ids)

    def merged(self, symbols: list[int]) -> list[int]:
        """``symbols`` after all merges, the lowest rank first, of equal ranks the leftmost."""
        merges = self.merges
        queue = [(merges[pair][0], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in merges]
        if not queue:
            return symbols
        heapq.heapify(queue)
        last = len(symbols) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = merges[left, right][1], -1
            h, k = before[i], after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                pair = symbols[i], symbols[k]
                if pair in merges:
                    heapq.heappush(queue, (merges[pair][0], i, *pair))
            if h >= 0:
                pair = symbols[h], symbols[i]
                if pair in merges:
                    heapq.heappush(queue, (merges[pair][0], h, *pair))
        return [s for s in symbols if s >= 0]

    def _word_ids(self, word: str) -> bytes:
        ids = list(map(self.vocabulary.__getitem__, word[:-1]))
        ids.append(self.vocabulary[word[-1] + self.end])
        return _packed(self.merged(ids))

    def _part_ids(self, part: str) -> bytes:
        out = []
        for piece in self.at_added.split(part):
            if piece in self.added:
                out.append(_packed([self.added[piece]]))
            elif piece:
                out += [self.words[word] for word, _ in self.split(self.normalize(piece))]
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.parts.__getitem__, _PARTS.findall(text))), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings of ``ids`` with a blank between them, as a file without decoder asks for."""
        return " ".join(itemgetter(*ids)(self.strings)) if len(ids) > 1 else "".join(self.strings[i] for i in ids)


@lru_cache(maxsize=1)
def byte_pairs(tokenizer: str = TOKENIZER) -> BytePairs:
    """One vocabulary a worker process; ``tokenizer`` is the name of a public tokenizer file found on each machine."""
    import public_tokenizers

    return BytePairs(public_tokenizers.path(tokenizer))


def _rows_of(pieces: list, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*pieces), kinds)], [n for n, _ in kinds])


def _per_row(work, tokenizer: str, kinds: list[tuple[str, pa.DataType]]):
    """``work(vocabulary, value)`` for the second column of each row, after the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                yield _rows_of([(key, *work(pairs, value)) for key, value in zip(part.column(0).to_pylist(), part.column(1))], kinds)

    return run


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the ids of its whole text, without special tokens around it.

    A null or empty text has no ids.  Special tokens spelled out in a text are
    those tokens.  Repeated rows are encoded each; other columns are not read; an
    empty table gives no row.
    """
    work = _per_row(lambda pairs, text: (pairs.encode(text.as_py() or "").astype(np.int32),), tokenizer,
                    [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids), special tokens included; null ids give an empty text."""
    work = _per_row(lambda pairs, ids: (pairs.decode(ids.as_py() or []),), tokenizer,
                    [("doc_id", pa.int64()), ("text", pa.string())])
    return in_small_batches(encoded).select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, text string")


def _digests(pairs: BytePairs, text: pa.StringScalar) -> tuple[int, str, str]:
    ids = pairs.encode(text.as_py() or "")
    back = pairs.decode(ids.tolist()).encode()
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again in one pass, as digests."""
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _per_row(_digests, tokenizer, kinds), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
