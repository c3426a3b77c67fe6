"""Best-fit packing of token documents into fixed-length sequences.

All pieces of one length are interchangeable, so a bulk step handles a whole
length class at once: documents and gaps are ordered by length class (at most
``max_tokens`` of them, whatever the corpus), a sweep from the longest class to
the shortest gives every document of a class the successor gap (the smallest
that holds it), documents that want the same gap are settled by their rank inside
the class, and the gaps shrink before the next step.  Class counts and ranks come
from distributed aggregates; only the histogram of ``max_tokens`` counts is swept
in one place, and documents look their place up by (class, rank).
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tritmarts.llm.tables import in_small_batches, written

MAX_TOKENS = 1024
END_ID = 2
#: a length class is ranked in parts, at least so many and one for each so many pieces, so that no window sees a whole class
SEGMENTS = 256
SEGMENT_PIECES = 200_000
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Latin text, punctuation and plain white space, on which both libraries split words alike
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞₠-₿]*")
_MARK = "<|endoftext|>"


class Encoder:
    """Ids of a text by the tokenizer file.

    Plain Latin text goes through the same vocabulary as ranks, which gives the
    same ids several times faster; any text with other characters, or with the
    special token spelled out, goes through the tokenizer file itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str):
        self.path = tokenizer_path
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast and _MARK not in text and _PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=1)
def encoder(tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> Encoder:
    """One encoder a worker process; the files are public tokenizer files found on each machine."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(tokenizer), ranks and public_tokenizers.path(ranks),
                   public_tokenizers.PATTERN)


def _pieces(with_ids: bool, max_tokens: int, end_id: int, tokenizer: str, ranks: str | None):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                head = len(ids) % max_tokens or max_tokens
                for piece, end in enumerate(range(head, len(ids) + 1, max_tokens)):
                    start = max(0, end - max_tokens) if piece else 0
                    part = ids[start:end]
                    row = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))
                    rows.append(row + (part.astype(np.int32),) if with_ids else row)
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def pieces(docs: DataFrame, with_ids: bool = False, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
           tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """Token pieces of documents: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A document is the ids of its text (null: empty) and the end id.  A longer
    one than ``max_tokens`` is cut so that all pieces but the first are full.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _pieces(with_ids, max_tokens, end_id, tokenizer, ranks), schema)


class Step(NamedTuple):
    """Documents of ranks below ``until`` (from the step before) go ``each`` to a sequence, from ``first`` on."""

    until: int
    since: int
    first: int
    each: int
    offset: int


def sweep(counts: dict[int, int], capacity: int = MAX_TOKENS) -> dict[int, list[Step]]:
    """Best-fit plan over the histogram of lengths: for each length its steps in rank order.

    Gaps are kept as runs of sequences with the same room.  The longest class
    goes first; its ranks fill the smallest sufficient gaps, as many in each as
    fit, and what is left opens new sequences.  That is exactly what best fit
    does with the documents one by one in falling order of length.
    """
    gaps: list[tuple[int, int, int]] = []  # (room, first sequence, number of sequences), by room
    plan: dict[int, list[Step]] = {}
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            bisect.insort(gaps, (room, first, n))

    for size in sorted(counts, reverse=True):
        left, steps = counts[size], []
        while left:
            at = bisect.bisect_left(gaps, (size, -1, -1))
            if at < len(gaps):
                room, first, n = gaps.pop(at)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = room // size
            full, rest = divmod(min(left, n * each), each)
            done = counts[size] - left
            steps.append(Step(done + full * each + rest, done, first, each, capacity - room))
            left -= full * each + rest
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            used = full + bool(rest)
            put(room, first + used, n - used)
        plan[size] = steps
    return plan


def _placed(plan: dict[int, list[Step]]):
    table = {size: np.array(steps, np.int64) for size, steps in plan.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                steps = table[int(size)]
                mine = steps[np.searchsorted(steps[:, 0], ranks[at], side="right")]
                nth = ranks[at] - mine[:, 1]
                sequence[at] = mine[:, 2] + nth // mine[:, 3]
                offset[at] = mine[:, 4] + nth % mine[:, 3] * size
            keep = [n for n in batch.schema.names if n not in ("rank", "segment")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    return run


def best_fit(parts: DataFrame, capacity: int = MAX_TOKENS) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ...) with their sequence_id and offset.

    Lengths are 1 to ``capacity``.  Ties of length, repeated rows among them, are
    ranked by doc_id, piece and checksum; equal rows are interchangeable.  The plan
    sent to the tasks has at most two steps for each pair of lengths, so it is
    bounded by ``capacity`` squared and independent of the corpus.
    """
    whole = written(parts, "pieces")
    segments = max(SEGMENTS, whole.count() // SEGMENT_PIECES)
    dealt = whole.withColumn("segment", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(segments)).cast("int"))
    cells = written(dealt.groupBy("length", "segment").agg(F.count("*").alias("n")), "piece_counts")
    counts = Counter({r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()})
    before = Window.partitionBy("length").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "segment").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("nth", F.row_number().over(inside).cast("long"))
              .join(offsets, ["length", "segment"])
              .withColumn("rank", F.col("nth") - 1 + F.col("base")))
    fields = [f for f in parts.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.select(*parts.columns, "rank").mapInArrow(_placed(sweep(counts, capacity)), schema)


def pack(docs: DataFrame, with_ids: bool = False, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into sequences of at most ``max_tokens`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id,
    offset.  A null or empty text is its end id alone.  Repeated rows are packed
    each; other columns of ``docs`` are not read.  An empty table gives no row.
    """
    return best_fit(pieces(docs, with_ids, max_tokens, end_id), max_tokens)
