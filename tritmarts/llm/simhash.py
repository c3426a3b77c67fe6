"""SimHash near-duplicates through covering locality-sensitive hashing.

Tables are bit masks from a linear code: position i of the fingerprint gets a
random vector m(i) of radius + 1 bits, and the table of a nonzero vector v keeps
the positions with <m(i), v> = 1.  Any ``radius`` differing positions span at
most ``radius`` dimensions, so some v is orthogonal to all of them: that table
masks every difference out and the two fingerprints share a bucket there.  No
pair within the radius is missed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tritmarts.llm.components import block_components, components
from tritmarts.llm.tables import in_small_batches, written

BITS = 64
SHINGLE_WORDS = 4
HASH_SEED = 42
RADIUS = 4
MASK_SEED = 7
#: fingerprints compared at once inside a bucket; longer buckets are dealt by further coverings
BLOCK = 1024
MAX_LEVEL = 3
#: shingle hashes whose bits are counted at once
HASH_CHUNK = 16384


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), (ends[words - 1:] if len(tokens) > words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, HASH_CHUNK):
        hashes = np.array([digest(joined[s:e], HASH_SEED)
                           for s, e in zip(first[at:at + HASH_CHUNK], last[at:at + HASH_CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))],
                                         names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; the 64 bits are kept as a signed long."""
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = MASK_SEED) -> list[int]:
    """One mask for every nonzero vector of radius + 1 bits, as signed longs."""
    draw = random.Random(seed)
    rows = [draw.randrange(1, 1 << (radius + 1)) for _ in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(rows) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _across(forest: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> None:
    """Join what is within ``radius`` between the places of one block or of two."""
    at = left if left is right else np.concatenate([left, right])
    near = np.bitwise_count(values[at][:, None] ^ values[at][None, :]) <= radius
    _merge(forest, at, at[block_components(near)])


def _roots(forest: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = forest[at]
    while (forest[up] != up).any():
        up = forest[up]
    forest[at] = up
    return up


def _merge(forest: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
    """Put the places ``at`` under the same roots as their partners ``to``."""
    while True:
        x, y = _roots(forest, at), _roots(forest, to)
        if (x == y).all():
            return
        np.minimum.at(forest, np.maximum(x, y), np.minimum(x, y))


def _connect(values: np.ndarray, places: np.ndarray, forest: np.ndarray, radius: int, level: int) -> None:
    """Join all places of a bucket that are within ``radius``.

    A bucket above one block is dealt again by the masks of another covering,
    which misses no pair either; what is already one component is left alone.
    After MAX_LEVEL coverings the rest is compared block by block.
    """
    if len(places) <= BLOCK:
        _across(forest, values, places, places, radius)
        return
    if level < MAX_LEVEL:
        for mask in covering_masks(radius, seed=MASK_SEED + level):
            key = values[places] & np.int64(mask).view(np.uint64)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for run in np.split(places[order], cuts):
                if len(run) > 1 and len(run) < len(places) and len(np.unique(_roots(forest, run))) > 1:
                    _connect(values, run, forest, radius, level + 1)
                elif len(run) == len(places):
                    _blocks(values, run, forest, radius)
        return
    _blocks(values, places, forest, radius)


def _blocks(values: np.ndarray, places: np.ndarray, forest: np.ndarray, radius: int) -> None:
    parts = [places[i:i + BLOCK // 2] for i in range(0, len(places), BLOCK // 2)]
    for i, left in enumerate(parts):
        for right in parts[i:]:
            if len(np.unique(_roots(forest, np.concatenate([left, right])))) > 1:
                _across(forest, values, left, right, radius)


def bucket_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (place of a fingerprint, place of its root) spanning one bucket of distinct fingerprints."""
    if len(values) == 2:
        near = np.bitwise_count(values[0] ^ values[1]) <= radius
        return (np.array([1]), np.array([0])) if near else (np.empty(0, np.int64),) * 2
    forest = np.arange(len(values))
    _connect(values, np.arange(len(values)), forest, radius, 1)
    root = _roots(forest, np.arange(len(values)))
    below = np.flatnonzero(root != np.arange(len(values)))
    return below, root[below]


def _links_of_runs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = None  # the last bucket seen; it may go on in the next batch

        def links(table, bucket, fp, cuts):
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            for i in np.flatnonzero(ends - starts > 1):
                values = np.unique(fp[starts[i]:ends[i]])
                if len(values) > 1:
                    x, y = bucket_links(values, radius)
                    a.append(values[x])
                    b.append(values[y])
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            now = (batch.column("table").to_numpy(), batch.column("bucket").to_numpy(),
                   batch.column("fp").to_numpy().view(np.uint64))
            if not len(now[0]):
                continue
            if open_run is not None:
                now = tuple(np.concatenate(x) for x in zip(open_run, now))
            cuts = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            open_run = tuple(x[last:].copy() for x in now)
            if last:
                yield links(*(x[:last] for x in now), cuts[:-1])
        if open_run is not None:
            yield links(*open_run, np.empty(0, np.int64))

    return run


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that span the components of distinct fingerprints at distance ``radius`` or less.

    Each distinct fingerprint goes to one bucket of every table.  Buckets are
    streamed from a sorted partition, a bucket gives at most one link a member,
    and only one bucket's distinct fingerprints are held at a time.
    """
    tables = [F.struct(F.lit(i).cast("short").alias("table"),
                       F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(covering_masks(radius))]
    return (fingerprints.select("fp", F.explode(F.array(*tables)).alias("t"))
            .select("t.table", "t.bucket", "fp")
            .repartition("table", "bucket").sortWithinPartitions("table", "bucket", "fp")
            .mapInArrow(_links_of_runs(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    A null or blank text has fingerprint 0 and is linked like any other.  Exact
    copies and repeated rows share a fingerprint, which is compared once.
    ``component_id`` is the smallest non-null doc_id reachable, null only where a
    component has none.  Columns besides doc_id and text are not read.
    """
    marked = written(with_fingerprints(docs), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint_classes")
    roots = components(fingerprint_links(classes.select("fp"), radius))
    rooted = (classes.join(roots, classes.fp == roots.node, "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
