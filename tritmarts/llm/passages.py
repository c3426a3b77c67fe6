"""Substring dedup: repeated paragraphs by MinHash banding, verified by exact Jaccard, removed by components.

Equal paragraphs are one class before anything is compared.  A class takes MinHash
values of its word shingles (A-Z in lower case); bands of them are buckets, tuned so that a pair at the
threshold shares one with the wanted recall.  Only classes that share a bucket with another
class are looked at again: their shingle sets are compared exactly, and a bucket gives
at most one link for each merge.  Components of the links keep their first paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tritmarts.llm.components import components
from tritmarts.llm.tables import in_small_batches, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.998
#: shorter paragraphs are left alone
LEAST_WORDS = 50
SEED = 23
#: shingles hashed against all permutations at once
CHUNK = 4096


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 3) -> int:
    """Bands of ``rows`` values with which a pair at the threshold collides with at least ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


ROWS = 3
BANDS = bands_for(rows=ROWS)
_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(line: str) -> tuple[int, int, np.ndarray]:
    """(words, digest, sorted distinct 64-bit shingle hashes) of a paragraph in lower case."""
    tokens = line.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(tokens) - SHINGLE_WORDS + 1)
    first = (ends - sizes)[:n].tolist()
    last = (ends[SHINGLE_WORDS - 1:] if len(tokens) > SHINGLE_WORDS else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    values = np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(first, last)], np.uint64))
    return len(tokens), digest(joined, SEED + 1), values


def band_values(values: np.ndarray) -> np.ndarray:
    """One 64-bit value per band from the MinHash values of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), CHUNK):
        least = np.minimum(least, (values[at:at + CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0))
    mixed = (least >> np.uint64(7)).reshape(BANDS, ROWS) * _FOLD
    return (mixed[:, 0] ^ (mixed[:, 1] << np.uint64(1)) ^ mixed[:, 2]) * _FOLD[0]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _paragraphs(least_words: int):
    names = ["doc_id", "paragraph", "start", "end", "n_words", "digest", "bands", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bands, sets = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                at = 0
                for place, line in enumerate((text.as_py() or "").split("\n")):
                    start, at = at, at + len(line) + 1
                    if len(line) < 2 * least_words - 1:  # too short for so many words
                        continue
                    words, digest, values = shingles(line) if line.strip() else (0, 0, None)
                    if words >= least_words:
                        rows.append((doc_id, place, start, start + len(line), words, digest - (digest >> 63 << 64)))
                        bands.append(band_values(values).view(np.int64))
                        sets.append((values >> np.uint64(32)).astype(np.uint32).view(np.int32))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*[pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)],
                                                  _lists(bands, pa.int64()), _lists(sets, pa.int32())], names=names)

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bucket_links(digests: list[int], sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that span the single-link components of one bucket.

    A class is compared with the members of each component until one is near
    enough; in a bucket of near copies that is the first.
    """
    groups: list[list[int]] = []
    links = []
    for i in range(len(digests)):
        mine, rest = [i], []
        for group in groups:
            near = next((j for j in group if min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j]))
                         and similarity(sets[i], sets[j]) >= threshold), None)
            if near is None:
                rest.append(group)
            else:
                links.append((digests[i], digests[near]))
                mine = group + mine
        groups = [*rest, mine]
    return links


def _links_of_runs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digests, sets = None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            lists = batch.column("shingles")
            values, offsets = lists.values.to_numpy().view(np.uint32), lists.offsets.to_numpy()
            for i, here in enumerate(zip(batch.column("band").to_pylist(), batch.column("value").to_pylist(),
                                         batch.column("digest").to_pylist())):
                if here[:2] != key:
                    found += bucket_links(digests, sets, threshold)
                    key, digests, sets = here[:2], [], []
                digests.append(here[2])
                sets.append(values[offsets[i]:offsets[i + 1]].copy())
            yield _pairs(found)
        yield _pairs(bucket_links(digests, sets, threshold))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                                      names=["a", "b"])


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(band, value, digest) of the buckets of ``classes`` (digest, bands) with more than one class.

    Of buckets with the same members, which near copies give in most bands, one is enough.
    """
    buckets = classes.select("digest", F.posexplode("bands").alias("band", "value"))
    mark = F.xxhash64("digest")
    shared = buckets.groupBy("band", "value").agg(
        F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(20,0)")).alias("y"),
        F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1")
    one = shared.groupBy("n", "x", "y", "low", "high").agg(F.min(F.struct("band", "value")).alias("at")).select("at.*")
    return buckets.join(one, ["band", "value"])


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """Paragraphs of ``docs`` (doc_id, text) that occur, alike to the threshold, in more than one document.

    One row per paragraph: doc_id, paragraph (line number from 0), start and end (code
    points, end exclusive), n_words, kept_doc_id, kept_paragraph, removed.  The cluster's smallest
    (doc_id, paragraph) is kept, and names it.  A paragraph is a line of at least ``least_words`` words; null and empty texts have none.  Repeated
    rows of one doc_id are one document; a null doc_id sorts before all others.  Other columns are not read.
    """
    lines = written(in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _paragraphs(least_words), "doc_id long, paragraph int, start long, end long, n_words long, digest long, "
        "bands array<long>, shingles array<int>"), "paragraphs")
    classes = written(lines.groupBy("digest").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.min("doc_id").alias("low"),
                                                  F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"),
                                                  F.min("bands").alias("bands")), "paragraph_classes")
    met = written(shared_buckets(classes), "paragraph_buckets")
    sets = lines.join(met.select("digest").distinct(), "digest", "left_semi").select("digest", "shingles").dropDuplicates(["digest"])
    links = (met.join(sets, "digest").repartition("band", "value").sortWithinPartitions("band", "value", "digest")
             .mapInArrow(_links_of_runs(threshold), "a long, b long"))
    roots = components(links)
    named = classes.join(roots, classes.digest == roots.node, "left").select(
        "digest", "first", "low", "high", "unnamed", F.coalesce("root", "digest").alias("cluster_id"))
    clusters = named.groupBy("cluster_id").agg(F.min("first").alias("kept"), F.min("low").alias("low"), F.max("high").alias("high"),
                                               F.sum("unnamed").alias("unnamed"))
    across = clusters.where("low < high or unnamed > 1 or (unnamed > 0 and low is not null)").select("cluster_id", "kept")
    member = written(named.select("digest", "cluster_id").join(across, "cluster_id").select("digest", "kept"), "paragraph_clusters")
    place = F.struct("doc_id", "paragraph")
    return lines.select("doc_id", "paragraph", "start", "end", "n_words", "digest").join(member, "digest").select(
        "doc_id", "paragraph", "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.paragraph").alias("kept_paragraph"), (~place.eqNullSafe(F.col("kept"))).alias("removed"))


def without_passages(docs: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of their texts; texts without one stay as they are."""
    gone = (repeated_passages(docs, threshold, least_words).where("removed").groupBy("doc_id")
            .agg(F.collect_set("paragraph").alias("gone")).select(F.col("doc_id").alias("key"), "gone"))
    rows = docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id").eqNullSafe(F.col("key")), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
