"""Near-duplicate documents: five-word shingles of whole texts, SimHash and MinHash buckets, exact Jaccard, components.

Texts with equal words (A-Z in lower case, any white space between) are one class before
anything is compared.  Candidates are the classes whose SimHash fingerprints are linked, as in ``simhash``
but over five words, and those that share a MinHash band: fingerprints within few bits meet nearly equal texts
whatever their bands, bands meet the rest down to the threshold.  Signatures are written without the shingle sets; only texts that share a
bucket with another class are read again for the exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tritmarts.llm.components import components
from tritmarts.llm.passages import THRESHOLD, _links_of_runs, _lists, band_values, shared_buckets, shingles
from tritmarts.llm.simhash import fingerprint, fingerprint_links
from tritmarts.llm.tables import in_small_batches, row_key, written

SHINGLE_WORDS = 5
#: stands for the bands of a bucket of linked fingerprints
LINKED = -1


def _signed(digest: int) -> int:
    return digest - (digest >> 63 << 64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, prints, bands = [], [], []
        for text in batch.column("text"):
            whole = text.as_py() or ""
            _, digest, values = shingles(whole)
            digests.append(_signed(digest))
            prints.append(_signed(fingerprint(whole.encode(), SHINGLE_WORDS)))
            bands.append(band_values(values).view(np.int64))
        if digests:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("text_key"), pa.array(digests, pa.int64()),
                 pa.array(prints, pa.int64()), _lists(bands, pa.int64())],
                names=["doc_id", "row", "text_key", "digest", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sets = [], []
        for text in batch.column("text"):
            _, digest, values = shingles(text.as_py() or "")
            digests.append(_signed(digest))
            sets.append(np.unique((values >> np.uint64(32)).astype(np.uint32)).view(np.int32))
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), _lists(sets, pa.int32())],
                                             names=["digest", "shingles"])


def linked_fingerprints(classes: DataFrame) -> DataFrame:
    """(band, value, digest) of the components of linked fingerprints of ``classes`` (digest, fp) with more than one class."""
    roots = components(fingerprint_links(classes.select("fp").distinct()))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("digest", F.coalesce("root", "fp").alias("value"))
    several = rooted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return rooted.join(several, "value").select(F.lit(LINKED).alias("band"), "value", "digest")


def near_texts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, component, component_id) of every row of ``docs`` (doc_id, text).

    Two texts that met are linked if the Jaccard similarity of their sets of five-word shingles is
    at least ``threshold``; a text of fewer words is one shingle.  Null and blank texts are
    alike.  ``row`` is the row's key, ``component`` names its component and ``component_id`` is the component's
    smallest non-null doc_id, null only where it has none.
    """
    keyed = in_small_batches(docs).select(F.col("doc_id").cast("long"), row_key(*docs.columns).alias("row"),
                                          row_key("text").alias("text_key"), F.col("text").cast("string"))
    marked = written(keyed.mapInArrow(
        _signatures, "doc_id long, row long, text_key long, digest long, fp long, bands array<long>"), "text_signatures")
    classes = written(marked.groupBy("digest").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("first_id"),
                                                   F.min("fp").alias("fp"), F.min("bands").alias("bands")), "text_classes")
    met = written(shared_buckets(classes).unionByName(linked_fingerprints(classes)), "text_buckets")
    again = classes.join(met.select("digest").distinct(), "digest", "left_semi").select("text_key")
    sets = keyed.join(again, "text_key", "left_semi").select("text").mapInArrow(
        _sets, "digest long, shingles array<int>").dropDuplicates(["digest"])
    links = (met.join(sets, "digest").repartition("band", "value").sortWithinPartitions("band", "value", "digest")
             .mapInArrow(_links_of_runs(threshold), "a long, b long"))
    roots = components(links)
    rooted = classes.join(roots, classes.digest == roots.node, "left").select(
        "digest", "first_id", F.coalesce("root", "digest").alias("component"))
    least = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("digest", "component").join(least, "component")
    return marked.select("doc_id", "row", "digest").join(named, "digest").select("doc_id", "row", "component", "component_id")
