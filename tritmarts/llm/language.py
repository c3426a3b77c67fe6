"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the character n-grams (1 to 4 letters, words separated by
one blank) that occur in both, whatever their number: k(a, b) = |A n B| / sqrt(|A| |B|).
Grams are hashed to a fixed number of bins.  A Nystroem map over landmark texts turns
the kernel into few features, on which one ridge regression per language is solved
(one versus rest).  The kernel is linear in the presence of grams, so landmarks,
map and regressions multiply out to one weight per gram and language, and texts are
scored by products of presence matrices with these weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.llm.tables import in_small_batches

GRAMS = 4
BINS = 1 << 16
#: bounds of the sample: rows a language is learned from at most, rows in all (but MIN_ROWS a language), landmarks
MAX_ROWS = 800
TOTAL_ROWS = 3200
MIN_ROWS = 20
LANDMARKS = 256
#: with many languages LANDMARKS grows to this many a language, to MOST_LANDMARKS (of BINS x 4 bytes) at most
LANGUAGE_LANDMARKS = 4
MOST_LANDMARKS = 1024
RIDGE = 0.3
FOLDS = 5
#: texts scored at once
BATCH = 16
UNKNOWN = "und"
_STRIDE = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # bins x languages


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: str | None) -> np.ndarray | None:
    """Which bins the n-grams of a text fall into; None for a text without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter | np.concatenate([[True], letter[:-1]])
    points = np.where(letter, points, np.uint32(32))[keep]
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)
    bins = np.zeros(BINS, bool)
    code = np.zeros(len(points), np.uint32)
    for n in range(min(GRAMS, len(points))):
        code = code[:len(points) - n] * _STRIDE + points[n:] + np.uint32(1)
        bins[(code * _MIX) >> np.uint32(16)] = True
    return bins


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem features over landmarks dealt evenly to the languages, then kernel ridge regression."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros((BINS, 0), np.float32))
    place = {lang: 0 for lang in languages}
    order = []
    for i, (lang, _) in enumerate(rows):
        order.append((place[lang], lang, i))
        place[lang] += 1
    landmarks = max(landmarks, min(LANGUAGE_LANDMARKS * len(languages), MOST_LANDMARKS))
    marks = [i for _, _, i in sorted(order)[:landmarks]]

    def unit(part: list[int]) -> np.ndarray:
        block = np.empty((len(part), BINS), np.float32)
        for place, i in enumerate(part):
            block[place] = np.unpackbits(rows[i][1])
        block /= np.sqrt(block.sum(axis=1, keepdims=True))
        return block

    base = unit(marks)
    cross = np.concatenate([unit(list(range(at, min(at + BATCH, len(rows))))) @ base.T for at in range(0, len(rows), BATCH)])
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    use = value > 1e-6 * value[-1]
    root = vector[:, use] / np.sqrt(value[use])
    features = cross.astype(np.float64) @ root
    wanted = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ wanted)
    return Model(languages, base.T @ (root @ solved).astype(np.float32))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [presence(t.as_py()) for t in batch.column("text")]
        keep = [i for i, p in enumerate(found) if p is not None]
        yield pa.RecordBatch.from_arrays([
            batch.column("lang").take(pa.array(keep, pa.int64())), batch.column("place").take(pa.array(keep, pa.int64())),
            pa.array([np.packbits(found[i]).tobytes() for i in keep], pa.binary())], names=["lang", "place", "bits"])


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def learn(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows outside fold 0; the rows of a language are those of the least hash.

    What reaches the driver are presence bits: at most max(TOTAL_ROWS, MIN_ROWS x languages)
    rows of BINS / 8 bytes.
    """
    labelled = in_small_batches(docs).where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id").alias("place"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([])
    each = min(MAX_ROWS, max(MIN_ROWS, TOTAL_ROWS // len(counts)))
    # hashes are spread evenly, so three times the wanted share holds enough rows but for a negligible chance
    limits = docs.sparkSession.createDataFrame(
        [(lang, min(2**64 - 1, 2**64 * 3 * (each + 20) // n) - 2**63) for lang, n in counts.items()],
        "lang string, highest long")
    near = (labelled.join(F.broadcast(limits), "lang").where("place <= highest")
            .groupBy("lang", "place").agg(F.min("text").alias("text")))
    bits = near.mapInArrow(_featured, "lang string, place long, bits binary")
    kept = bits.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "bits"))), 1, each).alias("rows"))
    # as Arrow, whose buffers are read in place: plain rows stand in the driver as objects of the JVM and again of Python
    sample = kept.select("lang", F.explode("rows").alias("r")).select("lang", "r.place", "r.bits").toArrow()
    rows = zip(sample["place"].to_pylist(), sample["lang"].to_pylist(), sample["bits"])
    return fit([(lang, np.frombuffer(b.as_buffer(), np.uint8)) for _, lang, b in sorted(rows, key=lambda r: r[:2])])


def sureness(values: np.ndarray) -> np.ndarray:
    """How far the best of a text's values (a row each) stands out, whatever the number of languages.

    0 if all languages are alike to the text, 1 if the best is at its target and the others at theirs (1
    and -1).  With one language it is the value itself, 0 for a text of which it has seen nothing.
    """
    n = values.shape[1]
    best = values.max(axis=1).astype(np.float64)
    ahead = best if n == 1 else (best - values.mean(axis=1, dtype=np.float64)) * n / (2 * (n - 1))
    return np.clip(ahead, 0, 1)


def _predicted(model: Model, names: list[str], sure_too: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            best = np.full(batch.num_rows, len(model.languages))
            score, sure = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            texts = batch.column("text")
            for at in range(0, batch.num_rows if model.languages else 0, BATCH):
                found = [(i, p) for i in range(at, min(at + BATCH, batch.num_rows))
                         if (p := presence(texts[i].as_py())) is not None]
                if found:
                    rows = np.array([i for i, _ in found])
                    block = np.stack([p for _, p in found]).astype(np.float32)
                    values = block @ model.weights / np.sqrt(block.sum(axis=1, keepdims=True))
                    best[rows] = values.argmax(axis=1)
                    sure[rows] = sureness(values)
                    score[rows] = np.clip((1 + values.max(axis=1).astype(np.float64)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names],
                                              pa.array(languages[best], pa.string()), pa.array(score), *[pa.array(sure)] * sure_too],
                                             names=[*names, "lang_pred", "score", *["sure"] * sure_too])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score, sure): the whole document with its language; a text that is null or has no letters is ``und``, 0, 0.

    Only the text is used.  Texts are read whole; equal texts get equal answers.
    """
    rows = in_small_batches(docs).select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predicted(model, ["row"], True), f"row {kind}, lang_pred string, score double, sure double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Rows with a null doc_id are in no fold: they are not learned from, and not held out.
    """
    model = learn(docs)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(_predicted(model, ["doc_id"]), "doc_id long, lang_pred string, score double").select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
