"""Nearest neighbours by randomly rotated one-bit codes.

A vector's unit form is rotated by a seeded random rotation and kept as signs
(one bit a dimension) with two scalars: its length, and the product f of the unit
form with its signs.  The product of the signs with a rotated query, over f,
estimates the inner product without bias, and its error stays below
EPSILON * sqrt((1 - f^2) / f^2 / (D - 1)) times both lengths with high probability.
A query is rounded to QUERY_BITS bits a dimension, so that its product with the
signs is a weighted sum of bit counts of packed words; the rounding widens the bound.

Vectors are dealt into cells of unit directions.  Every query first finds its k-th
best exact product in a bounded sample of the vectors, which no k-th best of all
vectors is below.  It travels only to cells whose centre and radius let a member
reach that product, and there only members whose estimate plus bound reach it are
reranked on original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tritmarts.llm.embedding_dedup import spherical_kmeans
from tritmarts.llm.tables import written
from tritmarts.llm.vectors import by_id, exact_products, matrix, usable

NEAREST = 20
EVERY = 20
EPSILON = 4.0
SEED = 11
#: queries and vectors that meet in one task's group
QUERY_BLOCK = 16384
VECTOR_BLOCK = 8192
#: queries estimated at once
SLICE = 32
#: bits that a dimension of a rotated query is rounded to
QUERY_BITS = 6
#: numbers in the sample that cells are fitted on and that gives each query its first bound (8 MB of doubles)
SAMPLE_NUMBERS = 1 << 20
#: vectors of a cell on average, and most cells; all rows are indexed, a larger cell is split into blocks
CELL = 4096
MAX_CELLS = 1024
ROUNDS = 6
#: what sums of doubles may differ by, times both lengths
ROUNDING = 1e-9


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, length, f) of the rows."""
    scale = np.abs(values).max(axis=1)
    length = scale * np.linalg.norm(values / scale[:, None], axis=1)
    rotated = (values / length[:, None]) @ rotation(values.shape[1])
    return np.packbits(rotated > 0, axis=1), length, np.abs(rotated).sum(axis=1) / np.sqrt(values.shape[1])


def _lengths(values: np.ndarray) -> np.ndarray:
    scale = np.abs(values).max(axis=1)
    return scale * np.linalg.norm(values / scale[:, None], axis=1)


def _codes(centroids: np.ndarray):
    """Code, cell and distance to the cell's centre of every vector; a length unlike the centroids' has a cell of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            for n in np.unique(sizes):
                part = batch.filter(pa.array(sizes == n))
                values = matrix(part.column("embedding"), part.num_rows)
                bits, length, f = encode(values)
                if n == centroids.shape[1]:
                    units = values / length[:, None]
                    cell = (units @ centroids.T).argmax(axis=1)
                    radius = np.linalg.norm(units - centroids[cell], axis=1)
                else:
                    cell, radius = np.full(len(bits), -1 - n), np.full(len(bits), 2.0)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id"), pa.array(cell.astype(np.int32)), part.column("embedding"),
                    pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(f), pa.array(radius)],
                    names=["vec_id", "cell", "embedding", "code", "length", "f", "radius"])

    return run


def _visits(centroids: np.ndarray, cells: list, sample: np.ndarray, sample_ids: np.ndarray, k: int):
    """(query_id, embedding, least, cell) for each cell in which a query may find one of its k best."""
    name = np.array([c.cell for c in cells if c.cell >= 0], np.int32)
    radius, low, high = (np.array([c[x] for c in cells if c.cell >= 0]) for x in ("radius", "low", "high"))
    kept = name.astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            for n in np.unique(sizes):
                same = batch.filter(pa.array(sizes == n))
                for at in range(0, same.num_rows, 256):
                    part = same.slice(at, 256)
                    asked = matrix(part.column("embedding"), part.num_rows)
                    ids, length = part.column("query_id").to_numpy(), _lengths(asked)
                    least = np.full(len(asked), -np.inf)
                    if n == sample.shape[1]:
                        if len(sample) > k:
                            products = asked @ sample.T
                            products[ids[:, None] == sample_ids[None, :]] = -np.inf
                            least = np.partition(products, len(sample) - k, axis=1)[:, len(sample) - k]
                        direct = asked @ centroids[kept].T + length[:, None] * radius
                        most = np.where(direct > 0, direct * high, direct * low) + ROUNDING * length[:, None] * high
                        row, at_cell = np.nonzero(~(most < least[:, None]))
                        cell = name[at_cell]
                    else:
                        row, cell = np.arange(len(asked)), np.full(len(asked), -1 - n, np.int32)
                    taken = pa.array(row)
                    yield pa.RecordBatch.from_arrays([
                        part.column("query_id").take(taken), part.column("embedding").take(taken), pa.array(least[row]),
                        pa.array(cell)], names=["query_id", "embedding", "least", "cell"])

    return run


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bytes as 64-bit words, the last filled up with zeros."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    padded[:, :bits.shape[1]] = bits
    return padded.view(np.uint64)


def estimates(asked: np.ndarray, code: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products of rotated unit queries with the signs, by bit counts; lengths of what rounding the queries left out).

    ``code`` are the vectors' words, ``ones`` their numbers of set bits.
    """
    low = asked.min(axis=1, keepdims=True)
    step = np.maximum(asked.max(axis=1, keepdims=True) - low, 1e-300) / (2 ** QUERY_BITS - 1)
    digits = np.rint((asked - low) / step).astype(np.uint8)
    left = np.linalg.norm(asked - (low + step * digits), axis=1)
    total = np.zeros((len(asked), len(code)), np.int32)
    met, count = np.empty(total.shape, np.uint64), np.empty(total.shape, np.uint8)
    for bit in range(QUERY_BITS):
        plane = words(np.packbits((digits >> bit) & 1, axis=1))
        for w in range(code.shape[1]):
            np.bitwise_and(plane[:, w, None], code[None, :, w], out=met)
            np.bitwise_count(met, out=count)
            total += np.left_shift(count, bit, dtype=np.int32)
    signs = (2 * step).astype(np.float32) * total
    signs += (2 * low).astype(np.float32) * ones
    signs -= (low * asked.shape[1] + step * digits.sum(axis=1, keepdims=True)).astype(np.float32)
    return signs, left


def _searched(k: int, epsilon: float):
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and vectors.num_rows:
            asked = matrix(queries.column("embedding"), queries.num_rows)
            query_ids, least = queries.column("query_id").to_numpy(), queries.column("least").to_numpy()
            values = matrix(vectors.column("embedding"), vectors.num_rows)
            ids = vectors.column("vec_id").to_numpy()
            dim = values.shape[1]
            code = words(np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(ids), -1))
            ones = np.bitwise_count(code).sum(axis=1).astype(np.float32)
            length, f = vectors.column("length").to_numpy(), vectors.column("f").to_numpy()
            scale = (1 / f / np.sqrt(dim)).astype(np.float32)
            blur = epsilon / f / np.sqrt(max(1, dim - 1))
            bound = (blur * np.sqrt(np.maximum(0, 1 - f * f)) + 1e-5).astype(np.float32)
            blur, shorter = blur.astype(np.float32), (1 / length).astype(np.float32)
            for at in range(0, len(asked), SLICE):
                part = asked[at:at + SLICE]
                size = _lengths(part)
                signs, left = estimates((part / size[:, None]) @ rotation(dim), code, ones)
                signs *= scale
                signs += bound
                signs += left[:, None].astype(np.float32) * blur
                # written so that a comparison with something that is not a number chooses the vector
                chosen = ~(signs < (least[at:at + SLICE] / size).astype(np.float32)[:, None] * shorter)
                rows = np.flatnonzero(chosen.any(axis=0))
                score = part @ values[rows].T
                score[~chosen[:, rows]] = -np.inf
                score[query_ids[at:at + SLICE, None] == ids[None, rows]] = -np.inf
                near = ROUNDING * size[:, None] * length[rows]
                reach = (score >= least[at:at + SLICE, None] - near) & (score > -np.inf)
                for i in np.flatnonzero(reach.any(axis=1)):
                    here = np.flatnonzero(reach[i])
                    if len(here) > k:
                        last = np.partition(score[i, here], len(here) - k)[len(here) - k]
                        here = here[score[i, here] >= last - 2 * near[i, here].max()]
                    exact = exact_products(values[rows[here]], part[i])
                    best = np.lexsort((ids[rows[here]], -exact))[:k]
                    out.append((np.full(len(best), query_ids[at + i]), ids[rows[here]][best], exact[best]))
        if not out:
            return kinds.empty_table()
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=kinds)

    return run


def _sample(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a seeded sample of the most frequent length, at most SAMPLE_NUMBERS numbers."""
    size = F.size("embedding")
    usual = vectors.groupBy(size.alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if usual is None:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    drawn = vectors.where(size == usual.dim).orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(
        max(1, SAMPLE_NUMBERS // usual.dim)).toArrow()
    return drawn.column("vec_id").to_numpy(), matrix(drawn.column("embedding"), drawn.num_rows)


def search(rows: DataFrame, k: int = NEAREST, every: int = EVERY, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors with the largest inner product for each query.

    Queries are the rows of ``rows`` (vec_id, embedding) whose id ``every`` divides;
    all other rows of the same length are their candidates.  Null ids and vectors
    that are null, zero or hold null or non-finite components take no part; of rows that
    repeat an id the least counts.  Ties go to the smaller id.  Cells and first
    bounds come from a sample of SAMPLE_NUMBERS numbers and at most MAX_CELLS
    centroids; every vector is indexed.  A cell is split into blocks of about
    VECTOR_BLOCK vectors and QUERY_BLOCK visiting queries, so no cell, however
    hot, is one group; a block pair keeps at most k rows a query.
    """
    kind = dict(rows.dtypes)["embedding"]
    vectors = written(by_id(rows.select("vec_id", "embedding").where(usable()), "embedding"), "search_vectors")
    sample_ids, sample = _sample(vectors)
    units = sample / _lengths(sample)[:, None] if len(sample) else np.eye(1)
    centroids = spherical_kmeans(units, min(MAX_CELLS, -(-vectors.count() // CELL) or 1), ROUNDS, SEED)
    codes = written(vectors.mapInArrow(
        _codes(centroids), f"vec_id long, cell int, embedding {kind}, code binary, length double, f double, radius double"), "codes")
    cells = written(codes.groupBy("cell").agg(
        F.max("radius").alias("radius"), F.min("length").alias("low"), F.max("length").alias("high"),
        F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("vector_blocks")), "cells")
    # cells of lengths unlike the usual one are not sent: their names follow from the length
    bounds = cells.where("cell >= 0").collect()
    asked = codes.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    visits = written(asked.mapInArrow(_visits(centroids, bounds, sample, sample_ids, k),
                                      f"query_id long, embedding {kind}, least double, cell int"), "visits")
    blocks = cells.join(visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")),
                        "cell").select("cell", "vector_blocks", "query_blocks")
    queries = visits.join(blocks, "cell").select(
        "cell", "query_id", "embedding", "least", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("vector_blocks") - 1)).alias("vb"))
    coded = codes.join(blocks, "cell").select(
        "cell", "vec_id", "embedding", "code", "length", "f", F.pmod(F.xxhash64("vec_id"), "vector_blocks").cast("int").alias("vb"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"))
    found = queries.groupBy("cell", "qb", "vb").cogroup(coded.groupBy("cell", "qb", "vb")).applyInArrow(
        _searched(k, epsilon), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
