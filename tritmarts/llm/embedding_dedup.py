"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them.

Two vectors within the threshold are at most ``r = sqrt(2 - 2 t)`` apart on the
sphere.  If they fall into different cells, their distances to the plane between
both centroids add up to at most r, so one of the two is within r / 2 of it.
A vector therefore also visits every cell whose plane is within r / 2: no pair
is missed at cell borders, and a pair seen in both cells is counted in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tritmarts.llm.components import block_components, components
from tritmarts.llm.tables import written
from tritmarts.llm.vectors import by_id, matrix, usable

THRESHOLD = 0.98
#: vectors a cell holds on average, most cells, and most vectors the centroids are fitted on
CELL = 2048
MAX_CELLS = 1024
SAMPLE = 16384
ROUNDS = 12
SEED = 5
#: vectors on one side of a blocked product
BLOCK = 1024
#: centroids whose planes are tested at once
SLICE = 512


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit rows; a centroid without members stays where it was."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centroids)
    return centroids


def _planes(units: np.ndarray, home: np.ndarray, scores: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Distance of each row to the plane between its home centroid and every centroid."""
    gap = scores[np.arange(len(units)), home][:, None] - scores
    between = apart[home]
    return np.where(between > 0, gap / np.where(between > 0, between, 1), np.where(gap > 0, np.inf, 0))


def _visits(centroids: np.ndarray, reach: float):
    dim = centroids.shape[1]
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy()
            for n in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == n))
                for at in range(0, rows.num_rows, SLICE):
                    part = rows.slice(at, SLICE)
                    values = matrix(part.column("embedding"), part.num_rows)
                    values = values / np.abs(values).max(axis=1)[:, None]
                    units = values / np.linalg.norm(values, axis=1)[:, None]
                    if n == dim:
                        scores = units @ centroids.T
                        home = scores.argmax(axis=1)
                        near = _planes(units, home, scores, apart) <= reach
                        near[np.arange(len(units)), home] = True
                        row, cell = np.nonzero(near)
                    else:  # a length other than the usual one has a cell of its own
                        row, home = np.arange(len(units)), np.full(len(units), -1 - n)
                        cell = home
                    flat = pa.array(units[row].ravel())
                    yield pa.RecordBatch.from_arrays([
                        part.column("label").take(pa.array(row)), part.column("rep").take(pa.array(row)),
                        part.column("n").take(pa.array(row)), pa.array(cell.astype(np.int32)),
                        pa.array(home[row].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * int(n)), flat)],
                        names=["label", "rep", "n", "cell", "home", "unit"])

    return run


def _compared(centroids: np.ndarray, reach: float, threshold: float):
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    kinds = [("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        side = table.column("side").to_numpy()
        rep, weight = table.column("rep").to_numpy(), table.column("n").to_numpy()
        cell, home = table.column("cell").to_numpy(), table.column("home").to_numpy()
        units = matrix(table.column("unit"), len(rep))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(right) and not table.column("ghosts")[0].as_py() and table.column("i")[0] == table.column("j")[0]
        if own:
            right = left
        near = units[left] @ units[right].T >= threshold
        if own:
            np.fill_diagonal(near, False)
        elif len(left) and len(right) and table.column("ghosts")[0].as_py():
            # a pair that the visitor's home cell sees as well is counted in the smaller cell
            here, away = int(cell[0]), home[right]
            scores = units[left] @ (centroids[here][None, :] - centroids[away]).T
            width = apart[here, away][None, :]
            both = np.where(width > 0, scores / np.where(width > 0, width, 1), 0) <= reach
            near &= ~(both & (away < here)[None, :])
        out_links = np.zeros(len(rep), np.int64)
        np.add.at(out_links, left, near @ weight[right])
        if not own:
            np.add.at(out_links, right, near.T @ weight[left])
        square = np.zeros((len(rep), len(rep)), bool)
        square[np.ix_(left, right)] = near
        labels = block_components(square | square.T)
        keep = out_links > 0
        return pa.table([pa.array(rep[keep]), pa.array(out_links[keep]), pa.array(rep[labels][keep])],
                        schema=pa.schema(kinds))

    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vec_id of ``rows`` (vec_id, embedding, label).

    Only vectors of equal non-null label and equal length are compared.  A null id
    names no vector and has no row; of rows that repeat an id the least counts, and it is
    one vector.  Vectors that are null, zero or hold null or non-finite components
    link with nothing.  Equal vectors of a label form one class before cells are
    dealt, so copies cost one row.
    """
    reach = float(np.sqrt(2 - 2 * threshold) / 2 + 1e-9)
    vectors = written(by_id(rows.select("vec_id", "embedding", "label"), "label", "embedding"), "vectors")
    linking = vectors.where(usable()).where("label is not null")
    classes = written(linking.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")),
                      "vector_classes")
    total = classes.count()
    drawn = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").collect()
    sizes = [len(r.embedding) for r in drawn]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
    sample = np.array([r.embedding for r in drawn if len(r.embedding) == dim], np.float64).reshape(-1, dim)
    sample = sample / np.maximum(np.abs(sample).max(axis=1, initial=0), 1e-300)[:, None]
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1), 1e-300)[:, None]
    centroids = spherical_kmeans(sample, min(MAX_CELLS, -(-total // CELL))) if len(sample) else np.eye(1)
    visits = written(classes.mapInArrow(
        _visits(centroids, reach), f"label {dict(rows.dtypes)['label']}, rep long, n long, cell int, home int, unit array<double>"), "visits")
    guest = F.col("cell") != F.col("home")
    cells = visits.groupBy("label", "cell").agg(
        F.ceil(F.count_if(~guest) / BLOCK).cast("int").alias("homes"),
        F.ceil(F.count_if(guest) / BLOCK).cast("int").alias("guests"))
    block = F.pmod(F.xxhash64("rep"), F.when(guest, F.col("guests")).otherwise(F.col("homes"))).cast("int")
    at = visits.join(cells, ["label", "cell"]).where("homes > 0").withColumn("block", block)
    others = F.sequence(F.lit(0), F.col("homes") - 1)
    mine = F.transform(others, lambda j: F.struct(
        F.lit(False).alias("ghosts"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"),
        (F.col("block") > j).cast("int").alias("side")))
    with_guests = F.when(F.col("guests") > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("guests") - 1, F.lit(0))), lambda j: F.struct(
            F.lit(True).alias("ghosts"), F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    as_guest = F.transform(others, lambda i: F.struct(
        F.lit(True).alias("ghosts"), i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    pairs = F.when(guest, as_guest).otherwise(F.concat(mine, F.coalesce(with_guests, F.array().cast(
        "array<struct<ghosts:boolean,i:int,j:int,side:int>>"))))
    found = written(at.select("label", "rep", "n", "cell", "home", "unit", F.explode(pairs).alias("p"))
                    .select("label", "rep", "n", "cell", "home", "unit", "p.*")
                    .groupBy("label", "cell", "ghosts", "i", "j")
                    .applyInArrow(_compared(centroids, reach, threshold), "rep long, links long, root long"), "vector_links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "root"), "rep", "root")
    named = (classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
             .select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "rep").alias("component_id")))
    linked = linking.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~usable() | F.col("label").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
