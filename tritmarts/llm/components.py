"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tritmarts.llm.tables import written


def _linked_to_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of every node to the least node around it.

    ``edges`` are (hi, lo) with hi > lo.  ``both_ways`` looks at all neighbours
    (large star: the greater ones move), otherwise at the smaller ones only
    (small star: they and the node itself move).  A hub's neighbours are never
    gathered: its least neighbour is an aggregate with map-side combine, which
    a skew-splittable join brings back to the links.
    """
    if both_ways:
        ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
        moved = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(
            edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))).where("other > node")
        out = moved.join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
    else:
        least = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        moved = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        out = moved.join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).union(
            least.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
    return out.where("hi > lo").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` that has a link to another node; root is the least node reachable.

    ``links`` holds two comparable non-null columns; direction, repeats and
    self links do not matter.  Every round is written to the shared folder.  The
    rounds end when each node hangs on one root and no root hangs on a node;
    their number grows with the logarithm of the longest chain.
    """
    edges = written(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                    .where("hi > lo").distinct(), "links")
    while True:
        twice = edges.groupBy("hi").count().where("count > 1").select("hi")
        inner = edges.select(F.col("lo").alias("hi")).join(edges.select("hi"), "hi", "left_semi")
        if twice.union(inner).isEmpty():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        edges = written(_linked_to_least(written(_linked_to_least(edges, True), "links"), False), "links")


def block_components(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least place it is connected to."""
    n = len(near)
    labels = np.arange(n)
    while n:
        least = np.minimum(labels, np.where(near, labels[None, :], n).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == labels).all():
            break
        labels = least
    return labels
