"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.session import cut_lineage


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its smallest reachable node, for every node of the edges (``a``, ``b``).

    Alternating star rounds: every node hooks its larger neighbours, then its smaller ones, onto
    its smallest neighbour, until nothing changes. The number of edges never grows, a hub is a
    minimum and a join that Spark can split, and each round is written to the shared folder.
    Nodes without an edge to another node are not returned.
    """
    links = cut_lineage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _digest(links)
    while state[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links = cut_lineage(small)
        before, state = state, _digest(links)
        if state == before:
            break
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def least_tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` items of one block, the least item that the links ``a``-``b`` reach."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root
