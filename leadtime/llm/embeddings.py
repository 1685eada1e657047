"""Near-duplicate vectors by counting collisions of sorted one-dimensional projections."""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.llm.common import in_blocks, written
from leadtime.llm.components import connected_components, least_tied
from leadtime.session import cut_lineage

#: Vectors that a cell should hold on average, and that a task compares with as many others at a time.
CELL = 128
BLOCK = 512
PROJECTIONS = 24
#: Half width of the window around a query in a projection of unit vectors on a normal direction.
WINDOW = 1.0


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """``n`` normal directions, the same for any task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision and without overflow on the way."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def least_count(cosine: float, n: int = PROJECTIONS, recall: float = 0.999) -> int:
    """The largest number of ``n`` windows that a pair of this cosine meets in with probability ``recall``.

    The difference of the projections is normal with variance 2 - 2 cos.
    """
    p = erf(WINDOW / sqrt(2 - 2 * cosine) / sqrt(2)) if cosine < 1 else 1.0
    tail = 0.0
    for count in range(n, -1, -1):
        tail += comb(n, count) * p**count * (1 - p) ** (n - count)
        if tail >= recall:
            return count
    return 0


def cells_needed(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a cell, so that ``n`` vectors make cells of ``CELL``, and how many groupings reach ``recall``.

    A pair of this cosine falls on the same side of a plane with probability 1 - angle / pi.
    """
    bits = max(0, ceil(log2(max(n, 1) / CELL)))
    together = (1 - acos(cosine) / pi) ** bits
    return bits, 1 if together >= recall else ceil(log(1 - recall) / log(1 - together))


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many projections (columns) each right value lies in the window around each left one.

    A projection of the right side is sorted once; a window is then a stretch of it.
    """
    counts = np.zeros((len(left), len(right)), np.int8)
    rows = np.arange(len(left))
    for a, b in zip(left.T, right.T):
        order = np.argsort(b)
        ends = np.zeros((len(left), len(right) + 1), np.int8)
        ends[rows, np.searchsorted(b[order], a - WINDOW, side="left")] += 1
        ends[rows, np.searchsorted(b[order], a + WINDOW, side="right")] -= 1
        counts[:, order] += np.cumsum(ends[:, :-1], axis=1, dtype=np.int8)
    return counts


def _valid(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _links(nodes: DataFrame, cosine: float, recall: float, seed: int) -> DataFrame:
    """``node``, ``links`` and ``root`` from every block of cells: partners by number, and the least one tied to.

    A pair may share several cells; it counts in the first only, which the codes of both tell.
    """
    bits, groupings = cells_needed(nodes.count(), cosine, recall)
    needed = least_count(cosine)

    def coded(batches):
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            codes = np.zeros((batch.num_rows, groupings), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = unit(np.array(batch.column(1).take(pa.array(rows)).flatten()).reshape(len(rows), dim))
                sides = (x @ directions(int(dim), bits * groupings, seed) > 0).reshape(len(rows), groupings, bits)
                codes[rows] = sides @ (1 << np.arange(bits, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, groupings), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["node", "embedding", "n", "codes"])

    element = nodes.schema["embedding"].dataType.simpleString()
    kind = nodes.schema["node"].dataType.simpleString()
    rows = nodes.select("node", "embedding", "n").mapInArrow(coded, f"node {kind}, embedding {element}, n long, codes array<bigint>")
    placed = rows.select("*", F.size("embedding").alias("dim"), F.posexplode("codes").alias("grouping", "cell"))
    cell = ["dim", "grouping", "cell"]
    paired = in_blocks(placed, cell, ["node", "codes"], BLOCK)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        at, dim = table["grouping"][0].as_py(), table["dim"][0].as_py()
        x = unit(np.array(table["embedding"].combine_chunks().flatten()).reshape(-1, dim))
        codes = np.array(table["codes"].combine_chunks().flatten()).reshape(len(x), -1)
        own, weight = table["own"].to_numpy(), table["n"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        projected = x @ directions(dim, PROJECTIONS, seed + 1)
        a, b = np.nonzero(collisions(projected[left], projected[right]) >= needed)
        a, b = left[a], right[b]
        if low == high:
            a, b = a[a < b], b[a < b]
        near = np.concatenate([(x[a[i : i + 65536]] * x[b[i : i + 65536]]).sum(1) >= cosine for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[near], b[near]
        new = np.concatenate([(codes[a[i : i + 65536]] == codes[b[i : i + 65536]]).argmax(1) == at for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[new], b[new]
        links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
        root = least_tied(len(x), a, b)
        tied = np.flatnonzero(links)
        nodes = table["node"].combine_chunks()
        return pa.table({"node": nodes.take(pa.array(tied)), "links": pa.array(links[tied].astype(np.int64)), "root": nodes.take(pa.array(root[tied]))})

    return paired.groupBy(*cell, "low", "high").applyInArrow(compare, f"node {kind}, links long, root {kind}")


def near_vectors(vectors: DataFrame, *, cosine: float = 0.9, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors`` (``vec_id``, ``embedding``).

    Vectors are cut into cells by the signs of projections, in as many groupings as find a pair at
    ``cosine`` with probability ``recall``; cells shrink as the table grows. In a cell every vector
    opens a window around itself in each of ``PROJECTIONS`` sorted projections; a pair that meets in
    as many windows as pairs at ``cosine`` do (``least_count``) is verified by its cosine in double
    precision. Cells above ``BLOCK`` vectors are compared block by block. Links are counted and tied
    where they are found, never listed.

    Equal vectors are folded into one with a number before all that, and linked to each other. Null
    vectors, those with a null or non-finite component, zero vectors and rows without a vec_id link
    with nothing; vectors of different lengths neither. Rows that repeat a vec_id with another
    vector count as one vector with the links of both. ``component_id`` is the smallest vec_id that
    links reach; ``kept`` marks it, and is false without a vec_id. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding").withColumn("valid", _valid("embedding") & F.col("vec_id").isNotNull())
    nodes = written(rows.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    found = cut_lineage(_links(nodes, cosine, recall, seed))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    same = rows.where("valid").select("vec_id", "embedding").join(nodes.withColumnRenamed("n", "equal"), "embedding").select("vec_id", "node", "equal")
    tied = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    repeated = same.where(F.col("vec_id") != F.col("node")).select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    twice = repeated.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b < c")
    roots = connected_components(tied.union(twice.select("a", "b")).union(twice.select("a", "c")))
    linked = (
        same.join(links, "node", "left")
        .join(roots.withColumnRenamed("node", "__at"), F.col("node") == F.col("__at"), "left")
        .select("vec_id", (F.col("equal") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    )
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
