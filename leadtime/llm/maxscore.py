"""Exact top-k by inner product with MaxScore over dimensions as terms."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtime.llm.common import written

#: Candidates of a shard, shards a task searches in turn, and queries of a block, on average.
SHARD_ROWS = 2048
SLAB_SHARDS = 4
BLOCK_ROWS = 1024
#: Ends of 64-bit whole numbers.
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
#: Terms that are probed between two looks at the threshold.
PROBED = 8


def whole_numbers(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down; those beyond 64 bits become the nearest 64-bit number."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _valid(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Shard:
    """Candidates of a shard as postings: a term is a dimension with a sign, its list the parts of that sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        by_dimension = np.ascontiguousarray(vectors.T)
        self.plus = np.maximum(by_dimension, 0)
        self.minus = np.maximum(-by_dimension, 0)
        self.plus_most = self.plus.max(axis=1)
        self.minus_most = self.minus.max(axis=1)

    def search(self, query: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of candidates, among them all that score ``least`` or more (all, if that is None).

        Only the lists whose sign is that of the query's component add to a score, at most the
        component times the greatest entry. Lists in ascending order of that bound are non-essential as long as
        their bounds together stay below ``least``: whoever is in no other list cannot reach it. The essential lists
        are traversed; for those met, what the signs take away is subtracted, then the
        non-essential lists are probed, greatest bound first, for candidates that can still reach ``least``.
        """
        weight = np.abs(query)
        up = query > 0
        bounds = weight * np.where(up, self.plus_most, self.minus_most)
        order = np.argsort(bounds, kind="stable")
        total = np.cumsum(bounds[order])
        none = least is None or least <= 0
        slack = 0 if none else int(np.searchsorted(total, least, side="left"))
        essential, others = order[slack:], order[:slack][::-1]
        score = np.zeros(len(self.ids), query.dtype)
        for lists, sign in ((self.plus, up), (self.minus, ~up)):
            terms = essential[sign[essential]]
            score += weight[terms] @ lists[terms]
        met = np.arange(len(self.ids)) if none else np.flatnonzero(score > 0)
        score = score[met]
        left = bounds[others].sum()
        if not none:
            near = score + left >= least
            met, score = met[near], score[near]
        for lists, sign in ((self.plus, ~up), (self.minus, up)):
            terms = np.flatnonzero(sign & (query != 0))
            if len(met):
                score = score - weight[terms] @ lists[np.ix_(terms, met)]
        for first in range(0, len(others), PROBED):
            near = score + left >= least
            met, score = met[near], score[near]
            if not len(met):
                break
            chosen = others[first : first + PROBED]
            for lists, sign in ((self.plus, up), (self.minus, ~up)):
                terms = chosen[sign[chosen]]
                score = score + weight[terms] @ lists[np.ix_(terms, met)]
            left = left - bounds[chosen].sum()
        return met, score


def search_shards(query_ids: np.ndarray, queries: np.ndarray, shards: list[Shard], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the ``k`` best over some shards; a query's own id is no candidate."""
    found: tuple[list, list, list] = ([], [], [])
    for query_id, query in zip(query_ids, queries):
        ids, scores = np.zeros(0, query_ids.dtype), np.zeros(0, queries.dtype)
        for shard in shards:
            met, score = shard.search(query, scores[-1] if len(scores) == k else None)
            if score.dtype == object:
                score = np.minimum(np.maximum(score, LEAST), GREATEST)
            other = shard.ids[met] != query_id
            ids, scores = np.append(ids, shard.ids[met[other]]), np.append(scores, score[other])
            if len(scores) > 4 * k:
                near = scores >= np.partition(scores, -k)[-k]
                ids, scores = ids[near], scores[near]
            by_id = np.argsort(ids, kind="stable")
            best = by_id[np.argsort(-scores[by_id], kind="stable")][:k]
            ids, scores = ids[best], scores[best]
        for column, values in zip(found, ([query_id] * len(ids), ids, scores)):
            column.extend(values)
    return tuple(np.array(c) for c in found)


def _packed(rows: DataFrame, into: str, n: int) -> DataFrame:
    """Rows dealt by hash into ``n`` parts, a part one row of ids and components in turn."""
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    grouped = rows.groupBy(F.size("vector").alias("dim"), part.alias(into)).agg(F.collect_list(F.struct("vec_id", "vector")).alias("rows"))
    return grouped.select("dim", into, F.col("rows.vec_id").alias("ids"), F.flatten("rows.vector").alias("parts"))


def _matrix(table: pa.Table, row: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    ids = table["ids"].chunk(0)[row].values.to_numpy(zero_copy_only=False)
    parts = table["parts"].chunk(0)[row].values.to_numpy(zero_copy_only=False)
    return ids, parts.astype(object if wide else np.int64).reshape(len(ids), -1)


def top_inner_products(vectors: DataFrame, queries: Column, *, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` greatest inner products of each query with all other ``vectors`` (``vec_id``, ``embedding``).

    ``queries`` is true for rows that ask; ``scale`` makes components whole numbers (``whole_numbers``).
    Scores are exact, ties go to the smaller vec_id. MaxScore: a dimension with a sign is a term, a
    shard of the candidates keeps its lists, and each query splits them by their bounds into essential
    ones, which are traversed, and others, which are probed while a candidate can still reach the
    ``k``-th best score so far (``Shard.search``). Blocks of queries meet slabs of shards, each pair in a task of
    bounded size; a slab's shards are searched in turn so that the threshold rises. The best of
    all slabs are merged by one window. The number of pairs is that of queries times candidates
    over a constant, as exact search over unbounded queries takes.

    Vectors that are null or hold null or non-finite components take no part, nor rows without a
    vec_id. Equal rows count once; rows of one vec_id with different vectors are rows of their own, and are
    no candidates of each other. Only vectors of one length meet; empty ones score 0. Scores
    beyond 64 bits are computed in full and cut to the nearest 64-bit number, by which they rank. Other columns are ignored.
    Workers that lack this package need ``common.ship`` first, as the queries call it.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    whole = written(rows.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct())
    size = whole.agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).first()
    shards = max(1, ceil(size["n"] / SHARD_ROWS))
    blocks = max(1, ceil(size["asking"] / BLOCK_ROWS))
    slabs = ceil(shards / SLAB_SHARDS)
    asked = _packed(whole.where("asks"), "block", blocks).withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    dealt = _packed(whole, "shard", shards).withColumn("slab", F.expr(f"shard div {SLAB_SHARDS}").cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    limit = 1 << 62

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table({n: pa.array([], left["ids"].type.value_type if n != "score" else pa.int64()) for n in names})
        if not left.num_rows or not right.num_rows:
            return empty
        left, right = left.combine_chunks(), right.combine_chunks()
        dim = left["dim"][0].as_py()
        greatest = [max((abs(int(x)) for t in [table["parts"].chunk(0).flatten()] if len(t) for x in _ends(t)), default=0) for table in (left, right)]
        wide = greatest[0] * greatest[1] * max(dim, 1) >= limit
        ids, asking = _matrix(left, 0, wide)
        held = [Shard(*_matrix(right, i, wide)) for i in range(right.num_rows)] if dim else []
        if dim:
            found = search_shards(ids, asking, held, k)
        else:
            others = np.concatenate([_matrix(right, i, wide)[0] for i in range(right.num_rows)])
            others.sort()
            rows = [(q, c, 0) for q in ids for c in others[: k + 1 + int((others == q).sum())] if c != q]
            found = tuple(np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, ids.dtype),) * 3
        if not len(found[0]):
            return empty
        scores = [int(s) for s in found[2]]
        kind = left["ids"].type.value_type
        return pa.table({"query_id": pa.array(found[0], kind), "vec_id": pa.array(found[1], kind), "score": pa.array(scores, pa.int64())})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    key = ["dim", "block", "slab"]
    found = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ends(values: pa.Array) -> tuple[int, int]:
    ends = pa.compute.min_max(values).as_py()
    return ends["min"], ends["max"]


#: The same search in SQL over ``embeddings``.
SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5
"""
