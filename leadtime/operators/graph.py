"""Flows between places as a weighted graph, and the rank of each place in it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.operators.cleaning import require
from leadtime.session import cut_lineage, query_root

#: Links that leave one place and lie together; a place with more is cut into slices.
HUB_LINKS = 1_000_000


def flow_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, weight): each pair once, with the number of rows that go that way."""
    return (
        require(df.select(F.col(src).alias("src"), F.col(dst).alias("dst")), ["src", "dst"])
        .groupBy("src", "dst")
        .agg(F.count("*").alias("weight"))
    )


def flow_vertices(df: DataFrame, src: str) -> DataFrame:
    """(id): every place something departs from."""
    return require(df.select(F.col(src).alias("id")), ["id"]).distinct()


@contextmanager
def bucketed(df: DataFrame, keys: list[str]) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, bucketed by ``keys`` the way a shuffle would deal it.

    Joins and groupings by these keys read the buckets where they lie. The table is dropped after the ``with`` block, its
    files when the application ends.
    """
    spark = df.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"leadtime_{uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").option("path", f"{query_root(spark)}/table").bucketBy(buckets, *keys).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def arriving(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(dst, gain): what each place gets in one round, from ``links`` (src, slice, dst, share) and ``ranks`` (id, slices, rank).

    A rank goes to every slice of its place's links, so the links themselves do not move.
    """
    sent = ranks.select("id", "rank", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("__slice"))
    same = (F.col("src") == F.col("id")) & (F.col("slice") == F.col("__slice"))
    return links.join(sent, same).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))


def pagerank(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    *,
    reset: float = 0.15,
    iterations: int = 10,
    write_every: int = 5,
    hub_links: int = HUB_LINKS,
) -> DataFrame:
    """(id, pagerank) after a fixed number of rounds from rank 1; ranks sum to the number of vertices.

    Vertices are those that are a source, if none are given; edges to or from other places do not
    count. Links and vertices are written once, in buckets by the place they start from, so a round moves ranks and what
    they sum to, no links. The links of a hub are cut into slices of about ``hub_links``, which lie apart, and its rank goes to
    each. Ranks are written every few rounds, so that a lost executor costs only those.
    """
    edges = cut_lineage(edges)
    vertices = cut_lineage((vertices if vertices is not None else edges.select(F.col("src").alias("id"))).distinct())
    inside = edges.join(vertices, F.col("src") == F.col("id"), "left_semi").join(
        vertices, F.col("dst") == F.col("id"), "left_semi"
    )
    departures = cut_lineage(
        inside.groupBy(F.col("src").alias("__src")).agg(
            F.sum("weight").alias("__out"), F.ceil(F.count("*") / F.lit(hub_links)).cast("int").alias("__slices")
        )
    )
    links = inside.join(departures, F.col("src") == F.col("__src")).select(
        "src", F.pmod(F.hash("dst"), F.col("__slices")).alias("slice"), "dst", (F.col("weight") / F.col("__out")).alias("share")
    )
    places = vertices.join(departures, F.col("id") == F.col("__src"), "left").select("id", F.coalesce("__slices", F.lit(1)).alias("slices"))
    with bucketed(links, ["src", "slice"]) as links, bucketed(places, ["id"]) as places:
        ranks = places.withColumn("rank", F.lit(1.0))
        for done in range(1, iterations + 1):
            gains = arriving(links, ranks)
            ranks = places.join(gains, F.col("id") == F.col("dst"), "left").select(
                "id", "slices", (reset + (1 - reset) * F.coalesce("gain", F.lit(0.0))).alias("rank")
            )
            if done % write_every == 0:
                ranks = cut_lineage(ranks)
        ranks = cut_lineage(ranks)
    scale = ranks.agg(F.count("*") / F.sum("rank")).scalar()
    return ranks.select("id", (F.col("rank") * scale).alias("pagerank"))
