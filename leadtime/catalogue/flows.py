"""Ranks of nations by the goods that flow from customers' to suppliers' nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import query, table
from leadtime.operators.graph import flow_edges, flow_vertices, pagerank
from leadtime.operators.lookup import looked_up, rank_features

_LINES_SQL = """
lines AS (SELECT l_orderkey, l_linenumber, l_quantity, c_nationkey AS src, s_nationkey AS dst
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN supplier ON l_suppkey = s_suppkey),
edges AS (SELECT src, dst, count(*) AS weight FROM lines GROUP BY src, dst),
vertices AS (SELECT DISTINCT src AS id FROM edges),
links AS (SELECT e.src, e.dst, weight / sum(weight) OVER (PARTITION BY e.src) AS share
          FROM edges e WHERE e.dst IN (SELECT id FROM vertices)),
r0 AS (SELECT id, CAST(1 AS DOUBLE) AS rank FROM vertices)"""


def _rank_sql(rounds: int = 10) -> str:
    steps = [
        f"""r{i} AS (SELECT v.id, 0.15 + 0.85 * coalesce(g.gain, 0) AS rank FROM vertices v LEFT JOIN
  (SELECT dst, sum(rank * share) AS gain FROM links JOIN r{i - 1} ON src = id GROUP BY dst) g ON v.id = g.dst)"""
        for i in range(1, rounds + 1)
    ]
    final = f"""ranks AS (SELECT id, rank * (SELECT count(*) / sum(rank) FROM r{rounds}) AS pagerank FROM r{rounds})"""
    return "WITH " + ",\n".join([_LINES_SQL, *steps, final])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    suppliers, customers = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    bought = looked_up(lines, "l_orderkey", orders, "o_orderkey", {"o_custkey": "o_custkey"}, "inner")
    placed = looked_up(bought, "o_custkey", customers, "c_custkey", {"c_nationkey": "src"}, "inner")
    return looked_up(placed, "l_suppkey", suppliers, "s_suppkey", {"s_nationkey": "dst"}, "inner").select(
        "l_orderkey", "l_linenumber", "l_quantity", "src", "dst"
    )


@query(f"WITH {_LINES_SQL} SELECT src, dst, weight FROM edges", name="flow_edges")
def flow_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_edges(_lines(spark, sf_dir), "src", "dst")


@query(f"WITH {_LINES_SQL} SELECT id FROM vertices", name="flow_vertices")
def flow_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_vertices(_lines(spark, sf_dir), "src")


@query(f"{_rank_sql()} SELECT id, round(pagerank, 9) AS pagerank FROM ranks")
def flow_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = pagerank(flow_edges(_lines(spark, sf_dir), "src", "dst"))
    return ranks.withColumn("pagerank", F.round("pagerank", 9))


@query(
    f"""{_rank_sql()}
SELECT l_orderkey, l_linenumber, l_quantity, src, dst, round(a.pagerank, 9) AS origin_rank,
       round(b.pagerank, 9) AS destination_rank
FROM lines JOIN ranks a ON src = a.id JOIN ranks b ON dst = b.id""",
    name="rank_features",
)
def line_rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    ranks = pagerank(flow_edges(lines, "src", "dst")).withColumn("pagerank", F.round("pagerank", 9))
    return rank_features(lines, ranks, {"src": "origin_rank", "dst": "destination_rank"})
