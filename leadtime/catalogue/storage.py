"""Stages, text sources and globs: given tables written to shared storage and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import query, table
from leadtime.functions.clock import epoch_seconds
from leadtime.session import query_root
from leadtime.sources.stages import read_stage, restage, stage_once, stage_path, write_stage
from leadtime.sources.tables import delimited_lookup, scan_csv, scan_parquet


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders", name="stage_roundtrip")
def stage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    root = query_root(spark)
    write_stage(orders, root, "orders", "original")
    return read_stage(spark, root, "orders", "original").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey", name="stage_once")
def stage_computed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over some customers; again, which finds the stage; and once the others have arrived, which computes anew."""
    root = query_root(spark)
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    arrived = stage_path(root, "customers", "arrived")
    customers.where("c_custkey % 3 = 0").write.parquet(arrived)

    def counts(compute: bool) -> DataFrame:
        rows = scan_parquet(spark, arrived, schema=customers.schema)

        def count() -> DataFrame:
            if not compute:
                raise AssertionError("computed twice")
            return rows.groupBy("c_nationkey").agg(F.count("*").alias("n"))

        return stage_once(spark, root, "customers", "counts", count, parameters={"by": "nation"}, inputs=[rows])

    counts(True)
    counts(False)
    customers.where("c_custkey % 3 <> 0").write.mode("append").parquet(arrived)
    return counts(True)


@query(
    """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, epoch_us(o_orderdate) // 1000000 AS t FROM orders
WHERE epoch_us(o_orderdate) // 1000000 > (SELECT min(epoch_us(o_orderdate) // 1000000) + floor((max(epoch_us(o_orderdate) // 1000000) - min(epoch_us(o_orderdate) // 1000000)) * 0.9) FROM orders)"""
)
def clustered_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of time of a stage laid out by time: the cut is a range filter that skips the other files' rows."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", epoch_seconds(F.col("o_orderdate")).alias("t"))
    staged = restage(orders, query_root(spark), "orders", "by_time", cluster_by="t")
    cut = staged.agg(F.min("t") + F.floor((F.max("t") - F.min("t")) * F.lit(0.9))).scalar()
    return staged.where(F.col("t") > cut)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier", name="csv_scan")
def compressed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(query_root(spark), "supplier", "csv")
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    suppliers.write.option("header", True).option("compression", "gzip").csv(path)
    return scan_csv(spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int")


@query(
    """
SELECT CAST(max(c_custkey) AS VARCHAR) AS last_key, c_mktsegment FROM customer GROUP BY c_mktsegment""",
    name="delimited_repeats",
)
def delimited_repeated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ``key:segment`` lines in order of their keys: a segment occurs often, its last line counts.

    Ranges of keys become files whose names are in the same order, which is the order of lines for the lookup.
    """
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    path = stage_path(query_root(spark), "customer", "segments")
    lines = customers.select(F.concat_ws(":", F.col("c_custkey").cast("string"), "c_mktsegment", F.lit("rest")).alias("value"), "c_custkey")
    lines.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(path)
    return delimited_lookup(spark, path, value="last_key", key="c_mktsegment")


@query("SELECT c_custkey, c_name FROM (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer)", name="delimited_lookup")
def delimited_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ``name:key:segment:…`` lines; some are written a second time with key N/A."""
    customers = table(spark, sf_dir, "customer")
    path = stage_path(query_root(spark), "customer", "text")
    key = F.col("c_custkey").cast("string")
    lines = customers.select(
        F.explode(F.array(key, F.lit("N/A"))).alias("key"), "c_name", "c_mktsegment"
    ).select(F.concat_ws(":", "c_name", "key", "c_mktsegment", F.lit("rest")).alias("value"))
    lines.write.text(path)
    return delimited_lookup(spark, path, value="c_name", key="c_custkey")


@query(
    """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem"""
)
def glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to one folder per return flag and read back through a glob over all of them."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = stage_path(query_root(spark), "lineitem", "parts")
    lines.write.partitionBy("l_returnflag").parquet(path)
    return scan_parquet(
        spark, f"{path}/l_returnflag=*", columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    )
