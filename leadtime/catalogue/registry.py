"""Where queries register, and the views of the given tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.functions.clock import epoch_seconds
from leadtime.sources.tables import scan_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under ``name`` or its own name, with its SQL twin if it has one."""

    def register(function: Query) -> Query:
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLE[name or function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet", columns=columns or None)


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole epoch seconds ``t``, place ``k`` (users fall into ten) and ``label`` = error."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        (F.col("user_id") % 10).alias("k"),
        epoch_seconds(F.col("ts")).alias("t"),
        "event_type",
        "value",
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


# The same view for DuckDB.
EVENTS_SQL = """
  SELECT event_id, user_id, user_id % 10 AS k, epoch_us(ts) // 1000000 AS t, event_type, value,
         CAST(event_type = 'error' AS INTEGER) AS label
  FROM events"""


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a scored table: the value is the score, above 50 means predicted error."""
    return timed_events(spark, sf_dir).select(
        "event_id", F.col("value").alias("score"), "label", (F.col("value") > 50).cast("int").alias("prediction")
    )


SCORED_SQL = f"""
  SELECT event_id, value AS score, label, CAST(value > 50 AS INTEGER) AS prediction FROM ({EVENTS_SQL})"""
