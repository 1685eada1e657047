"""Table scans. Every reader takes a schema or a column list; none infers types from rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_parquet(
    spark: SparkSession,
    *paths: str,
    columns: Sequence[str] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Files, folders or globs as one table, reduced to ``columns``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(*paths)
    return table.select(*columns) if columns else table


def scan_csv(spark: SparkSession, *paths: str, schema: StructType | str) -> DataFrame:
    """CSV with a header line, plain or compressed."""
    return spark.read.schema(schema).option("header", True).csv(list(paths))


def delimited_lookup(
    spark: SparkSession,
    path: str,
    *,
    value: str,
    key: str,
    separator: str = ":",
    missing: str = "N/A",
) -> DataFrame:
    """The first two fields of each line, value first, as a key → value table.

    Lines whose key is ``missing`` are left out, and of several lines for one key the last counts.
    """
    fields = F.split("value", re.escape(separator), 3)
    lines = spark.read.text(path).select(
        F.get(fields, F.lit(1)).alias(key),
        F.get(fields, F.lit(0)).alias("__value"),
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id(),
        ).alias("__line"),
    )
    return (
        lines.where(F.col(key).isNotNull() & (F.col(key) != missing))
        .groupBy(key)
        .agg(F.max_by("__value", "__line").alias(value))
    )
