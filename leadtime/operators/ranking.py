"""Best row per group, best rows of all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group. ``order`` should leave no ties.

    Spark drops all but the first row per group and task before the shuffle, so a hot group
    reaches its final task as one row per earlier task.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def top(df: DataFrame, order: Sequence[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows; each task keeps only that many."""
    return df.orderBy(*order).limit(rows)
