"""Levels of a category: how often each occurs, and folding the rare ones into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.operators.lookup import sized
from leadtime.session import cut_lineage


def level_frequency(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """Rows per level; the null level counts 0."""
    return df.groupBy(column).agg(F.count(column).alias(count))


def approximate_quantile(df: DataFrame, column: str, probability: float, accuracy: int = 10_000) -> DataFrame:
    """One row: a value whose rank is within 1/``accuracy`` of ``probability``."""
    return df.agg(F.percentile_approx(column, probability, accuracy).alias("quantile"))


def fold_rare_levels(df: DataFrame, column: str, into: str, rare: str, probability: float = 0.8) -> DataFrame:
    """Add ``into``: the level, or ``rare`` if its frequency is at or below a quantile of all frequencies.

    The quantile is taken over levels, not rows, so at least that share of the levels is folded.
    Null stays null. The frequencies are counted in one pass and written once; rows are then
    matched against the levels kept, the smaller part, with a broadcast only if a count allows it.
    """
    frequency = cut_lineage(level_frequency(df, column, "__n"))
    cutoff = approximate_quantile(frequency, "__n", probability).scalar()
    kept = frequency.where(F.col("__n") > cutoff).select(F.col(column).alias("__level"))
    joined = df.join(sized(kept), F.col(column) == F.col("__level"), "left")
    folded = F.when(F.col(column).isNull() | F.col("__level").isNotNull(), F.col(column)).otherwise(F.lit(rare))
    return joined.withColumn(into, folded).drop("__level")
