"""Class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of all rows per class; the total is summed over the classes, not read again."""
    everything = Window.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything))


def with_copies(df: DataFrame, label: str, minority=1, majority=0, *, only: Column | None = None, copies: str = "__copies") -> DataFrame:
    """Add how often ``oversample_minority`` repeats each row: a weight, or a number for ``repeated``. Rows of neither class are left out."""
    chosen = F.lit(True) if only is None else only
    sizes = df.agg(
        F.struct(
            F.count_if(chosen & (F.col(label) == majority)).alias("major"), F.count_if(chosen & (F.col(label) == minority)).alias("minor")
        )
    ).scalar()
    ratio = F.floor(F.try_divide(sizes["major"], sizes["minor"]))
    times = F.when(chosen & (F.col(label) == minority), F.greatest(F.coalesce(ratio, F.lit(1)), F.lit(1))).otherwise(1)
    return df.where(F.col(label).isin(majority, minority)).withColumn(copies, times)


def repeated(df: DataFrame, copies: str = "__copies") -> DataFrame:
    """Every row as often as its ``copies`` says, without that column."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).drop("__copy", copies)


def oversample_minority(df: DataFrame, label: str, minority=1, majority=0, *, only: Column | None = None) -> DataFrame:
    """Repeat minority rows until the classes are about even, in one pass and without a shuffle.

    Each is repeated floor(majority / minority) times, but never lost; without minority rows
    nothing changes. Rows of neither class are left out. With ``only``, rows for which it does not hold
    neither count nor are repeated.
    """
    return repeated(with_copies(df, label, minority, majority, only=only))


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__copy")
