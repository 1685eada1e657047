"""Profiles of a table: nulls, ranges, counts, rates, histograms, quartiles, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, MapType, StructType

from leadtime.operators.running import running_totals


def _long(row: DataFrame, column: str, value: str) -> DataFrame:
    """A one-row table turned into (column, value) rows."""
    return row.unpivot([], row.columns, column, value)


def _stacked(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One (column, value) row per value that is not null, in one pass over ``df``."""
    numbers = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.unpivot(list(keep), list(columns), "column", "value").where(F.col("value").isNotNull())


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of each column that has nulls."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long(counts, "column", "nulls").where(F.col("nulls") > 0)


def extent(df: DataFrame, column: str, rows: str | None = None) -> DataFrame:
    """One row: smallest and largest value, and in ``rows``, if named, how many rows there are."""
    counted = [F.count("*").alias(rows)] if rows else []
    return df.agg(*counted, F.min(column).alias("first"), F.max(column).alias("last"))


def _told_apart(df: DataFrame, column: str) -> Column:
    """A value as text that is equal for equal values only."""
    kind = df.schema[column].dataType
    if isinstance(kind, BinaryType):
        return F.hex(column)
    if isinstance(kind, (FloatType, DoubleType)):
        # Minus zero equals zero.
        return (F.col(column) + F.lit(0.0)).cast("string")
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.when(F.col(column).isNotNull(), F.to_json(F.struct(column)))
    return F.col(column).cast("string")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``at`` and ``value``: every distinct value of every column once, as text, by the column's place; nulls are none.

    A task keeps one entry per column and value it meets, whatever the number of rows, and only those are moved.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), _told_apart(df, c).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], buckets: int = 1024) -> DataFrame:
    """One row: exact number of distinct values of each column; nulls do not count.

    Values are counted by hash in ``buckets`` per column first, so a column's values are never one group of one task.
    """
    hashed = F.pmod(F.xxhash64("value"), F.lit(buckets))
    parts = distinct_values(df, columns).groupBy("at", hashed.alias("bucket")).agg(F.count("*").alias("n"))
    return parts.agg(*[F.coalesce(F.sum(F.when(F.col("at") == i, F.col("n"))), F.lit(0).cast("long")).alias(c) for i, c in enumerate(columns)])


def min_max_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column as text; text compares as text."""
    ends = df.agg(
        *[F.struct(F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max")).alias(c) for c in columns]
    )
    return _long(ends, "column", "ends").select("column", "ends.min", "ends.max")


def target_rate(df: DataFrame, category: str, target: str) -> DataFrame:
    """Mean of ``target`` per level with a normal 95 % interval."""
    half = 1.96 * F.col("__s") / F.sqrt("n")
    return (
        df.groupBy(category)
        .agg(F.count(target).alias("n"), F.avg(target).alias("rate"), F.stddev(target).alias("__s"))
        .select(category, "n", "rate", (F.col("rate") - half).alias("low"), (F.col("rate") + half).alias("high"))
    )


def target_counts(df: DataFrame, category: str, target: str) -> DataFrame:
    """Rows per level and target value."""
    return df.groupBy(category, target).agg(F.count("*").alias("n"))


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each column, empty ones included.

    The last bin is closed. A column with a single value gets a range of ±0.5 around it. A column without values gives no rows.

    One scan finds all ends. A second counts all bins of all columns, an array of counts per
    column and task, which are summed: no row is multiplied, and what is moved is bins times columns.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    places = [f"__{i}" for i in range(len(columns))]

    def ends_of(c: str) -> Column:
        lo, hi = F.min(c), F.max(c)
        half = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
        return F.struct((lo - half).alias("lo"), (hi + half).alias("hi")).alias(c)

    ends = numbers.agg(F.struct(*[ends_of(c) for c in places]).alias("ends"))
    held = ends.scalar()

    def counts_of(c: str) -> Column:
        lo, hi = held[c]["lo"], held[c]["hi"]
        bin_ = F.when(F.col(c).isNotNull(), F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)))
        return F.array(*[F.count_if(bin_ == b) for b in range(bins)]).alias(c)

    row = numbers.agg(*[counts_of(c) for c in places])
    each = [
        F.struct(F.lit(name).alias("column"), held[c]["lo"].alias("lo"), held[c]["hi"].alias("hi"), F.col(c).alias("counts"))
        for name, c in zip(columns, places)
    ]
    listed = row.select(F.inline(F.array(*each))).where(F.col("lo").isNotNull())
    width = (F.col("hi") - F.col("lo")) / bins
    return listed.select("column", "lo", width.alias("w"), F.posexplode("counts").alias("bin", "n")).select(
        "column",
        F.col("bin").cast("int").alias("bin"),
        (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"),
        "n",
    )


def five_numbers(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Smallest value, exact quartiles (interpolated) and largest value per column and group.

    Values are counted first, so repeated ones are one row; ranks come from running totals, so no
    task holds a whole group. Each quartile needs the values at two neighbouring ranks.
    """
    counted = _stacked(df, columns, [by]).groupBy("column", by, "value").agg(F.count("*").alias("n"))
    ranked = running_totals(counted, "value", ["n"], ["column", by])
    # A value covers the zero-based ranks from run_n - n to run_n - 1.
    first, last = F.col("run_n") - F.col("n"), F.col("run_n") - 1

    def at(rank):
        return F.max(F.when(rank.between(first, last), F.col("value")))

    def quartile(p: float):
        position = (F.col("total_n") - 1) * F.lit(p)
        low, high = at(F.floor(position)), at(F.ceil(position))
        fraction = F.max(position - F.floor(position))
        return low + (high - low) * fraction

    return ranked.groupBy("column", by).agg(
        F.min("value").alias("min"),
        quartile(0.25).alias("q1"),
        quartile(0.5).alias("median"),
        quartile(0.75).alias("q3"),
        F.max("value").alias("max"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, from the rows where both are present, in one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("left"),
                    F.lit(b).alias("right"),
                    F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr"),
                )
                for a, b in pairs
            ]
        ).alias("pairs")
    )
    return row.select(F.inline("pairs"))
