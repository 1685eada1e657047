"""Typed selection and renaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadtime.functions.casts import fitting


def observed_losses(df: DataFrame, values: Mapping[str, tuple[Column, Column]], losses: Observation) -> DataFrame:
    """``df`` as it is; whoever runs it learns from ``losses`` how many values became null, by name of ``values`` (before, after).

    The counts are gathered in the pass that makes the values, and are there (``losses.get``) once it has ended. A part of the
    plan that runs twice, such as the sample before a range partitioning, is counted twice: write the rows first.
    """
    return df.observe(losses, *[F.count_if(before.isNotNull() & after.isNull()).alias(name) for name, (before, after) in values.items()])


def loss_table(spark: SparkSession, losses: Observation) -> DataFrame:
    """(column, lost): one row per column that was observed."""
    return spark.createDataFrame(sorted((c, int(n)) for c, n in losses.get.items()), "column string, lost long")


def typed_select(df: DataFrame, types: Mapping[str, str], losses: Observation | None = None) -> DataFrame:
    """The columns named in ``types``, cast, in the order of ``df``.

    A value that does not fit its type becomes null, and is counted by column in ``losses``, if given; a column that is
    missing is an error.
    """
    missing = [name for name in types if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    cast = {c: fitting(F.col(c), t, types[c]) for c, t in df.dtypes if c in types}
    if losses is not None:
        df = observed_losses(df, {c: (F.col(c), value) for c, value in cast.items()}, losses)
    return df.select(*[value.alias(c) for c, value in cast.items()])


def feature_columns(
    df: DataFrame,
    categoricals: Sequence[str],
    numericals: Sequence[str],
    carried: Sequence[str] = (),
    outcome: str | None = None,
) -> DataFrame:
    """Model inputs in a fixed order, then columns carried along, then the outcome."""
    return df.select(*categoricals, *numericals, *carried, *([outcome] if outcome else []))


def renamed(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename and drop columns in one projection."""
    return df.withColumnsRenamed(dict(names)).drop(*drop)
