"""Joins against small tables: codes, offsets, ranks, key lists, time bounds.

No side is broadcast on trust. Tables read from files are left to Spark, which knows their size;
derived tables pass through ``sized``, which counts first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.functions.casts import text_to_int
from leadtime.functions.clock import HOUR

BROADCAST_ROWS = 200_000
#: A key with this share of the rows is heavy: more than one task of a wide shuffle should hold.
HEAVY_SHARE = 0.01


def sized(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow derived table for broadcast if a count shows it is small.

    A larger one stays as it is and is joined by shuffle.
    """
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side


def looked_up(
    df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, columns: Mapping[str, str], how: str = "left"
) -> DataFrame:
    """Add dimension columns (``{dimension column: new name}``) for the row's key.

    ``dimension_key`` must be unique in ``dimension``. A key without entry gives nulls, or drops
    the row with ``how="inner"``.
    """
    entries = dimension.select(
        F.col(dimension_key).alias("__key"), *[F.col(c).alias(name) for c, name in columns.items()]
    )
    return df.join(entries, F.col(key) == F.col("__key"), how).drop("__key")


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, tracked: int = 4096) -> list:
    """Keys that may hold at least ``share`` of the rows, by a sketch of ``tracked`` counters a task.

    Frequent items are never missed: counts of the sketch are at most too low by rows / counters. At most
    about ``1 / share`` keys come to the driver.
    """
    counted = df.where(F.col(key).isNotNull()).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {ceil(2 / share)}, {tracked})").alias("top")
    ).first()
    least = counted["n"] * (share - 2 / tracked)
    return [item["item"] for item in counted["top"] or [] if item["count"] >= least]


def spread_lookup(
    df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, columns: Mapping[str, str], how: str = "left", *, share: float = HEAVY_SHARE
) -> DataFrame:
    """``looked_up`` in a large dimension by a key that may be the same in a third of the rows.

    The heaviest keys of ``df`` are found by a sketch. Their entries, a bounded few, are broadcast and their
    rows never move; all other rows meet the dimension by shuffle, in which no key is heavy any more. Rows
    without a key go with the heavy ones. ``df`` is read for the sketch and once for either part.
    """
    entries = dimension.select(F.col(dimension_key).alias("__key"), *[F.col(c).alias(name) for c, name in columns.items()])
    same = F.col(key) == F.col("__key")
    heavy = heavy_keys(df, key, share)
    if not heavy:
        known = df.where(F.col(key).isNotNull()).join(entries, same, how)
        few = df.where(F.col(key).isNull()).join(F.broadcast(entries.limit(0)), same, how)
        return known.union(few).drop("__key")
    is_heavy = F.col(key).isin(heavy)
    few = df.where(is_heavy | F.col(key).isNull()).join(F.broadcast(entries.where(F.col("__key").isin(heavy))), same, how)
    return df.where(~is_heavy).join(entries.where(~F.col("__key").isin(heavy)), same, how).union(few).drop("__key")


def rank_features(
    df: DataFrame,
    ranks: DataFrame,
    columns: Mapping[str, str],
    *,
    id: str = "id",
    rank: str = "pagerank",
    how: str = "inner",
) -> DataFrame:
    """Add the rank of each key column in ``columns`` (``{key column: new name}``).

    With ``how="inner"`` a row stays only if all its keys are ranked. Small ranks are broadcast once
    counted, so that wide rows are not shuffled onto a few hot keys.
    """
    ranks = sized(ranks)
    for key, name in columns.items():
        df = looked_up(df, key, ranks, id, {rank: name}, how)
    return df


def keep_known(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``known``; one row stays one row.

    The known keys are made distinct before they are moved, so a hot one costs one row.
    """
    keys = known.select(F.col(known_key).alias("__key")).distinct()
    return df.join(keys, F.col(key) == F.col("__key"), "left_semi")


def keys_in_use(lookup: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Lookup entries whose key occurs in ``table``, however large and skewed that is."""
    return keep_known(lookup, key, table, table_key)


def within_bounds(df: DataFrame, time: str, other: DataFrame, other_time: str, before: int = 4 * HOUR) -> DataFrame:
    """Rows from ``before`` seconds ahead of the first to the last moment of ``other``.

    The bounds stay in the plan as scalar subqueries: one aggregate over ``other``, nothing joined.
    """
    first = other.agg(F.min(other_time) - before).scalar()
    last = other.agg(F.max(other_time)).scalar()
    return df.where(F.col(time).between(first, last))


def station_zones(
    stations: DataFrame,
    calls: DataFrame,
    zones: DataFrame,
    min_date: int,
    *,
    call: str = "call",
    columns: Sequence[str] = ("zone",),
) -> DataFrame:
    """One row per usable station with the zone columns given for it in ``zones`` (key: station).

    A station is ``usaf`` followed by ``wban``. It is usable if its call sign occurs in ``calls``,
    it has a position other than 0, and it still reported on ``min_date`` (``yyyymmdd``).
    """
    lat, lon = (F.col(c).try_cast("double") for c in ("lat", "lon"))
    usable = stations.select(F.concat("usaf", "wban").alias("station"), call, "lat", "lon", "end").where(
        (lat != 0) & (lon != 0) & (text_to_int(F.col("end")) >= min_date)
    )
    in_use = keys_in_use(usable, call, calls, call).groupBy("station").agg(F.min(call).alias(call))
    return looked_up(in_use, "station", zones, "station", {c: c for c in columns})
