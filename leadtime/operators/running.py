"""Running totals over an order that spans the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadtime.session import cut_lineage


def running_totals(
    df: DataFrame, order: str, totals: Sequence[str], by: Sequence[str] = (), *, descending: bool = False
) -> DataFrame:
    """Add ``run_<c>``, the sum of ``c`` up to and including the row, and ``total_<c>``, that of the group.

    ``df`` must hold one row per (``by``, ``order``): aggregate before calling, so that equal
    values, however many, are one row. A plain window would sort a whole group in one task.
    Here the rows are range-partitioned, which cuts even a single group into even slices; a
    window runs within each slice and the totals of the slices before it are added. The slices
    are written once to the shared folder, so both uses see the same ones whatever is lost.
    """
    by = list(by)
    order_column = F.desc(order) if descending else F.asc(order)
    sliced = cut_lineage(
        df.repartitionByRange(*by, order_column).withColumn("__slice", F.spark_partition_id())
    )
    within = (
        Window.partitionBy("__slice", *by)
        .orderBy(order_column)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One row per slice and group: as many as there are partitions, plus one per group.
    group = Window.partitionBy(*by)
    before = group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sliced.groupBy("__slice", *by)
        .agg(*[F.sum(c).alias(c) for c in totals])
        .select(
            F.col("__slice").alias("__s"),
            *[F.col(c).alias(f"__by_{c}") for c in by],
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in totals],
            *[F.sum(c).over(group).alias(f"total_{c}") for c in totals],
        )
    )
    same = [F.col("__slice") == F.col("__s"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]]
    inside = sliced.select("*", *[F.sum(c).over(within).alias(f"__in_{c}") for c in totals])
    return inside.join(slices, reduce(and_, same)).select(
        *df.columns,
        *[(F.col(f"__in_{c}") + F.col(f"__before_{c}")).alias(f"run_{c}") for c in totals],
        *[f"total_{c}" for c in totals],
    )
