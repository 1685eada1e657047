"""Feature engineering on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import EVENTS_SQL, query, table, timed_events
from leadtime.functions.cyclic import cyclic
from leadtime.operators.balance import oversample_minority, repeat_rows
from leadtime.operators.history import previous_outcome
from leadtime.operators.levels import fold_rare_levels
from leadtime.operators.split import PARTS, split_frames, time_split

FOLD_SQL = """
f AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
c AS (SELECT quantile_disc(n, 0.8) AS cut FROM f)"""


@query(
    f"""
WITH {FOLD_SQL}
SELECT l_orderkey, l_linenumber, l.l_partkey,
       CASE WHEN n <= cut THEN 'RARE' ELSE CAST(l.l_partkey AS VARCHAR) END AS part_folded
FROM lineitem l JOIN f ON l.l_partkey = f.l_partkey CROSS JOIN c""",
    name="fold_rare_levels",
)
def folded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    text = lines.withColumn("part", F.col("l_partkey").cast("string"))
    return fold_rare_levels(text, "part", "part_folded", "RARE").drop("part")


def _cyclic_sql(name: str, value: str, period: int) -> str:
    return ", ".join(
        f"CASE WHEN abs({f}({value} * (2 * pi() / {period}))) < 5e-10 THEN 0.0 "
        f"ELSE round({f}({value} * (2 * pi() / {period})), 9) END AS {name}_{f}"
        for f in ("sin", "cos")
    )


def _rounded_cycle(name: str, value, period: str) -> list:
    return [F.round(c, 9).alias(f"{name}_{f}") for c, f in zip(cyclic(value, period), ("sin", "cos"))]


@query(
    f"""
SELECT l_orderkey, {_cyclic_sql("month", "month(l_shipdate)", 12)}, {_cyclic_sql("doy", "dayofyear(l_shipdate)", 365)},
       {_cyclic_sql("dow", "isodow(l_shipdate)", 7)} FROM lineitem"""
)
def cyclic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate")
    return lines.select(
        "l_orderkey",
        *_rounded_cycle("month", F.month("l_shipdate"), "MTH"),
        *_rounded_cycle("doy", F.dayofyear("l_shipdate"), "DOY"),
        *_rounded_cycle("dow", F.weekday("l_shipdate") + 1, "DOW"),
    )


@query(f"SELECT event_id, {_cyclic_sql('minute', '(hour(ts) * 60 + minute(ts))', 1440)} FROM events")
def cyclic_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events", "event_id", "ts").select(
        "event_id", *_rounded_cycle("minute", minutes, "TIME")
    )


@query(
    f"""
WITH h AS (SELECT event_id, user_id, t, label,
                  lag(label) OVER w AS before, lag(t) OVER w AS prev_time FROM ({EVENTS_SQL})
           WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, user_id, t, label,
       CASE WHEN before IS NULL OR t - prev_time < 7200 THEN 0 ELSE before END AS prev_outcome, prev_time FROM h""",
    name="prev_event_flag",
)
def previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed_events(spark, sf_dir).select("event_id", "user_id", "t", "label")
    return previous_outcome(events, "user_id", "t", "label", "event_id")


@query(
    f"""
WITH e AS (SELECT event_id, t, label FROM ({EVENTS_SQL})),
r AS (SELECT greatest(1, count(*) FILTER (label = 0) // count(*) FILTER (label = 1)) AS times FROM e)
SELECT event_id, t, label FROM e WHERE label = 0
UNION ALL SELECT event_id, t, label FROM (SELECT event_id, t, label, unnest(range(times)) FROM e, r WHERE label = 1)""",
    name="oversample_minority",
)
def oversampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversample_minority(timed_events(spark, sf_dir).select("event_id", "t", "label"), "label")


@query(
    """
WITH r AS (SELECT greatest(1, count(*) FILTER (toxic = 0) // count(*) FILTER (toxic = 1)) AS times FROM labels)
SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0
UNION ALL SELECT doc_id, quality, toxic FROM (SELECT doc_id, quality, toxic, unnest(range(times)) FROM labels, r WHERE toxic = 1)""",
    name="oversample_labels",
)
def oversampled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversample_minority(table(spark, sf_dir, "labels"), "toxic")


SPLIT_SQL = f"""
e AS ({EVENTS_SQL}),
b AS (SELECT min(t) AS first, max(t) AS last FROM e),
s AS (SELECT e.*, CASE WHEN t <= first + floor((last - first) * CAST(0.6 AS DOUBLE)) THEN 'train'
                       WHEN t <= first + floor((last - first) * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part
      FROM e, b)"""


@query(f"WITH {SPLIT_SQL} SELECT event_id, t, part FROM s", name="time_split")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_split(timed_events(spark, sf_dir).select("event_id", "t"), "t", 0.6, 0.2)


@query(f"WITH {SPLIT_SQL} SELECT part, count(*) AS n, CAST(sum(label) AS BIGINT) AS errors FROM s GROUP BY part", name="time_split_sizes")
def time_part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = split_frames(timed_events(spark, sf_dir).select("event_id", "t", "label"), "t", 0.6, 0.2)
    sizes = [
        frames[p].agg(F.lit(p).alias("part"), F.count("*").alias("n"), F.sum("label").alias("errors")) for p in PARTS
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query(
    """
SELECT s_suppkey, s_nationkey FROM supplier, range(3) UNION ALL SELECT n_nationkey, n_regionkey FROM nation"""
)
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers three times over, then nations, all kept."""
    suppliers = repeat_rows(table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), 3)
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("s_suppkey"), F.col("n_regionkey").alias("s_nationkey")
    )
    return suppliers.unionByName(nations)
