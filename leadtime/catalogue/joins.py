"""As-of joins, lookups, semi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import EVENTS_SQL, query, table, timed_events
from leadtime.functions.clock import HOUR, epoch_seconds, local_epoch, shifted
from leadtime.operators.asof import asof_bucketed, asof_exact
from leadtime.operators.lookup import keep_known, keys_in_use, looked_up, spread_lookup, station_zones, within_bounds
from leadtime.operators.ranking import first_per_group


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases look for the latest view at their place."""
    events = timed_events(spark, sf_dir)
    purchases = events.where(F.col("event_type") == "purchase").select("event_id", "k", "t", "value")
    views = events.where(F.col("event_type") == "view").select(
        "k",
        F.col("event_id").alias("reading_id"),
        F.col("t").alias("reading_time"),
        F.col("value").alias("reading_value"),
    )
    return purchases, views


_SIDES_SQL = f"""
WITH e AS ({EVENTS_SQL}),
p AS (SELECT event_id, k, t, value FROM e WHERE event_type = 'purchase'),
v AS (SELECT k, event_id AS reading_id, t AS reading_time, value AS reading_value FROM e WHERE event_type = 'view')"""

_PAIR_SQL = "p.event_id, p.k, p.t, p.value, v.reading_id, v.reading_time, v.reading_value, p.t - v.reading_time AS age"
_FIRST_SQL = "QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY age, reading_id) = 1"


@query(
    f"""{_SIDES_SQL},
near AS (
  SELECT {_PAIR_SQL} FROM p JOIN v ON p.k = v.k AND round(p.t / 3600) = round(v.reading_time / 3600) + 2
  UNION ALL
  SELECT {_PAIR_SQL} FROM p JOIN v ON p.k = v.k AND round(p.t / 3600) = round(v.reading_time / 3600) + 3)
SELECT * FROM near WHERE age >= 7200 {_FIRST_SQL}""",
    name="asof_bucketed",
)
def asof_by_hour_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases, views = _sides(spark, sf_dir)
    return asof_bucketed(purchases, views, "k", "t", "reading_time", "reading_id")


@query(
    f"""{_SIDES_SQL},
near AS (SELECT {_PAIR_SQL} FROM p JOIN v ON p.k = v.k AND p.t - v.reading_time >= 7200 AND p.t - v.reading_time < 14400)
SELECT * FROM near {_FIRST_SQL}""",
    name="asof_exact",
)
def asof_within_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases, views = _sides(spark, sf_dir)
    return asof_exact(
        purchases, views, "k", "t", "reading_time", "reading_id", min_age=2 * HOUR, max_age=4 * HOUR
    )


@query(
    f"""{_SIDES_SQL},
u AS (SELECT k, reading_time, min(reading_id) AS reading_id, arg_min(reading_value, reading_id) AS reading_value
      FROM v GROUP BY k, reading_time)
SELECT p.event_id, p.k, p.t, p.value, u.reading_id, u.reading_time, u.reading_value, p.t - u.reading_time AS age
FROM p ASOF LEFT JOIN u ON p.k = u.k AND p.t - 7200 >= u.reading_time"""
)
def asof_any_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases without an earlier view stay, with nulls."""
    purchases, views = _sides(spark, sf_dir)
    return asof_exact(purchases, views, "k", "t", "reading_time", "reading_id", min_age=2 * HOUR, how="left")


@query(
    """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS t FROM events),
b AS (SELECT min(t) - 14400 AS lo, max(t) AS hi FROM e WHERE event_type = 'purchase')
SELECT event_id, t FROM e, b WHERE t BETWEEN lo AND hi"""
)
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed_events(spark, sf_dir)
    purchases = events.where(F.col("event_type") == "purchase")
    return within_bounds(events.select("event_id", "t"), "t", purchases, "t")


@query(
    """
SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS t,
       epoch_us(o_orderdate) // 1000000 + (n_nationkey - 12) * 30 * 60 AS local_t
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def shift_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = table(spark, sf_dir, "nation", "n_nationkey").withColumn(
        "offset_minutes", (F.col("n_nationkey") - 12) * 30
    )
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    placed = looked_up(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", {"c_nationkey": "nation"})
    located = looked_up(placed, "nation", offsets, "n_nationkey", {"offset_minutes": "offset_minutes"})
    t = epoch_seconds(F.col("o_orderdate"))
    return located.select("o_orderkey", t.alias("t"), shifted(t, F.col("offset_minutes")).alias("local_t"))


@query(
    """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))"""
)
def semi_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    of_brand = parts.where(F.col("p_brand") == parts.agg(F.min("p_brand")).scalar())
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return keep_known(lines, "l_partkey", of_brand, "p_partkey")


@query(
    """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    name="keys_in_use",
)
def lookup_keys_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey")
    return keys_in_use(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey", orders, "o_custkey")


@query(
    """
SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS station,
       s_name AS call, 'zone ' || n_name AS zone
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal <> 0 AND s_nationkey <> 0 AND 20200000 + s_nationkey >= 20200010
  AND s_suppkey IN (SELECT l_suppkey FROM lineitem)""",
    name="station_zones",
)
def usable_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations: balance and nation as position, nation also as date of the last report."""
    supplier = table(spark, sf_dir, "supplier")
    usaf = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    wban = F.lpad(F.col("s_nationkey").cast("string"), 5, "0")
    stations = supplier.select(
        usaf.alias("usaf"),
        wban.alias("wban"),
        F.col("s_name").alias("call"),
        F.col("s_acctbal").cast("string").alias("lat"),
        F.col("s_nationkey").cast("string").alias("lon"),
        (F.lit(20200000) + F.col("s_nationkey")).cast("string").alias("end"),
    )
    used = looked_up(
        table(spark, sf_dir, "lineitem", "l_suppkey"), "l_suppkey", supplier, "s_suppkey", {"s_name": "call"}
    )
    nation = table(spark, sf_dir, "nation")
    zones = looked_up(
        supplier.select(F.concat(usaf, wban).alias("station"), "s_nationkey"),
        "s_nationkey",
        nation,
        "n_nationkey",
        {"n_name": "n_name"},
    ).select("station", F.concat(F.lit("zone "), "n_name").alias("zone"))
    return station_zones(stations, used, zones, 20200010)


@query(
    """
SELECT user_id, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
    name="first_per_group",
)
def highest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "user_id", "event_id", "value")
    return first_per_group(events, ["user_id"], [F.desc("value"), F.asc("event_id")])


@query(
    f"""
SELECT event_id, t, t + CASE user_id % 3 WHEN 0 THEN -5 WHEN 1 THEN 1 ELSE 9 END * 3600 AS local_t
FROM ({EVENTS_SQL})""",
    name="zone_local_times",
)
def local_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall-clock seconds of every event in the zone of its user. All events fall in one winter month."""
    zones = F.array(*[F.lit(z) for z in ("America/New_York", "Europe/Paris", "Asia/Tokyo")])
    events = timed_events(spark, sf_dir).select("event_id", "user_id", "t")
    zone = F.get(zones, (F.col("user_id") % 3).cast("int"))
    return events.select("event_id", "t", local_epoch(F.timestamp_seconds("t"), zone).alias("local_t"))


@query(
    """
SELECT l_orderkey, l_linenumber, p_brand FROM lineitem
LEFT JOIN part ON p_partkey = CASE WHEN l_linenumber <= 3 THEN 1 WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END"""
)
def lookup_by_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of parts, where half of all lines name one part and some name none: the hot key's lines never move."""
    part = F.when(F.col("l_linenumber") <= 3, F.lit(1)).when(F.col("l_linenumber") < 7, F.col("l_partkey"))
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", part.alias("part"))
    found = spread_lookup(lines, "part", table(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_partkey", {"p_brand": "p_brand"})
    return found.drop("part")
