"""Profiles of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import EVENTS_SQL, query, table, timed_events
from leadtime.operators.balance import class_share as shares
from leadtime.operators.levels import approximate_quantile, level_frequency
from leadtime.operators.profile import (
    correlations,
    distinct_counts as count_distinct_values,
    extent,
    five_numbers,
    histograms,
    min_max_profile as ends_of,
    target_counts as counts_by_target,
    target_rate as rate_by_level,
)
from leadtime.operators.ranking import top

_AREAS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("SELECT l_partkey, count(l_partkey) AS n FROM lineitem GROUP BY l_partkey", name="level_frequency")
def level_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_frequency(table(spark, sf_dir, "lineitem", "l_partkey"), "l_partkey")


@query(
    """
SELECT quantile_disc(n, 0.8) AS quantile FROM (SELECT count(l_partkey) AS n FROM lineitem GROUP BY l_partkey)"""
)
def level_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequency = level_frequency(table(spark, sf_dir, "lineitem", "l_partkey"), "l_partkey")
    return approximate_quantile(frequency, "n", 0.8)


@query(
    """
SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 15"""
)
def top_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequency = level_frequency(table(spark, sf_dir, "lineitem", "l_partkey"), "l_partkey")
    return top(frequency, [F.desc("n"), F.asc("l_partkey")], 15)


@query(f"SELECT count(*) AS n, min(t) AS first, max(t) AS last FROM ({EVENTS_SQL})")
def event_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent(timed_events(spark, sf_dir), "t", rows="n")


@query("SELECT min(l_extendedprice) AS first, max(l_extendedprice) AS last FROM lineitem")
def price_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent(table(spark, sf_dir, "lineitem", "l_extendedprice"), "l_extendedprice")


@query(
    """
SELECT count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey,
       count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_returnflag) AS l_returnflag,
       count(DISTINCT l_linenumber) AS l_linenumber FROM lineitem"""
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return count_distinct_values(lines, ["l_partkey", "l_suppkey", "l_orderkey", "l_returnflag", "l_linenumber"])


@query("SELECT DISTINCT event_type FROM events")
def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_type").distinct()


@query(
    """
SELECT 'l_partkey' AS "column", CAST(min(l_partkey) AS VARCHAR) AS min, CAST(max(l_partkey) AS VARCHAR) AS max FROM lineitem
UNION ALL SELECT 'l_returnflag', min(l_returnflag), max(l_returnflag) FROM lineitem
UNION ALL SELECT 'flag_line', min(l_returnflag || l_linenumber), max(l_returnflag || l_linenumber) FROM lineitem"""
)
def min_max_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_linenumber")
    lines = lines.withColumn("flag_line", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    return ends_of(lines, ["l_partkey", "l_returnflag", "flag_line"])


@query(
    f"""
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ({EVENTS_SQL}) GROUP BY label"""
)
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(timed_events(spark, sf_dir), "label").withColumn("share", F.round("share", 9))


@query(
    """
SELECT l_linenumber, count(*) AS n, round(avg(y), 9) AS rate,
       round(avg(y) - 1.96 * stddev_samp(y) / sqrt(count(*)), 9) AS low,
       round(avg(y) + 1.96 * stddev_samp(y) / sqrt(count(*)), 9) AS high
FROM (SELECT l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem) GROUP BY l_linenumber"""
)
def target_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    rates = rate_by_level(lines, "l_linenumber", "y")
    return rates.withColumns({c: F.round(c, 9) for c in ("rate", "low", "high")})


@query(f"SELECT user_id, label, count(*) AS n FROM ({EVENTS_SQL}) GROUP BY user_id, label")
def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_target(timed_events(spark, sf_dir), "user_id", "label")


def _histogram_sql(source: str, columns: list[str], bins: int) -> str:
    one = """
SELECT '{c}' AS "column", CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / {n}, 6) AS lower,
       round(lo + (b + 1) * (hi - lo) / {n}, 6) AS upper,
       (SELECT count(*) FROM {s} WHERE least(CAST(floor(({c} - lo) / (hi - lo) * {n}) AS INTEGER), {n} - 1) = b) AS n
FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {s}) CROSS JOIN range({n}) AS r(b)"""
    return " UNION ALL ".join(one.format(c=c, n=bins, s=source) for c in columns)


def _rounded_edges(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query(_histogram_sql("events", ["value"], 15), name="histogram15")
def histogram_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_edges(histograms(table(spark, sf_dir, "events", "value"), ["value"], 15))


@query(_histogram_sql("lineitem", _AREAS, 10), name="histograms")
def histograms_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_edges(histograms(table(spark, sf_dir, "lineitem"), _AREAS, 10))


_FIVE_SQL = """
SELECT '{c}' AS "column", l_returnflag, CAST(min({c}) AS DOUBLE) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, CAST(max({c}) AS DOUBLE) AS max
FROM lineitem GROUP BY l_returnflag"""


@query(" UNION ALL ".join(_FIVE_SQL.format(c=c) for c in _AREAS), name="five_numbers")
def five_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = five_numbers(table(spark, sf_dir, "lineitem"), _AREAS, "l_returnflag")
    return numbers.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 9) AS corr FROM lineitem"
        for i, a in enumerate(_AREAS)
        for b in _AREAS[i + 1 :]
    ),
    name="corr_matrix",
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations(table(spark, sf_dir, "lineitem"), _AREAS).withColumn("corr", F.round("corr", 9))
