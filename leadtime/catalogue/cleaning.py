"""Typed selection, required rows, packed fields, clock and key functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import query, table
from leadtime.functions.clock import day_of_year, epoch_of, hhmm_to_minutes, hour_bucket, epoch_seconds
from leadtime.functions.keys import composite_key
from leadtime.operators.cleaning import clean_packed, keep_equal, require, split_fields
from leadtime.operators.columns import feature_columns, loss_table, observed_losses, renamed, typed_select
from leadtime.operators.profile import null_profile
from leadtime.operators.ranking import top
from leadtime.session import query_root
from leadtime.sources.stages import write_stage


@query(
    """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, TRY_CAST(trunc(l_quantity) AS INTEGER) AS l_quantity,
       TRY_CAST(l_returnflag AS INTEGER) AS l_returnflag, CAST(l_linenumber AS DOUBLE) AS l_linenumber
FROM lineitem""",
    name="typed_select",
)
def typed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = {"l_quantity": "int", "l_returnflag": "int", "l_orderkey": "string", "l_linenumber": "double"}
    return typed_select(table(spark, sf_dir, "lineitem"), types)


_LOSS_SQL = """
WITH t AS (SELECT CAST(l_partkey AS VARCHAR) AS l_partkey, l_returnflag, CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linenumber = 3 THEN 'x' ELSE '' END AS l_linenumber,
                  CAST(l_quantity AS DOUBLE) AS l_quantity, CASE WHEN l_linenumber = 2 THEN '2400' ELSE '0930' END AS hhmm FROM lineitem)
SELECT 'l_partkey' AS "column", count(*) FILTER (TRY_CAST(l_partkey AS TINYINT) IS NULL) AS lost FROM t
UNION ALL SELECT 'l_returnflag', count(*) FILTER (TRY_CAST(l_returnflag AS INTEGER) IS NULL) FROM t
UNION ALL SELECT 'l_linenumber', count(*) FILTER (TRY_CAST(l_linenumber AS INTEGER) IS NULL) FROM t
UNION ALL SELECT 'l_quantity', CAST(0 AS BIGINT)
UNION ALL SELECT 'departure', count(*) FILTER (hhmm = '2400') FROM t"""


@query(_LOSS_SQL)
def cast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values lost by casts and clock times that do not exist, by column, counted in the pass that writes the rows."""
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_linenumber", "l_quantity")
    number = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 3, "x").otherwise(""))
    messy = lines.select(
        F.col("l_partkey").cast("string").alias("l_partkey"),
        "l_returnflag",
        number.alias("l_linenumber"),
        F.col("l_quantity").cast("double").alias("l_quantity"),
        F.when(F.col("l_linenumber") == 2, "2400").otherwise("0930").alias("hhmm"),
    )
    typed, clocked = Observation(), Observation()
    departure = epoch_of(F.lit("2015-03-04"), F.col("hhmm"))
    seen = observed_losses(messy, {"departure": (F.col("hhmm"), departure)}, clocked)
    types = {"l_partkey": "tinyint", "l_returnflag": "int", "l_linenumber": "int", "l_quantity": "float", "hhmm": "string"}
    write_stage(typed_select(seen, types, typed), query_root(spark), "lines", "typed")
    return loss_table(spark, typed).where("column <> 'hhmm'").union(loss_table(spark, clocked))


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(
    """
SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND toxic IS NOT NULL"""
)
def required_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require(_labelled_documents(spark, sf_dir), ["quality", "toxic"])


@query(
    """
WITH j AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS nulls FROM j
      UNION ALL SELECT 'lang', count(*) - count(lang) FROM j
      UNION ALL SELECT 'source', count(*) - count(source) FROM j
      UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM j
      UNION ALL SELECT 'quality', count(*) - count(quality) FROM j
      UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM j)
SELECT * FROM c WHERE nulls > 0""",
    name="null_profile",
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_profile(_labelled_documents(spark, sf_dir))


# A line as one packed text: quantity, number, flag, discount, status. The line number plays the quality code.
_LAYOUT = {"packed": ("qty", "code", "flag", "disc", "status", "extra")}


def _packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_partkey",
        F.concat(F.lit(" "), "l_returnflag", F.lit("  ")).alias("call"),
        F.concat_ws(
            ",",
            F.col("l_quantity").cast("int").cast("string"),
            F.col("l_linenumber").cast("string"),
            "l_returnflag",
            (F.col("l_discount") * 100).cast("int").cast("string"),
            "l_linestatus",
        ).alias("packed"),
    )


_PACKED_SQL = """
WITH t AS (SELECT l_orderkey, l_partkey, l_returnflag AS call,
                  concat_ws(',', CAST(trunc(l_quantity) AS INTEGER), l_linenumber, l_returnflag,
                            CAST(trunc(l_discount * 100) AS INTEGER), l_linestatus) AS packed
           FROM lineitem),
s AS (SELECT l_orderkey, l_partkey, call, split_part(packed, ',', 1) AS qty, split_part(packed, ',', 2) AS code,
             split_part(packed, ',', 3) AS flag, split_part(packed, ',', 4) AS disc,
             split_part(packed, ',', 5) AS status, CAST(NULL AS VARCHAR) AS extra FROM t)"""


@query(f"{_PACKED_SQL} SELECT * FROM s", name="composite_split")
def packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part is never there and comes out null."""
    split = split_fields(_packed_lines(spark, sf_dir), _LAYOUT).drop("packed")
    return split.withColumn("call", F.trim("call"))


@query(f"{_PACKED_SQL} SELECT * EXCLUDE (extra) FROM s WHERE qty <> '50' AND disc <> '0' AND code NOT IN ('3', '7')", name="composite_clean")
def packed_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_packed(
        _packed_lines(spark, sf_dir), _LAYOUT, {"qty": "50", "disc": "0"}, ["code"], trim=["call"]
    )
    return cleaned.drop("packed", "extra")


@query("SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minutes FROM events")
def hhmm_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "ts")
    return events.select("event_id", hhmm_to_minutes(F.date_format("ts", "HHmm")).alias("minutes"))


@query(
    """
SELECT event_id, epoch_us(date_trunc('minute', ts)) // 1000000 AS t,
       CAST(round((epoch_us(ts) // 1000000) / 3600) AS BIGINT) AS bucket,
       CAST(dayofyear(ts) AS INTEGER) AS doy
FROM events"""
)
def date_time_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and time of day as texts, the time without its leading zeros, back to epoch seconds."""
    events = table(spark, sf_dir, "events", "event_id", "ts")
    date = F.date_format("ts", "yyyy-MM-dd")
    hhmm = F.date_format("ts", "HHmm").cast("int").cast("string")
    return events.select(
        "event_id",
        epoch_of(date, hhmm).alias("t"),
        hour_bucket(epoch_seconds(F.col("ts"))).alias("bucket"),
        day_of_year(date).alias("doy"),
    )


@query(
    """
SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 strftime(l_shipdate, '%Y-%m-%d')) AS line_key, count(*) AS n
FROM lineitem GROUP BY 1""",
    name="composite_key",
)
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    key = composite_key(F.col("l_orderkey"), F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return lines.groupBy(key.alias("line_key")).agg(F.count("*").alias("n"))


@query(
    """
SELECT l_returnflag AS flag, l_linestatus AS status, l_quantity, l_extendedprice, l_orderkey,
       CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size
FROM lineitem WHERE l_linestatus = 'F'"""
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality filter, rename, drop, a conditional column and a fixed column order."""
    lines = keep_equal(table(spark, sf_dir, "lineitem"), "l_linestatus", "F")
    named = renamed(lines, {"l_returnflag": "flag", "l_linestatus": "status"}, drop=["l_tax", "l_shipdate"])
    sized = named.withColumn("size", F.when(F.col("l_quantity") > 25, "large").otherwise("small"))
    return feature_columns(sized, ["flag", "status"], ["l_quantity", "l_extendedprice"], ["l_orderkey"], "size")


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 10")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value"), [F.asc("event_id")], 10)


@query(
    """
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END
       AS level, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS final_price
FROM orders"""
)
def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").select(
        "o_orderkey",
        F.when(price > 400_000, "high").when(price > 100_000, "middle").otherwise("low").alias("level"),
        F.when(F.col("o_orderstatus") == "F", price).alias("final_price"),
    )
