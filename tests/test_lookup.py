"""Lookups by keys that hold much of the table."""

import pytest
from pyspark.sql import functions as F

from leadtime.operators.lookup import heavy_keys, looked_up, spread_lookup


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def facts(spark, n=20_000):
    """One key in half of all rows, another in a tenth, null in a fiftieth, the others spread."""
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(8)).when(F.col("id") % 50 == 3, None).otherwise(F.col("id"))
    return spark.range(n).select("id", key.alias("k"))


def test_heavy_keys_are_found(spark):
    assert set(heavy_keys(facts(spark), "k", 0.05)) == {7, 8}
    assert heavy_keys(facts(spark).limit(0), "k") == []
    # Many keys beside: none that holds the share is missed.
    rows = spark.range(300_000).select(F.when(F.col("id") % 40 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    assert heavy_keys(rows.repartition(7), "k", 0.02) == ["hot"]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_same_as_a_plain_lookup(spark, how):
    dimension = spark.range(0, 30_000, 3).select(F.col("id").alias("code"), (F.col("id") * 2).alias("worth")).union(spark.sql("SELECT 7L, 70L"))
    df = facts(spark)
    for rows in (df, df.where("k > 10"), df.limit(0)):
        plain = looked_up(rows, "k", dimension, "code", {"worth": "w"}, how)
        spread = spread_lookup(rows, "k", dimension, "code", {"worth": "w"}, how)
        assert spread.columns == plain.columns
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_rows_of_a_hot_key_do_not_meet_in_one_task(spark, no_broadcast):
    """Without broadcasting by size, the fullest task of the join has a small share of the rows; a plain join has over half."""
    dimension = spark.range(50_000).select(F.col("id").alias("code"), F.lit("x").alias("worth"))
    df = facts(spark).repartition(8)
    for setting in ("spark.sql.adaptive.enabled",):
        spark.conf.set(setting, "false")
    try:
        fullest = {}
        for name, join in (("spread", spread_lookup), ("plain", looked_up)):
            joined = join(df, "k", dimension, "code", {"worth": "w"})
            fullest[name] = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert fullest["plain"] > 10_000 and fullest["spread"] < 4_000
