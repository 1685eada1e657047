import random

import pytest
from pyspark.sql import functions as F

from leadtime.operators.balance import oversample_minority, repeat_rows
from leadtime.operators.levels import fold_rare_levels, level_frequency
from leadtime.operators.lookup import keep_known, keys_in_use, looked_up, sized, station_zones, within_bounds
from leadtime.operators.split import split_frames, time_split


def test_folding_by_level_quantile(spark):
    counts = {"a": 50, "b": 9, "c": 2, "d": 1, "e": 1}
    rows = [(level,) for level, n in counts.items() for _ in range(n)] + [(None,)] * 4
    folded = fold_rare_levels(spark.createDataFrame(rows, "c string"), "c", "f", "other")
    got = {(r.c, r.f): r["count"] for r in folded.groupBy("c", "f").count().collect()}
    # Frequencies 0 (null), 1, 1, 2, 9, 50: the 0.8 quantile is 9.
    assert got == {
        ("a", "a"): 50, ("b", "other"): 9, ("c", "other"): 2, ("d", "other"): 1, ("e", "other"): 1, (None, None): 4,
    }


def test_folding_when_all_levels_are_equally_frequent(spark):
    df = spark.createDataFrame([(c,) for c in "aabbcc"], "c string")
    assert {r.f for r in fold_rare_levels(df, "c", "f", "other").collect()} == {"other"}


def test_null_level_counts_zero(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "c string")
    assert {r.c: r.n for r in level_frequency(df, "c").collect()} == {"a": 1, None: 0}


@pytest.mark.parametrize(
    "major, minor, copies", [(29, 10, 2), (10, 10, 1), (3, 10, 1), (7, 0, 0), (0, 4, 1), (40, 10, 4)]
)
def test_oversampling(spark, major, minor, copies):
    df = spark.createDataFrame([(i, 0) for i in range(major)] + [(100 + i, 1) for i in range(minor)], "id int, y int")
    got = {r.y: (r.n, r.ids) for r in oversample_minority(df, "y").groupBy("y").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()}
    assert got.get(0, (0, 0)) == (major, major)
    assert got.get(1, (0, 0)) == (minor * copies, minor)


def test_repeat_rows(spark):
    assert repeat_rows(spark.range(3), 4).groupBy("id").count().where("count = 4").count() == 3


def test_split_cuts_the_range_and_keeps_all_rows(spark):
    rng = random.Random(3)
    times = [0, 60, 80, 100] + [rng.randrange(101) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(999, None)], "id int, t bigint")
    parts = {r.id: r.part for r in time_split(df, "t", 0.6, 0.2).collect()}
    assert parts[0] == "train" and parts[1] == "train" and parts[2] == "val" and parts[3] == "test"
    assert parts[999] is None
    frames = split_frames(df, "t", 0.6, 0.2)
    ids = [r.id for frame in frames.values() for r in frame.collect()]
    assert sorted(ids) == list(range(len(times)))
    assert frames["train"].columns == ["id"]


def test_split_of_a_single_moment_is_all_training(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "id int, t bigint")
    assert {r.part for r in time_split(df, "t").collect()} == {"train"}
    with pytest.raises(ValueError):
        time_split(df, "t", 0.9, 0.2)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10)], "key string, v int")
    left = {r.id: r.w for r in looked_up(df, "k", dim, "key", {"v": "w"}).collect()}
    assert left == {1: 10, 2: None, 3: None}
    assert looked_up(df, "k", dim, "key", {"v": "w"}, "inner").count() == 1
    assert keep_known(df, "k", dim.union(dim), "key").count() == 1
    assert keys_in_use(dim, "key", df.union(df), "k").count() == 1


def test_broadcast_only_below_the_limit(spark):
    def plan(df):
        return df._jdf.queryExecution().logical().toString()

    assert "broadcast" in plan(sized(spark.range(10), 10)).lower()
    assert "broadcast" not in plan(sized(spark.range(11), 10)).lower()


def test_bounds(spark):
    df = spark.createDataFrame([(t,) for t in (99, 100, 500, 600, 601)] + [(None,)], "t bigint")
    other = spark.createDataFrame([(200,), (600,)], "u bigint")
    assert [r.t for r in within_bounds(df, "t", other, "u", before=100).collect()] == [100, 500, 600]


def test_stations(spark):
    rows = [
        ("725000", "00001", "KAAA", "40.1", "-70.2", "20200101"),
        ("725000", "00002", "KAAA", "0", "-70.2", "20200101"),
        ("725000", "00003", "KAAA", None, "-70.2", "20200101"),
        ("725000", "00004", "KAAA", "40.1", "-70.2", "20140101"),
        ("725000", "00005", "KBBB", "40.1", "-70.2", "20200101"),
    ]
    stations = spark.createDataFrame(rows, "usaf string, wban string, call string, lat string, lon string, end string")
    calls = spark.createDataFrame([("KAAA",), ("KAAA",)], "call string")
    zones = spark.createDataFrame([("72500000001", "America/New_York")], "station string, zone string")
    got = station_zones(stations, calls, zones, 20150101).collect()
    assert got == [("72500000001", "KAAA", "America/New_York")]
