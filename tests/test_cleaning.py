import pytest
from pyspark.sql import functions as F

from leadtime.functions.clock import epoch_of, hhmm_to_minutes, hour_bucket, local_epoch, shifted
from leadtime.functions.cyclic import cyclic, period_length
from leadtime.functions.keys import composite_key
from leadtime.operators.cleaning import clean_packed, drop_bad_quality, drop_sentinels, require, split_fields
from leadtime.operators.columns import typed_select
from leadtime.operators.profile import null_profile


def column(df, name="x"):
    return [r[name] for r in df.collect()]


def test_quality_codes(spark):
    df = spark.createDataFrame([(1, "1"), (2, "3"), (3, "7"), (4, "A"), (5, None)], "id int, q string")
    assert column(drop_bad_quality(df, ["q"]), "id") == [1, 4]
    assert column(drop_bad_quality(df, ["q"], mode="numeric"), "id") == [1, 2, 3]
    with pytest.raises(ValueError):
        drop_bad_quality(df, ["q"], mode="lenient")


def test_sentinels_drop_nulls_too(spark):
    df = spark.createDataFrame([(1, "999"), (2, "120"), (3, None)], "id int, a string")
    assert column(drop_sentinels(df, {"a": "999"}), "id") == [2]


def test_short_packed_fields(spark):
    rows = [(1, "160,1,N,0046,1"), (2, "160,1,N"), (3, ""), (4, None), (5, "999,1,N,0046,1")]
    df = spark.createDataFrame(rows, "id int, wnd string")
    layout = {"wnd": ["angle", "quality", "type", "speed", "speed_quality"]}
    split = {r.id: (r.angle, r.speed) for r in split_fields(df, layout).collect()}
    assert split == {1: ("160", "0046"), 2: ("160", None), 3: ("", None), 4: (None, None), 5: ("999", "0046")}
    clean = clean_packed(df, layout, {"angle": "999", "speed": "9999"}, ["quality", "speed_quality"])
    assert column(clean, "id") == [1]


def test_typed_select_keeps_order_and_nulls_what_does_not_fit(spark):
    df = spark.createDataFrame([("1", "x", 2.9)], "a string, b string, c double")
    typed = typed_select(df, {"c": "int", "b": "int", "a": "int"})
    assert typed.dtypes == [("a", "int"), ("b", "int"), ("c", "int")]
    assert typed.first() == (1, None, 2)
    with pytest.raises(ValueError):
        typed_select(df, {"z": "int"})


def test_require_and_null_profile(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3, None), (None, 1, 1)], "a int, b int, c int")
    assert require(df, ["a", "b"]).collect() == [(2, 3, None)]
    assert {r.column: r.nulls for r in null_profile(df.drop("z")).collect()} == {"a": 1, "b": 1, "c": 2}
    assert null_profile(df.select(F.coalesce("a", F.lit(0)).alias("a"))).collect() == []


def test_clock_texts(spark):
    times = ["5", "0005", "905", "1305", "2359", "2400", "xx", None]
    df = spark.createDataFrame([(i, "2019-03-01", t) for i, t in enumerate(times)], "id int, d string, t string")
    got = df.select("id", hhmm_to_minutes(F.col("t")).alias("m"), epoch_of(F.col("d"), F.col("t")).alias("e"))
    rows = {r.id: (r.m, r.e) for r in got.collect()}
    day = 1_551_398_400
    assert rows == {
        0: (5, day + 300),
        1: (5, day + 300),
        2: (545, day + 545 * 60),
        3: (785, day + 785 * 60),
        4: (1439, day + 1439 * 60),
        5: (1440, None),
        6: (None, None),
        7: (None, None),
    }
    assert dict(got.dtypes)["m"] == "int"


def test_hour_bucket_rounds_half_up(spark):
    df = spark.createDataFrame([(1799,), (1800,), (5399,), (5400,), (-1800,), (-1801,)], "t bigint")
    assert column(df.select(hour_bucket(F.col("t")).alias("x"))) == [0, 1, 1, 2, 0, -1]


def test_zone_follows_daylight_saving_and_offset_does_not(spark):
    rows = [("2019-03-10 06:59:59",), ("2019-03-10 07:00:00",)]
    df = spark.createDataFrame(rows, "s string").select(F.to_timestamp("s").alias("ts"))
    utc = column(df.select(F.unix_timestamp("ts").alias("x")))
    local = column(df.select(local_epoch(F.col("ts"), F.lit("America/New_York")).alias("x")))
    assert [b - a for a, b in zip(utc, local)] == [-5 * 3600, -4 * 3600]
    fixed = column(df.select(shifted(F.unix_timestamp("ts"), F.lit(-300)).alias("x")))
    assert [b - a for a, b in zip(utc, fixed)] == [-5 * 3600] * 2
    raw = column(df.select(shifted(F.unix_timestamp("ts"), F.lit(-300), unit_seconds=1).alias("x")))
    assert [b - a for a, b in zip(utc, raw)] == [-300, -300]


def test_cycles(spark):
    df = spark.createDataFrame([(0,), (3,), (6,), (366,), (None,)], "v int")
    sin, cos = cyclic(F.col("v"), "MTH")
    rows = df.select("v", sin.alias("s"), cos.alias("c")).collect()
    assert all(abs(r.s**2 + r.c**2 - 1) < 1e-12 for r in rows if r.v is not None)
    assert rows[1].s == pytest.approx(1) and rows[2].c == pytest.approx(-1)
    assert rows[4].s is None and rows[4].c is None
    for bad in ("WEEK", 0, -1):
        with pytest.raises(ValueError):
            period_length(bad)


def test_composite_key_keeps_parts_apart(spark):
    rows = [("1", "23"), ("12", "3"), (None, "3"), ("", "3"), ("a|b", "c"), ("a", "b|c"), ("\\N", "3"), ("a\\", "b"), ("a\\|b", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    keys = column(df.select(composite_key(F.col("a"), F.col("b")).alias("x")))
    assert keys[:4] == ["1|23", "12|3", "\\N|3", "|3"] and len(set(keys)) == len(rows)
