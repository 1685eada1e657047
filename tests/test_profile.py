"""Profiles of many columns in few passes."""

import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from leadtime.functions.clock import epoch_seconds
from leadtime.operators.columns import loss_table, typed_select
from leadtime.operators.profile import distinct_counts, distinct_values, histograms

DAY = datetime.date(2020, 1, 1)


def test_distinct_counts_of_every_type(spark):
    rows = [
        (1, "a", 0.0, DAY, b"x", [1], {"a": 1}), (1, "A", -0.0, DAY, b"\xff", [1, None], None), (None, "", float("nan"), None, b"\xfe", [], {"a": 2}),
        (2, None, float("nan"), DAY, None, None, {"b": 1}),
    ]
    df = spark.createDataFrame(rows, "i int, s string, d double, day date, b binary, l array<int>, m map<string,int>")
    assert distinct_counts(df, df.columns).first().asDict() == {"i": 2, "s": 3, "d": 2, "day": 1, "b": 3, "l": 3, "m": 3}
    assert distinct_counts(df.limit(0), ["i", "s"]).first().asDict() == {"i": 0, "s": 0}


def test_a_task_moves_distinct_values_only(spark):
    df = spark.range(0, 200_000, 1, 4).selectExpr("id % 10 AS a", "id % 7 AS b", "cast(null as string) AS c")
    assert distinct_counts(df, ["a", "b", "c"]).first().asDict() == {"a": 10, "b": 7, "c": 0}
    values = distinct_values(df, ["a", "b", "c"])
    values.collect()
    plan = values._jdf.queryExecution().executedPlan()
    moved = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
    # The exchange's writer counts what the tasks before it gave.
    while "Exchange" not in moved.nodeName():
        moved = moved.plan() if "QueryStage" in moved.nodeName() else moved.children().head()
    assert moved.metrics().get("shuffleRecordsWritten").get().value() <= 4 * 17


def test_histograms_of_odd_columns(spark):
    rows = [(1.0, 5, None), (2.0, 5, None), (float(4), 5, None), (None, 5, None)]
    df = spark.createDataFrame(rows, "x double, one int, none int")
    got = {(r.column, r.bin): (r.lower, r.upper, r.n) for r in histograms(df, ["x", "one", "none"], 3).collect()}
    assert got == {
        ("x", 0): (1.0, 2.0, 1), ("x", 1): (2.0, 3.0, 1), ("x", 2): (3.0, 4.0, 1),
        ("one", 0): (pytest.approx(4.5), pytest.approx(4.5 + 1 / 3), 0), ("one", 1): (pytest.approx(4.5 + 1 / 3), pytest.approx(4.5 + 2 / 3), 4),
        ("one", 2): (pytest.approx(4.5 + 2 / 3), pytest.approx(5.5), 0),
    }
    plan = histograms(df, ["x", "one"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "unpivot" not in plan.lower()


def test_lost_values_are_counted_in_the_pass_that_casts(spark):
    df = spark.createDataFrame([("1", "x"), ("oops", "2"), (None, "3"), ("400", None)], "a string, b string")
    losses = Observation()
    typed = typed_select(df, {"b": "int", "a": "tinyint"}, losses)
    assert typed.columns == ["a", "b"]
    typed.write.format("noop").mode("overwrite").save()
    assert {r.column: r.lost for r in loss_table(spark, losses).collect()} == {"a": 2, "b": 1}


def test_sessions_in_other_zones_are_refused(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            epoch_seconds(F.lit(1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
