"""What the physical plans of the queries must not contain, and what must reach the scans."""

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_no_python_rows_and_no_products(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    for forbidden in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(contract.queries()["projection"](spark, SF_DIR))
    assert "EqualTo(l_linestatus,F)" in plan and "l_shipdate" not in plan
    plan = plan_of(contract.queries()["asof_bucketed"](spark, SF_DIR))
    assert "EqualTo(event_type,purchase)" in plan and "EqualTo(event_type,view)" in plan and "props" not in plan


def test_large_sides_are_not_broadcast_unasked(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("asof_bucketed", "asof_any_age", "prev_event_flag", "shift_by_dimension", "semi_reduce"):
            assert "BroadcastHashJoin" not in plan_of(contract.queries()[name](spark, SF_DIR)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
