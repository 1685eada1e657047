"""Every query of the catalogue gives the same rows as its SQL twin in DuckDB."""

import os

import pytest
from oracle import compare, database
from pyspark.sql import functions as F

import __spark_entry__ as contract
from leadtime.catalogue import ORACLE, QUERIES, learning

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, tables, name):
    assert compare(contract.queries()[name](spark, SF_DIR), tables, contract.oracle_sql()[name]) == []


def test_every_query_of_the_catalogue_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(contract.queries())


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_known_counts(spark):
    queries = contract.queries()
    sf = "/root/testdata/sf0.01"
    assert queries["asof_bucketed"](spark, sf).count() == 669
    assert queries["asof_exact"](spark, sf).count() == 823
    flags = queries["prev_event_flag"](spark, sf).groupBy().sum("prev_outcome").first()[0]
    assert flags == 1636
    parts = {r.part: r.n for r in queries["time_split_sizes"](spark, sf).collect()}
    assert parts == {"train": 6005, "val": 1988, "test": 2007}


@pytest.mark.parametrize("name", ["models_by_level", "model_areas"])
def test_models_of_a_wrong_label_are_found(spark, monkeypatch, name):
    """The comparison of models would notice if they learnt from another column."""
    sf, right = "/root/testdata/sf0.001", learning.line_features
    monkeypatch.setattr(learning, "line_features", lambda *where: right(*where).withColumn("costly", (F.col("l_discount") > 0.04).cast("int")))
    assert compare(contract.queries()[name](spark, sf), database(sf), contract.oracle_sql()[name]) != []
