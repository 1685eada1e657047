"""Training steps cost what rows hold, not what categories or copies could make of them."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.operators import indexing, learn
from leadtime.operators.balance import oversample_minority
from leadtime.plans.training import Columns, linear_parts, parts_of, tree_parts
from leadtime.sources.stages import read_stage

COLUMNS = Columns(categoricals=["c"], numericals=["n"], outcome="y", time="t")


def _rows(spark) -> DataFrame:
    """A fifth are positive; the first 60 of 100 moments are the training part."""
    return spark.range(1000).select(
        (F.col("id") % 101).alias("t"), (F.col("id") % 7).cast("string").alias("c"), (F.col("id") * 37 % 89).cast("double").alias("n"),
        ((F.col("id") % 5 == 0) | (F.col("id") * 37 % 89 > 84)).cast("int").alias("y"), F.lit("wide").alias("other"),
    )


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("categories", [["c"], ["c", "d"], ["none", "c"], ["none"]])
def test_vectors_are_the_same_with_and_without_the_encoder(spark, monkeypatch, categories):
    df = spark.createDataFrame([("b", "x", None, 1.0, 0), ("a", "x", None, 0.0, 1), ("c", None, None, 2.5, 2)], "c string, d string, none string, n double, k int")
    unseen = df.union(spark.sql("SELECT 'z', 'y', 'w', 4D, 3 UNION ALL SELECT null, null, null, -1D, 4"))
    indexed = learn.category_indexer(categories).fit(df).transform(unseen)
    found = {}
    for most in (200_000, 0):
        monkeypatch.setattr(indexing, "ENCODER_SLOTS", most)
        made = learn.one_hot(categories, ["n"], "v").transform(indexed)
        assert made.columns == [*indexed.columns, "v"]
        assert made.schema["v"].metadata["ml_attr"] == {"num_attrs": indexed.schema[f"{categories[-1]}_idx"].metadata["ml_attr"]["num_vals"] + sum(
            indexed.schema[f"{c}_idx"].metadata["ml_attr"]["num_vals"] - 1 for c in categories[:-1]
        )}
        found[most] = {r.k: r.v for r in made.select("k", vector_to_array("v").alias("v")).collect()}
    assert found[200_000] == found[0] and len(found[0]) == 5


def test_vectors_need_no_json(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 0.0)], "c string, n double")
    ready = learn.linear_features(["c"], ["n"]).fit(df).transform(df)
    assert "json" not in _plan(ready).lower()


def test_slots_are_read_without_the_whole_vector(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("c"), (F.col("id") / 10).alias("n"))
    prepared = learn.linear_features(["c"], ["n"]).fit(df)
    ready = prepared.transform(df)
    read = learn.slot_values(ready, "scaledFeatures", {"n2": 300, "first": 0, "again": 0}, ["c"])
    whole = vector_to_array("scaledFeatures")
    expected = {r.c: (r.n2, r.first, r.first) for r in ready.select("c", whole[300].alias("n2"), whole[0].alias("first")).collect()}
    assert {r.c: (r.n2, r.first, r.again) for r in read.collect()} == expected
    assert len(expected) == 300
    # Only a vector of the two slots is turned into an array.
    assert "UDF(scaledFeatures" not in _plan(read).split("Project")[1]


def test_copies_are_made_where_they_are_read(spark, tmp_path):
    """What is kept holds a training row once; the training part, also as written, is what oversampling gives."""
    parts = parts_of(_rows(spark), COLUMNS)
    staged = parts.staged(str(tmp_path), "s")
    expected = oversample_minority(_rows(spark).where("t <= 60").withColumn("label", F.col("y").cast("double")).drop("t"), "label")
    for train in (parts.train, staged.train):
        assert train.columns == expected.columns
        assert train.exceptAll(expected).count() == expected.exceptAll(train).count() == 0
    assert read_stage(spark, str(tmp_path), "s", "trainingData").count() == expected.count()
    positives = expected.where("y = 1").count()
    assert staged.once.count() == _rows(spark).where("t <= 60").count() < staged.train.count()
    assert staged.once.where("y = 1").agg(F.sum("__copies")).first()[0] == positives
    with tree_parts(staged, COLUMNS) as (ready, _):
        assert ready.once.is_cached and not ready.train.is_cached
        assert ready.train.columns == ["indexedFeatures", "label"] and ready.train.count() == staged.train.count()
    with linear_parts(staged, COLUMNS, keep=["c"]) as (ready, _):
        assert ready.train.columns == ["scaledFeatures", "label", "c"]


def test_boosting_by_weight_is_boosting_of_copies(spark):
    parts = parts_of(_rows(spark), COLUMNS)
    with tree_parts(parts, COLUMNS) as (ready, _):
        rows, weight = ready.weighted()
        assert weight and rows.count() < ready.train.count()
        bins = learn.max_bins(ready.train, "indexedFeatures")
        scores = []
        for estimator, frame in ((learn.boosting("indexedFeatures", bins, weight=weight), rows), (learn.boosting("indexedFeatures", bins), ready.train)):
            trees = estimator.copy({estimator.maxIter: 4, estimator.maxDepth: 3}).fit(frame)
            scores.append([r.s for r in trees.transform(ready.test).select(vector_to_array("probability")[1].alias("s")).collect()])
    assert len(scores[0]) > 100 and scores[0] == pytest.approx(scores[1])


def test_fits_side_by_side_shrink_as_the_rows_grow():
    assert learn.fits_at_once(1000, 8) >= 3
    assert learn.fits_at_once(20 * learn.FIT_ROWS_PER_CORE, 8) == 1
    assert learn.fits_at_once(4 * learn.FIT_ROWS_PER_CORE, 8) == 2
    assert learn.fits_at_once(0, 1) >= 1


def test_tasks_of_boosting_are_few_if_bins_are_many(spark, monkeypatch):
    assert learn.boosting_tasks(1_000_000, 18_000, 12, 3) == 4
    assert learn.boosting_tasks(20_000_000, 12_000, 12, 1) == 26
    assert learn.boosting_tasks(0, 32, 8, 3) == 3
    used = []
    monkeypatch.setattr(learn, "fitted", lambda estimator, train: used.append(train.rdd.getNumPartitions()) or estimator.fit(train))
    with tree_parts(parts_of(_rows(spark).repartition(8), COLUMNS), COLUMNS) as (ready, _):
        rows, weight = ready.weighted()
        learn.holdout_grid(learn.boosting("indexedFeatures", 32, weight=weight), {"maxIter": [1], "maxDepth": [1]}, rows, ready.val, bins=32)
    # One fit has all cores to itself.
    assert rows.coalesce(spark.sparkContext.defaultParallelism).rdd.getNumPartitions() == used[0] <= spark.sparkContext.defaultParallelism
