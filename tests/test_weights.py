"""A row counted by weight is worth its copies, in areas, regressions and trees that draw no rows."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadtime.catalogue import learning
from leadtime.operators import learn
from leadtime.operators.metrics import curve_areas
from leadtime.plans.training import COPIES, Columns, explore, linear_parts, parts_of, tree_parts

COLUMNS = Columns(categoricals=["c"], numericals=["n"], outcome="y", time="t")


def _rows(spark) -> DataFrame:
    """Some 15 per cent are positive; the first 60 of 100 moments are the training part."""
    return spark.range(1500).select(
        (F.col("id") % 101).alias("t"), (F.col("id") * 13 % 7).cast("string").alias("c"), (F.col("id") * 37 % 89).cast("double").alias("n"),
        ((F.col("id") % 11 == 0) | (F.col("id") * 37 % 89 > 82)).cast("int").alias("y"),
    )


def test_areas_by_weight_are_areas_of_copies(spark):
    rows = [(0.9, 1, 3), (0.9, 0, 1), (0.7, 0, 2), (0.5, 1, 1), (0.5, 1, 4), (0.1, 0, 5), (None, 1, 2), (0.3, None, 2)]
    once = spark.createDataFrame(rows, "score double, label int, w bigint")
    copies = once.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "w")))
    assert curve_areas(once, weight="w").first() == curve_areas(copies).first()
    one_class = once.where("label = 1")
    assert curve_areas(one_class, weight="w").first() == curve_areas(one_class).withColumn("positives", F.lit(8)).first()


@pytest.mark.parametrize("params", [{"elasticNetParam": 0.0}, {"elasticNetParam": 0.5}, {"elasticNetParam": 1.0}])
def test_regression_by_weight_is_regression_of_copies(spark, params):
    with linear_parts(parts_of(_rows(spark), COLUMNS), COLUMNS) as (ready, _):
        rows, weight = ready.weighted()
        assert weight and rows.count() < ready.train.count()
        found = []
        for estimator, frame in ((learn.logistic("scaledFeatures", weight=weight), rows), (learn.logistic("scaledFeatures"), ready.train)):
            model = estimator.copy({estimator.regParam: 0.02, estimator.maxIter: 200, estimator.tol: 1e-12, **{estimator.getParam(k): v for k, v in params.items()}}).fit(frame)
            found.append([model.intercept, *model.coefficients.toArray()])
        assert found[0] == pytest.approx(found[1], abs=1e-5) and any(found[0][1:])
        kept = learn.l1_slicer(ready.train, strength=0.01)[0].getIndices()
        assert learn.l1_slicer(rows, strength=0.01, weight=weight)[0].getIndices() == kept


def test_tree_without_draws_by_weight_is_that_of_copies(spark):
    with tree_parts(parts_of(_rows(spark), COLUMNS), COLUMNS) as (ready, _):
        rows, weight = ready.weighted()
        scores, worth = [], []
        for estimator, frame in ((learn.forest("indexedFeatures", 32, weight=weight), rows), (learn.forest("indexedFeatures", 32), ready.train)):
            model = estimator.copy({estimator.getParam(k): v[0] for k, v in {**learning.ONE_TREE, "maxDepth": [3]}.items()}).fit(frame)
            scores.append([r.s for r in model.transform(ready.test).select(vector_to_array("probability")[1].alias("s")).collect()])
            worth.append(learn.model_scores(spark, {"m": model}, frame, ready.test, weight=COPIES).first())
    assert len(scores[0]) > 100 and scores[0] == pytest.approx(scores[1])
    assert worth[0][1:] == pytest.approx(worth[1][1:])


def test_copies_reach_only_forests_that_draw(spark, monkeypatch):
    """Regressions, boosted trees and areas get each training row once; a forest that draws rows gets the copies."""
    monkeypatch.setattr(learn, "LOGISTIC_GRID", {"regParam": [0.01]})
    monkeypatch.setattr(learn, "FOREST_GRID", {"maxDepth": [2]})
    monkeypatch.setattr(learn, "BOOSTING_GRID", {"maxDepth": [2], "stepSize": [0.3]})
    fit, scored, fits, scans = learn.fitted, learn.model_scores, [], []
    monkeypatch.setattr(learn, "fitted", lambda estimator, train: fits.append((type(estimator).__name__, train.count())) or fit(estimator, train))
    monkeypatch.setattr(learn, "model_scores", lambda s, m, train, *rest, **more: scans.append(train.count()) or scored(s, m, train, *rest, **more))
    parts = parts_of(_rows(spark), COLUMNS)
    copies, once = parts.train.count(), parts.once.count()
    explored = explore(parts, COLUMNS)
    assert once < copies and scans == [once] * 3
    assert fits == [("LogisticRegression", once)] * 2 + [("RandomForestClassifier", copies), ("GBTClassifier", once)]
    assert isinstance(explored.models["tuned logistic"], LogisticRegressionModel)
    assert isinstance(explored.models["forest"], RandomForestClassificationModel)
    assert all(r.train_auroc > 0.5 for r in explored.scores.collect())


def test_forest_fitted_after_an_observation_can_be_sent(spark):
    """However it is fitted; the test above needs this if one was used in the session before."""
    spark.range(3).observe(Observation("seen"), F.count(F.lit(1)).alias("n")).collect()
    with tree_parts(parts_of(_rows(spark), COLUMNS), COLUMNS) as (ready, _):
        model = learn.forest("indexedFeatures", 32).setNumTrees(2).fit(ready.train)
        assert not model.hasSummary and model.transform(ready.test).count() == ready.test.count()
        assert model.transform(ready.test).where("prediction is null").count() == 0
