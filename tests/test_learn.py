import random
from collections import Counter

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array

from leadtime.operators import indexing, learn
from leadtime.operators.metrics import curve_areas, scored
from leadtime.plans.training import Columns, explore, parts_of, train_boosting
from leadtime.sources.stages import load_model, save_model

COLUMNS = Columns(categoricals=["c"], numericals=["x", "noise"], outcome="y", time="t")


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        x, c = rng.gauss(0, 1), rng.choice("aab")
        y = int(x + (0.8 if c == "b" else 0) + rng.gauss(0, 0.5) > 1)
        rows.append((i, c if i < 590 else "new", x, rng.gauss(0, 1), y))
    return spark.createDataFrame(rows, "t bigint, c string, x double, noise double, y int").repartition(2).cache()


def test_category_index_by_frequency_then_name_and_unseen_last(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "c string")
    other = spark.createDataFrame([("c",), ("a",), ("b",), ("z",), (None,)], "c string")
    model = learn.category_indexer(["c"]).fit(df)
    assert [r.c_idx for r in model.transform(other).collect()] == [0, 1, 2, 3, 3]
    slots = learn.one_hot(["c"]).transform(model.transform(other)).select(vector_to_array("features").alias("v")).collect()
    assert [r.v for r in slots] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0]]


@pytest.mark.parametrize("broadcast", [200_000, 10])
def test_levels_are_indexed_as_the_indexer_of_spark_does(spark, monkeypatch, broadcast):
    """Broadcast and shuffled level tables give what ``StringIndexer`` gives, for a hot level, ties, null and unseen levels."""
    monkeypatch.setattr(indexing, "BROADCAST_ROWS", broadcast)
    df = spark.range(3000).selectExpr("cast(if(id < 1500, 7, id % 700) as string) as c", "id % 3 as d")
    other = df.union(spark.sql("SELECT cast(null AS string), 1L UNION ALL SELECT 'unseen', 9L"))
    theirs = StringIndexer(inputCols=["c", "d"], outputCols=["c_idx", "d_idx"], handleInvalid="keep").fit(df)
    ours = learn.category_indexer(["c", "d"]).fit(df)
    assert ours.getSizes() == [len(labels) for labels in theirs.labelsArray]
    assert [r.level for r in ours.levels(spark).where("at = 0").orderBy("idx").collect()] == list(theirs.labelsArray[0])
    rows = [Counter(map(tuple, m.transform(other).select("c", "d", "c_idx", "d_idx").collect())) for m in (ours, theirs)]
    assert rows[0] == rows[1]
    assert [r.level for r in learn.level_table(df, "c").orderBy("idx").collect()] == list(theirs.labelsArray[0])


def test_no_level_reaches_the_driver(spark, tmp_path):
    """Half a million levels: what the fitted stages and the schema hold is a few hundred bytes, also after a round trip."""
    df = spark.range(500_000).selectExpr("concat('level-', id) as c", "cast(id as double) as x")
    model = Pipeline(stages=[learn.category_indexer(["c"]), learn.one_hot(["c"], ["x"])]).fit(df)
    save_model(model, str(tmp_path), "wide")
    for stages in (model, load_model(PipelineModel, str(tmp_path), "wide")):
        assert "level-" not in str([s.extractParamMap() for s in stages.stages])
        out = stages.transform(df)
        assert len(out.schema.json()) < 2000
        assert stages.stages[0].getSizes() == [500_000]
        one = out.where("c = 'level-77'").select("c_idx", "features").first()
        assert (one.features.size, list(one.features.indices), list(one.features.values)) == (500_001, [int(one.c_idx), 500_000], [1.0, 77.0])


def test_slots_equal_those_of_the_encoder_of_spark(spark):
    df = spark.createDataFrame([("b", "x", 1.0), ("a", "x", 0.0), ("c", None, 2.5), ("c", "y", -1.0)], "c string, d string, n double")
    unseen = df.union(spark.sql("SELECT 'z', 'y', 4D"))
    theirs = Pipeline(stages=[
        StringIndexer(inputCols=["c", "d"], outputCols=["ci", "di"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["ci", "di"], outputCols=["cv", "dv"]),
        VectorAssembler(inputCols=["cv", "dv", "n"], outputCol="theirs"),
    ]).fit(df)
    ours = Pipeline(stages=[learn.category_indexer(["c", "d"]), learn.one_hot(["c", "d"], ["n"], "ours")]).fit(df)
    both = ours.transform(theirs.transform(unseen)).select(vector_to_array("theirs").alias("t"), vector_to_array("ours").alias("o")).collect()
    assert len(both) == 5 and all(r.t == r.o for r in both)
    names = {r.idx: r.name for r in indexing.slot_names(spark, ours.stages[0], ["n"]).collect()}
    assert names == {0: "c_class_c", 1: "c_class_a", 2: "c_class_b", 3: "d_class_x", 4: "d_class_y", 5: "n"}
    assert indexing.slot_starts(ours.stages[0]) == {"c": 0, "d": 3}


def test_null_numbers_are_an_error(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "c string, x double")
    with pytest.raises(Exception):
        learn.linear_features(["c"], ["x"]).fit(df)
    with pytest.raises(Exception):
        learn.linear_features(["c"], ["x"]).fit(df.fillna({"x": float("nan")}))


def test_labels(spark):
    df = spark.createDataFrame([(1,), (1,), (0,)], "y int")
    assert [r.label for r in learn.with_label(df, "y").collect()] == [1.0, 1.0, 0.0]
    assert [r.label for r in learn.label_indexer("y").fit(df).transform(df).collect()] == [0.0, 0.0, 1.0]


def test_only_training_rows_are_oversampled(features):
    counts = {}
    for mode in ("train", "all", "none"):
        parts = parts_of(features, COLUMNS, oversample=mode)
        counts[mode] = tuple(p.count() for p in (parts.train, parts.val, parts.test))
    assert sum(counts["none"]) == 600
    assert counts["train"][0] > counts["none"][0] and counts["train"][1:] == counts["none"][1:]
    assert all(a > b for a, b in zip(counts["all"], counts["none"]))
    with pytest.raises(ValueError):
        parts_of(features, COLUMNS, oversample="test")


def test_bins_hold_the_largest_category(spark):
    df = spark.createDataFrame([(str(i), 1.0) for i in range(50)], "c string, x double")
    indexed = learn.category_indexer(["c"]).fit(df).transform(df)
    vectors = learn.tree_features(["c"], ["x"], "f").transform(indexed)
    assert learn.max_bins(vectors, "f") == 51
    assert learn.max_bins(vectors, "f", at_least=100) == 100
    assert [a["name"] for a in learn.vector_attributes(vectors, "f")] == ["c_idx", "x"]


def test_l1_keeps_what_matters(spark, features):
    parts = parts_of(features, COLUMNS)
    prepared = learn.linear_features(["c"], ["x", "noise"]).fit(parts.train)
    ready = parts.through(prepared)
    slicer, lasso = learn.l1_slicer(ready.train, strength=0.05)
    names = {r.idx: r.name for r in indexing.slot_names(spark, prepared.stages[0], ["x", "noise"]).collect()}
    kept = {names[i] for i in slicer.getIndices()}
    assert "x" in kept and "noise" not in kept
    width = slicer.transform(ready.val).select(vector_to_array("reducedScaledFeatures").alias("v")).first().v
    assert len(width) == len(kept)
    with pytest.raises(ValueError):
        learn.l1_slicer(ready.train, strength=50.0)


def test_grid_order_and_first_maximum():
    assert learn.combinations_of({"a": [1, 2], "b": [3, 4]}) == [
        {"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4},
    ]
    trials = [learn.Trial({"n": i}, None, auroc, 0.0) for i, auroc in enumerate([0.5, 0.7, 0.7])]
    assert learn.best(trials).params == {"n": 1}
    assert learn.best([learn.Trial({"n": 0}, None, None, None), *trials]).params == {"n": 1}


def test_areas_of_all_models_come_from_one_scan(spark, features):
    parts = parts_of(features, COLUMNS, oversample="none")
    ready = parts.through(learn.linear_features(["c"], ["x", "noise"]).fit(parts.train))
    train, val = (p.select("scaledFeatures", "label").cache() for p in (ready.train, ready.val))
    trials = learn.holdout_grid(learn.logistic("scaledFeatures"), {"regParam": [0.0, 0.1, 5.0]}, train, val)
    evaluator = BinaryClassificationEvaluator(numBins=0)
    for t in trials:
        one = curve_areas(scored(t.model.transform(val))).first()
        assert (t.auroc, t.aupr) == (pytest.approx(one.auroc), pytest.approx(one.aupr))
        assert t.auroc == pytest.approx(evaluator.evaluate(t.model.transform(val)))
    models = {f"m{i}": t.model for i, t in enumerate(trials)}
    # Jobs do not grow with the models.
    jobs = {}
    for n in (1, 3):
        spark.sparkContext.setJobGroup(f"areas{n}", "count")
        found = learn.areas(dict(list(models.items())[:n]), {"train": train, "val": val})
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"areas{n}"))
        assert len(found) == 2 * n
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[3]
    # A part without rows of one class has no areas.
    assert learn.areas(models, {"val": val.where("label = 0")}, "label")["val", "m0"] == (None, None)
    assert learn.areas(models, {"val": val.limit(0)}, "label")["val", "m0"] == (None, None)


def test_exploration(spark, features, monkeypatch):
    monkeypatch.setattr(learn, "LOGISTIC_GRID", {"regParam": [0.01, 1.0]})
    monkeypatch.setattr(learn, "FOREST_GRID", {"maxDepth": [2]})
    monkeypatch.setattr(learn, "BOOSTING_GRID", {"maxDepth": [2], "stepSize": [0.3]})
    exploration = explore(parts_of(features, COLUMNS), COLUMNS)
    scores = {r.model: r for r in exploration.scores.collect()}
    assert set(scores) == {"baseline logistic", "tuned logistic", "forest", "boosting"}
    assert all(r.test_auroc > 0.8 for r in scores.values())
    for kind, trials in exploration.trials.items():
        table = learn.trial_table(spark, trials).collect()
        assert sum(r.best for r in table) == 1
        assert all(r.val_auroc <= t.auroc for t in [learn.best(trials)] for r in table), kind


def test_final_model_survives_storage_and_repeats_itself(spark, features, monkeypatch, tmp_path):
    monkeypatch.setattr(learn, "BOOSTING_GRID", {"maxDepth": [2, 3], "stepSize": [0.3]})
    parts = parts_of(features, COLUMNS)
    final, again = train_boosting(parts, COLUMNS), train_boosting(parts, COLUMNS)
    assert [t.auroc for t in final.trials] == [t.auroc for t in again.trials]
    save_model(final.model, str(tmp_path), "boosting")
    loaded = load_model(PipelineModel, str(tmp_path), "boosting").transform(parts.test)

    def rows(df):
        return sorted((r.x, r.prediction) for r in df.select("x", "prediction").collect())

    assert rows(loaded) == rows(final.predictions) and len(rows(loaded)) > 0
    importances = final.model.stages[-1].featureImportances.toArray()
    table = learn.importances(spark, importances, final.predictions, "features").orderBy("score", ascending=False)
    assert table.first().name == "x"
