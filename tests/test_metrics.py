import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

from leadtime.operators import metrics
from leadtime.operators.profile import correlations, five_numbers, histograms
from leadtime.operators.running import running_totals


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, label double")


def test_areas_agree_with_the_evaluator(spark):
    rng = random.Random(1)
    # Adding 0.0 makes -0.0 and 0.0 one score, as grouping does; the evaluator keeps them apart.
    rows = [(round(rng.gauss(y, 1.5), 1) + 0.0, float(y)) for y in (rng.random() < 0.3 for _ in range(2000))]
    df = scores(spark, rows)
    got = metrics.curve_areas(df).first()
    exact = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    for name, value in (("areaUnderROC", got.auroc), ("areaUnderPR", got.aupr)):
        assert value == pytest.approx(exact.evaluate(df, {exact.metricName: name}), abs=1e-12)


@pytest.mark.parametrize(
    "rows, auroc",
    [
        ([(0.9, 1.0), (0.8, 1.0), (0.2, 0.0)], 1.0),
        ([(0.1, 1.0), (0.8, 0.0), (0.2, 0.0)], 0.0),
        ([(0.5, 1.0), (0.5, 0.0), (0.5, 0.0)], 0.5),
        ([(0.5, 1.0), (0.4, 1.0)], None),
        ([(0.5, 0.0)], None),
    ],
)
def test_areas_at_the_extremes(spark, rows, auroc):
    assert metrics.curve_areas(scores(spark, rows)).first().auroc == auroc


def test_curve_points(spark):
    df = scores(spark, [(3.0, 1.0), (2.0, 0.0), (2.0, 1.0), (1.0, 0.0)])
    points = {r.threshold: (r.fpr, r.tpr, r.recall, r.precision) for r in metrics.curve_points(df).collect()}
    assert points == {3.0: (0, 0.5, 0.5, 1), 2.0: (0.5, 1, 1, pytest.approx(2 / 3)), 1.0: (1, 1, 1, 0.5)}


def test_class_metrics_agree_with_the_evaluator(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(
        [(float(rng.random() < 0.4), float(rng.random() < 0.3)) for _ in range(500)], "prediction double, label double"
    )
    per_class = {r["class"]: r for r in metrics.class_metrics(df).collect()}
    for name, column in (("precisionByLabel", "precision"), ("recallByLabel", "recall"), ("fMeasureByLabel", "f1")):
        for label in (0.0, 1.0):
            evaluator = MulticlassClassificationEvaluator(metricName=name, metricLabel=label)
            assert per_class[label][column] == pytest.approx(evaluator.evaluate(df))
    right = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)
    assert metrics.accuracy(df).first().accuracy == pytest.approx(right)
    recall0 = per_class[0.0].recall
    assert metrics.false_positive_rate(df).first().fpr == pytest.approx(1 - recall0)
    assert metrics.false_positives(df).count() == df.where("label = 0 and prediction = 1").count()


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(0, 0)], "prediction int, label int")
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion(df).collect()}
    assert cells == {(0.0, 0.0): 1, (0.0, 1.0): 0, (1.0, 0.0): 0, (1.0, 1.0): 0}
    assert {r["class"]: r.precision for r in metrics.class_metrics(df).collect()} == {0.0: 1.0, 1.0: 0.0}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_many_slices(spark, descending):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(7)
        rows = [(rng.choice(["a", "b", None]), v, rng.randrange(9), 1) for v in range(700)]
        df = spark.createDataFrame(rows, "g string, v int, n int, m int").repartition(5)
        got = running_totals(df, "v", ["n", "m"], ["g"], descending=descending).collect()
        whole = running_totals(df, "v", ["n"], descending=descending).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ordered = sorted(rows, key=lambda r: r[1], reverse=descending)
    sums, total, expected, expected_whole = {}, 0, {}, {}
    for g, v, n, m in ordered:
        a, b = sums.get(g, (0, 0))
        sums[g] = (a + n, b + m)
        total += n
        expected[v], expected_whole[v] = sums[g], total
    assert {r.v: (r.run_n, r.run_m) for r in got} == expected
    assert {r.v: r.run_n for r in whole} == expected_whole


def test_five_numbers(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, None]), rng.choice([None, 1.0, 2.5, rng.random()]), rng.randrange(50)) for _ in range(401)]
    got = five_numbers(spark.createDataFrame(rows, "y int, a double, b int"), ["a", "b"], "y").collect()
    assert len(got) == 6
    for r in got:
        values = [row[1] if r.column == "a" else row[2] for row in rows if row[0] == r.y]
        values = [v for v in values if v is not None]
        expected = np.percentile(values, [0, 25, 50, 75, 100])
        assert [r.min, r.q1, r.median, r.q3, r.max] == pytest.approx(list(expected))


def test_histograms(spark):
    values = [0.0, 0.1, 0.5, 0.99, 1.0, 1.0]
    df = spark.createDataFrame([(v, 7) for v in values] + [(None, 7)], "a double, c int")
    got = histograms(df, ["a", "c"], 4).orderBy("bin").collect()
    counts = {c: [r.n for r in got if r.column == c] for c in ("a", "c")}
    assert counts["a"] == list(np.histogram(values, 4)[0])
    assert counts["c"] == list(np.histogram([7] * 7, 4)[0])
    edges = np.histogram([7] * 7, 4)[1]
    assert [r.lower for r in got if r.column == "c"] == pytest.approx(list(edges[:-1]))


def test_correlations_skip_missing_pairs(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 5.0, 0.0), (4.0, None, 5.0)]
    got = {(r.left, r.right): r.corr for r in correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1])
    assert got[("a", "c")] == pytest.approx(np.corrcoef([2, 3, 4], [1, 0, 5])[0, 1])


def test_areas_of_thousands_of_millions_of_rows(spark, monkeypatch):
    counts = spark.createDataFrame(
        [(0.9, 3_000_000_000, 1_000_000_000, 3_000_000_000, 1_000_000_000), (0.1, 2_000_000_000, 5_000_000_000, 5_000_000_000, 6_000_000_000)],
        "threshold double, pos long, neg long, run_pos long, run_neg long",
    )
    monkeypatch.setattr(metrics, "threshold_counts", lambda *_: counts)
    row = metrics.curve_areas(None).first()
    assert row.positives == 5_000_000_000 and row.negatives == 6_000_000_000
    assert row.auroc == pytest.approx((1 * 3 / 2 + 5 * (3 + 5) / 2) / 30)
    assert row.aupr == pytest.approx((3 * 0.75 + 2 * (0.75 + 5 / 11) / 2) / 5)
