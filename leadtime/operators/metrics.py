"""Quality of scores and predictions, as aggregates over the scored table.

Columns: ``label`` is 0 or 1, ``score`` a number that grows with the chance of 1, ``prediction``
a class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtime.operators.running import running_totals


def scored(predictions: DataFrame, vector: str = "rawPrediction", score: str = "score") -> DataFrame:
    """Add the score of class 1 from a model's vector column."""
    return predictions.withColumn(score, vector_to_array(vector)[1])


def threshold_counts(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Per distinct score, from high to low: rows of each class at it, at or above it, and in all.

    Columns ``threshold``, ``pos``, ``neg``, ``run_pos``, ``run_neg``, ``total_pos``, ``total_neg``, for each group of ``by``.
    A row counts as many as its ``weight``, a whole number, says.
    """
    is_positive = F.col(label) == 1
    if weight is None:
        pos, neg = F.count_if(is_positive), F.count_if(~is_positive)
    else:
        pos, neg = (F.sum(F.when(wanted, F.col(weight)).otherwise(0)) for wanted in (is_positive, ~is_positive))
    at = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("threshold"))
        .agg(pos.alias("pos"), neg.alias("neg"))
    )
    return running_totals(at, "threshold", ["pos", "neg"], by, descending=True)


def curve_areas(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row, or one per group of ``by``: exact ``auroc`` and ``aupr`` (trapezoids; the first precision reaches back to recall 0).

    Each trapezoid needs only the running totals of its own row, so both areas are plain sums, of
    doubles: products of counts outgrow integers at some three thousand million rows a class.
    An area without rows of one class is null. A row counts as many as its ``weight`` says.
    """
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "run_pos", "run_neg"))
    tp_before, fp_before = tp - pos, fp - neg
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp_before, tp_before + fp_before), precision)
    return (
        threshold_counts(df, score, label, by, weight)
        .groupBy(*by)
        .agg(
            F.sum("pos").alias("positives"),
            F.sum("neg").alias("negatives"),
            F.sum(neg * (tp_before + tp) / 2).alias("__roc"),
            F.sum(pos * (before + precision) / 2).alias("__pr"),
        )
        .select(
            *by,
            "positives",
            "negatives",
            F.try_divide(F.try_divide(F.col("__roc"), "positives"), "negatives").alias("auroc"),
            F.when(F.col("negatives") > 0, F.try_divide(F.col("__pr"), F.col("positives"))).alias("aupr"),
        )
    )


def curve_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per threshold: ``fpr`` and ``tpr`` of the ROC curve, ``recall`` and ``precision`` of the PR curve."""
    tp, fp = F.col("run_pos"), F.col("run_neg")
    return threshold_counts(df, score, label).select(
        "threshold",
        F.try_divide(fp, "total_neg").alias("fpr"),
        F.try_divide(tp, "total_pos").alias("tpr"),
        F.try_divide(tp, "total_pos").alias("recall"),
        (tp / (tp + fp)).alias("precision"),
    )


def confusion(
    df: DataFrame, prediction: str = "prediction", label: str = "label", classes: Sequence[float] = (0.0, 1.0)
) -> DataFrame:
    """Rows per actual and predicted class: all cells of ``classes``, empty ones too, and any other with rows."""
    every = F.array(*[F.lit(float(c)) for c in classes])
    cells = df.sparkSession.range(1).select(F.explode(every).alias("actual"), F.lit(every).alias("__p"))
    cells = cells.select("actual", F.explode("__p").alias("predicted"))
    counts = df.groupBy(
        F.col(label).cast("double").alias("actual"), F.col(prediction).cast("double").alias("predicted")
    ).agg(F.count("*").alias("n"))
    return cells.join(counts, ["actual", "predicted"], "full").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row: share of rows predicted right."""
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def class_metrics(
    df: DataFrame, prediction: str = "prediction", label: str = "label", classes: Sequence[float] = (0.0, 1.0)
) -> DataFrame:
    """Precision, recall and F1 per class; a ratio without rows below the line is 0."""
    cells = confusion(df, prediction, label, classes)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    per_actual = cells.groupBy(F.col("actual").alias("class")).agg(right.alias("hit"), F.sum("n").alias("in_class"))
    per_predicted = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    zero = F.lit(0.0)
    ratios = per_actual.join(per_predicted, "class").select(
        "class",
        F.coalesce(F.try_divide("hit", "called"), zero).alias("precision"),
        F.coalesce(F.try_divide("hit", "in_class"), zero).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return ratios.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), zero))


def false_positive_rate(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row: share of the rows of class 0 that were predicted as 1."""
    negative = F.col(label) == 0
    return df.agg(
        F.try_divide(F.count_if(negative & (F.col(prediction) == 1)), F.count_if(negative)).alias("fpr")
    )


def false_positives(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Rows of class 0 that were predicted as 1."""
    return df.where((F.col(label) == 0) & (F.col(prediction) == 1))
