"""Feature vectors, feature selection, model grids and importances on Spark ML.

Everything is fitted on the training part alone and with an explicit seed. What comes back to the
driver is what a model is made of: coefficients, trees, areas. Levels of categories stay in tables (``indexing``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, classification
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.operators.indexing import LevelIndexer, LevelIndexerModel, SlotAssembler, level_tables, slot_names
from leadtime.operators.metrics import curve_areas

SEED = 42


def _named(columns: Sequence[str], suffix: str) -> list[str]:
    return [c + suffix for c in columns]


def level_table(df: DataFrame, column: str) -> DataFrame:
    """``level`` as text, ``n`` and ``idx`` of every level: 0 for the most frequent, equals in order of their text."""
    return level_tables(df, [column]).drop("at")


def category_indexer(categoricals: Sequence[str]) -> LevelIndexer:
    """``<c>_idx`` per category: 0 for the most frequent level, an index of its own for unseen and null."""
    return LevelIndexer(inputCols=list(categoricals), outputCols=_named(categoricals, "_idx"))


def one_hot(categoricals: Sequence[str], numericals: Sequence[str] = (), output: str = "features") -> SlotAssembler:
    """A slot per level, none for unseen and null, then the numbers, in one sparse vector."""
    return SlotAssembler(inputCols=_named(categoricals, "_idx"), numericals=list(numericals), outputCol=output)


def label_indexer(outcome: str, label: str = "label") -> StringIndexer:
    """Outcome to 0.0, 1.0, … by falling frequency."""
    return StringIndexer(inputCol=outcome, outputCol=label)


def with_label(df: DataFrame, outcome: str, label: str = "label") -> DataFrame:
    """An outcome that is 0 or 1 already, as the double Spark ML wants."""
    return df.withColumn(label, F.col(outcome).cast("double"))


def linear_features(categoricals: Sequence[str], numericals: Sequence[str], *, center: bool = False) -> Pipeline:
    """Index, encode, assemble and scale to ``scaledFeatures``; also yields ``<c>_idx``.

    Centering makes the vectors dense, one number per encoded level and row: it is meant for numbers
    alone. Without it they stay sparse. Logistic regression with an intercept finds the same weights either way.
    """
    return Pipeline(
        stages=[
            category_indexer(categoricals),
            one_hot(categoricals, numericals),
            StandardScaler(inputCol="features", outputCol="scaledFeatures", withMean=center, withStd=True),
        ]
    )


def tree_features(categoricals: Sequence[str], numericals: Sequence[str], output: str) -> VectorAssembler:
    """Indexed categories and numbers in one vector, as trees take them."""
    return VectorAssembler(inputCols=_named(categoricals, "_idx") + list(numericals), outputCol=output)


def slot_values(df: DataFrame, column: str, slots: Mapping[str, int], keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and a number column per entry of ``slots``, each from its slot of the vector.

    The slots are sliced from the vector first, so a row costs what it has stored and not what the vector could hold.
    """
    wanted = list(dict.fromkeys(slots.values()))
    sliced = VectorSlicer(inputCol=column, outputCol="__slots", indices=wanted).transform(df)
    values = vector_to_array("__slots")
    return sliced.select(*keep, *[values[wanted.index(slot)].alias(name) for name, slot in slots.items()])


def vector_attributes(df: DataFrame, column: str) -> list[dict]:
    """The attributes of a vector column in slot order, from its metadata."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"].values()
    return sorted((a for group in groups for a in group), key=lambda a: a["idx"])


def max_bins(df: DataFrame, column: str, at_least: int = 32) -> int:
    """Bins a tree needs so that every category in the vector fits, unseen levels included."""
    return max([at_least, *(a.get("num_vals") or len(a.get("vals", ())) for a in vector_attributes(df, column))])


def l1_slicer(
    train: DataFrame,
    features: str = "scaledFeatures",
    label: str = "label",
    output: str = "reducedScaledFeatures",
    *,
    strength: float = 0.005,
    max_iter: int = 10,
    weight: str | None = None,
) -> tuple[VectorSlicer, Model]:
    """Fit an L1-penalised logistic regression; the slicer keeps the slots it gave a weight.

    Returns the slicer, for any frame with the same vectors, and the fitted model. ``weight`` as in ``logistic``.
    """
    lasso = _counted(
        LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=1.0, regParam=strength, maxIter=max_iter), weight
    ).fit(train)
    kept = [i for i, weight in enumerate(lasso.coefficients.toArray()) if weight != 0]
    if not kept:
        raise ValueError("no feature kept a weight: lower the strength")
    return VectorSlicer(inputCol=features, outputCol=output, indices=kept), lasso


def _counted(regression: LogisticRegression, weight: str | None) -> LogisticRegression:
    """A row of ``weight`` n counts as n equal rows do, given vectors scaled to unit deviation over the copies.

    Spark's deviation of weighted rows is not that of their copies, so the penalty must not be scaled by it; by the
    deviation of the copies, which is one, it is scaled already.
    """
    return regression if weight is None else regression.setWeightCol(weight).setStandardization(False)


def logistic_baseline(features: str, label: str = "label", weight: str | None = None) -> LogisticRegression:
    return _counted(LogisticRegression(featuresCol=features, labelCol=label, maxIter=10), weight)


def _without_summary(model: Model, spark: SparkSession) -> Model:
    """``model`` without its training summary.

    A summary refers to the session; once an ``Observation`` has been used in it (cleaning counts its losses that
    way), a model that still has one can no longer be sent to the executors.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(spark._jvm.scala.Option.empty())
    return model


def fitted(estimator: Estimator, train: DataFrame) -> Model:
    """The fitted model without its training summary."""
    return _without_summary(estimator.fit(train), train.sparkSession)


class RandomForestClassifier(classification.RandomForestClassifier):
    """Spark's, but its models never have a training summary, however they are fitted."""

    def _fit(self, dataset: DataFrame) -> Model:
        return _without_summary(super()._fit(dataset), dataset.sparkSession)


# Grids tried on the validation part. The parameter choices.
LOGISTIC_GRID = {"elasticNetParam": [0.0, 0.5, 1.0], "regParam": [0.01, 0.5, 1.0]}
FOREST_GRID = {"maxDepth": [2, 3, 5]}
BOOSTING_GRID = {"maxDepth": [2, 3, 5], "stepSize": [0.1, 0.3, 0.5]}


def logistic(features: str, label: str = "label", weight: str | None = None) -> LogisticRegression:
    """With ``weight``, ``features`` must be scaled to unit deviation over the rows counted by it, as ``linear_features`` does."""
    return _counted(LogisticRegression(featuresCol=features, labelCol=label, maxIter=20), weight)


def forest(features: str, bins: int, label: str = "label", seed: int = SEED, weight: str | None = None) -> RandomForestClassifier:
    """A ``weight`` stands for copies only where a forest draws no rows (``bootstrap`` off); draws would take all copies of a row or none."""
    trees = RandomForestClassifier(featuresCol=features, labelCol=label, maxBins=bins, seed=seed)
    return trees if weight is None else trees.setWeightCol(weight)


def boosting(features: str, bins: int, label: str = "label", seed: int = SEED, weight: str | None = None) -> GBTClassifier:
    """Boosted trees draw no rows, so a row of ``weight`` n counts as n equal rows do."""
    trees = GBTClassifier(
        featuresCol=features, labelCol=label, lossType="logistic", maxBins=bins, maxIter=20, seed=seed
    )
    return trees if weight is None else trees.setWeightCol(weight)


def scored_by_all(models: Mapping[str, Model], frame: DataFrame, label: str = "label", carried: Sequence[str] = ()) -> DataFrame:
    """``model``, ``score`` of class 1 and ``label``, a row per row of ``frame`` and model, in one pass over ``frame``."""
    for i, model in enumerate(models.values()):
        # Nothing but the raw score of a model is computed.
        only = {model.getParam("rawPredictionCol"): f"__raw{i}", model.getParam("probabilityCol"): "", model.getParam("predictionCol"): ""}
        frame = model.copy(only).transform(frame)
    scores = [F.struct(F.lit(name).alias("model"), vector_to_array(f"__raw{i}")[1].alias("score")) for i, name in enumerate(models)]
    return frame.select(*carried, F.col(label).alias("label"), F.inline(F.array(*scores)))


def areas(
    models: Mapping[str, Model], parts: Mapping[str, DataFrame], label: str = "label", weight: str | None = None
) -> dict[tuple[str, str], tuple[float | None, float | None]]:
    """Exact AUROC and AUPR of every model on every part, by (part, model): all of them from one scan of each part.

    An area is None where a class has no rows. Scores are counted per model before they are sorted; the sort
    and its running totals are shared by all models and parts. In a part that has the column ``weight``, a row counts as many.
    """
    tagged = []
    for part, frame in parts.items():
        times = F.col(weight) if weight in frame.columns else F.lit(1)
        marked = frame.withColumns({"part": F.lit(part), "__times": times.cast("bigint")})
        tagged.append(scored_by_all(models, marked, label, ["part", "__times"]))
    found = curve_areas(reduce(DataFrame.union, tagged), by=["part", "model"], weight="__times").collect()
    whole = dict.fromkeys(product(parts, models), (None, None))
    return {**whole, **{(r["part"], r["model"]): (r["auroc"], r["aupr"]) for r in found}}


@dataclass
class Trial:
    params: dict[str, Any]
    model: Model
    auroc: float | None
    aupr: float | None


def combinations_of(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations, the last parameter varying fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


# Rows that fits going on side by side may keep for each core: a tree's rows take some 200 to 300 bytes each.
FIT_ROWS_PER_CORE = 3_000_000


def fits_at_once(rows: int, cores: int) -> int:
    """How many fits over ``rows`` may go on side by side, one at least, so that what they keep stays in memory."""
    return max(1, FIT_ROWS_PER_CORE * cores // max(1, rows))


# Rows a task of boosting should have for each bin of the widest feature.
ROWS_PER_BIN = 64


def boosting_tasks(rows: int, bins: int, cores: int, at_once: int) -> int:
    """Into how many tasks a round of boosting is worth splitting.

    Every task hands on sums for all bins, whatever its rows, so with many bins and few rows it is the tasks that
    cost. Fits that go on side by side share the cores.
    """
    return max(-(-cores // at_once), rows // (ROWS_PER_BIN * bins))


def holdout_grid(
    estimator: Estimator,
    grid: Mapping[str, Sequence[Any]],
    train: DataFrame,
    val: DataFrame,
    *,
    label: str = "label",
    parallelism: int | None = None,
    bins: int | None = None,
) -> list[Trial]:
    """Fit every combination on ``train``, score all on one pass over ``val``. Persist both before the call.

    A few combinations are fitted at a time, so that tasks of one fill the gaps of another. Every fit keeps its own
    copy of the rows, so of large tables it is as many as ``fits_at_once`` says. ``bins``, for boosted trees, bounds
    the tasks of a fit by ``boosting_tasks``; since they are few then, more fits go on at a time.
    """
    combinations = combinations_of(grid)
    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    parallelism = min(parallelism or (3 if bins is None else 9), fits_at_once(rows, cores), len(combinations))
    if bins is not None:
        train = train.coalesce(boosting_tasks(rows, bins, cores, parallelism))

    def fit(params: dict[str, Any]) -> Model:
        return fitted(estimator.copy({estimator.getParam(k): v for k, v in params.items()}), train)

    with ThreadPoolExecutor(parallelism) as pool:
        models = list(pool.map(inheritable_thread_target(SparkSession.active())(fit), combinations))
    worth = areas({str(i): m for i, m in enumerate(models)}, {"val": val}, label)
    return [Trial(params, model, *worth["val", str(i)]) for i, (params, model) in enumerate(zip(combinations, models))]


def best(trials: Sequence[Trial]) -> Trial:
    """The first trial with the highest AUROC; one without comes last."""
    return max(trials, key=lambda t: -1.0 if t.auroc is None else t.auroc)


def trial_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """One row per trial: its parameters as text, its areas, whether it is the best."""
    chosen = best(trials)
    rows = [
        (", ".join(f"{k}={v}" for k, v in t.params.items()), t.auroc, t.aupr, t is chosen)
        for t in trials
    ]
    return spark.createDataFrame(rows, "params string, val_auroc double, val_aupr double, best boolean")


def model_scores(
    spark: SparkSession, models: Mapping[str, Model], train: DataFrame, test: DataFrame, label: str = "label", weight: str | None = None
) -> DataFrame:
    """One row per model: exact areas on the training and the test part, of which either may have a ``weight`` column."""
    worth = areas(models, {"train": train, "test": test}, label, weight)
    rows = [(name, *worth["train", name], *worth["test", name]) for name in models]
    return spark.createDataFrame(
        rows, "model string, train_auroc double, train_aupr double, test_auroc double, test_aupr double"
    )


def importances(spark: SparkSession, scores: Iterable[float], df: DataFrame, column: str) -> DataFrame:
    """Slot, name and score of every vector slot."""
    by_slot = list(scores)
    rows = [(a["idx"], a["name"], float(by_slot[a["idx"]])) for a in vector_attributes(df, column)]
    return spark.createDataFrame(rows, "idx int, name string, score double")


def slot_weights(spark: SparkSession, weights: Iterable[float], indexer: LevelIndexerModel, numericals: Sequence[str]) -> DataFrame:
    """Slot, name and weight of every slot of ``linear_features``; names come from the level table by a join."""
    values = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "idx int, score double")
    return slot_names(spark, indexer, numericals).join(values, "idx")
