"""Quality metrics over events as a scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import SCORED_SQL, query, scored_events
from leadtime.operators import metrics
from leadtime.operators.ranking import top

_CURVE_SQL = f"""
WITH s AS ({SCORED_SQL}),
g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score),
c AS (SELECT score AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
      WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    f"""{_CURVE_SQL}
SELECT CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives,
       round(sum(CAST(neg AS DOUBLE) * (tp - pos + tp) / 2) / (max(p) * max(n)), 9) AS auroc FROM c"""
)
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve_areas(scored_events(spark, sf_dir)).select(
        "positives", "negatives", F.round("auroc", 9).alias("auroc")
    )


@query(
    f"""{_CURVE_SQL},
d AS (SELECT threshold, tp / p AS recall, tp / (tp + fp) AS precision FROM c),
k AS (SELECT recall - lag(recall, 1, 0) OVER w AS step, precision,
             coalesce(lag(precision) OVER w, precision) AS before FROM d WINDOW w AS (ORDER BY threshold DESC))
SELECT round(sum(step * (precision + before) / 2), 9) AS aupr FROM k"""
)
def aupr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve_areas(scored_events(spark, sf_dir)).select(F.round("aupr", 9).alias("aupr"))


@query(f"{_CURVE_SQL} SELECT threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.curve_points(scored_events(spark, sf_dir))
    return points.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    f"{_CURVE_SQL} SELECT threshold, round(tp / p, 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM c"
)
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.curve_points(scored_events(spark, sf_dir))
    return points.select("threshold", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


_CONFUSION_SQL = f"""
WITH s AS ({SCORED_SQL}),
m AS (SELECT a AS actual, p AS predicted,
             (SELECT count(*) FROM s WHERE label = a AND prediction = p) AS n
      FROM (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS x(a),
           (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS y(p))"""


@query(f"{_CONFUSION_SQL} SELECT * FROM m", name="confusion")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored_events(spark, sf_dir))


@query(
    f"""{_CONFUSION_SQL},
k AS (SELECT actual AS class, n AS hit,
             (SELECT sum(n) FROM m WHERE predicted = x.actual) AS called,
             (SELECT sum(n) FROM m WHERE m.actual = x.actual) AS in_class FROM m x WHERE actual = predicted)
SELECT class, round(hit / called, 9) AS precision, round(hit / in_class, 9) AS recall,
       round(2 * hit / (called + in_class), 9) AS f1 FROM k"""
)
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_class = metrics.class_metrics(scored_events(spark, sf_dir))
    return per_class.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"SELECT round(avg(CAST(label = prediction AS INTEGER)), 9) AS accuracy FROM ({SCORED_SQL})")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(scored_events(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    f"""
SELECT round(count(*) FILTER (label = 0 AND prediction = 1) / count(*) FILTER (label = 0), 9) AS fpr
FROM ({SCORED_SQL})""",
    name="fpr",
)
def false_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.false_positive_rate(scored_events(spark, sf_dir)).withColumn("fpr", F.round("fpr", 9))


@query(
    f"""
SELECT event_id, label, score, prediction FROM ({SCORED_SQL}) WHERE label = 0 AND prediction = 1
ORDER BY score DESC, event_id LIMIT 10""",
    name="fp_sample",
)
def false_positive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = metrics.false_positives(scored_events(spark, sf_dir))
    return top(wrong.select("event_id", "label", "score", "prediction"), [F.desc("score"), F.asc("event_id")], 10)
