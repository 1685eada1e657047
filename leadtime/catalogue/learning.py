"""Feature vectors, model grids and whole flows.

The learning table: one row per line, costly if quantity times price is above twice the average,
cut by ship date. Trained models have no SQL twin; what goes into them has.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.catalogue.registry import EVENTS_SQL, query, table, timed_events
from leadtime.functions.clock import epoch_seconds
from leadtime.functions.cyclic import cyclic
from leadtime.operators import learn, metrics
from leadtime.operators.asof import asof_bucketed
from leadtime.operators.balance import oversample_minority
from leadtime.operators.history import previous_outcome
from leadtime.operators.indexing import slot_starts
from leadtime.operators.levels import fold_rare_levels
from leadtime.operators.split import time_split
from leadtime.plans.training import Columns, Parts, explore, linear_parts, parts_of, train_boosting, tree_parts
from leadtime.session import query_root
from leadtime.sources.stages import load_model, restage, save_model

LINE_COLUMNS = Columns(
    categoricals=["line", "l_linestatus", "supplier"],
    numericals=["l_quantity", "l_extendedprice", "l_discount", "l_tax", "month_sin", "month_cos"],
    outcome="costly",
    time="t",
)


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    month_sin, month_cos = cyclic(F.month("l_shipdate"), "MTH")
    lineitem = table(spark, sf_dir, "lineitem")
    amount = F.col("l_quantity") * F.col("l_extendedprice")
    lines = lineitem.select(
        F.col("l_linenumber").cast("string").alias("line"),
        "l_linestatus",
        F.floor(F.col("l_quantity") / 10).cast("string").alias("band"),
        F.col("l_suppkey").cast("string").alias("supplier_key"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        month_sin.alias("month_sin"),
        month_cos.alias("month_cos"),
        epoch_seconds(F.col("l_shipdate")).alias("t"),
        (amount > 2 * lineitem.agg(F.avg(amount)).scalar()).cast("int").alias("costly"),
    )
    return fold_rare_levels(lines, "supplier_key", "supplier", "RARE").drop("supplier_key")


def line_parts(spark: SparkSession, sf_dir: str) -> Parts:
    root = query_root(spark)
    features = restage(line_features(spark, sf_dir), root, "lines", "proposed_features")
    return parts_of(features, LINE_COLUMNS).staged(root, "lines")


@query(
    """
SELECT l_linenumber AS level, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(l_linenumber AS VARCHAR)) - 1 AS DOUBLE)
       AS level_idx, count(*) AS n FROM lineitem GROUP BY l_linenumber"""
)
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_linenumber").select(F.col("l_linenumber").cast("string").alias("level"))
    indexed = learn.category_indexer(["level"]).fit(lines).transform(lines)
    return indexed.groupBy(F.col("level").cast("int").alias("level"), "level_idx").agg(F.count("*").alias("n"))


@query(
    """
WITH i AS (SELECT l_returnflag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS idx
           FROM lineitem GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, CAST(idx = 0 AS INTEGER) AS slot0, CAST(idx = 1 AS INTEGER) AS slot1,
       CAST(idx = 2 AS INTEGER) AS slot2 FROM lineitem JOIN i USING (l_returnflag)"""
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level has a slot; only unseen and null have none."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    indexed = learn.category_indexer(["l_returnflag"]).fit(lines).transform(lines)
    encoded = learn.one_hot(["l_returnflag"]).transform(indexed)
    slots = vector_to_array("features")
    return encoded.select("l_orderkey", "l_linenumber", *[slots[i].cast("int").alias(f"slot{i}") for i in range(3)])


@query(
    """
SELECT l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS price
FROM lineitem"""
)
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    scaled = learn.linear_features([], ["l_quantity", "l_extendedprice"], center=True).fit(lines).transform(lines)
    slots = vector_to_array("scaledFeatures")
    return scaled.select(
        "l_orderkey",
        "l_linenumber",
        F.round(slots[0], 6).alias("quantity"),
        F.round(slots[1], 6).alias("price"),
    )


@query(
    """
WITH y AS (SELECT doc_id, toxic FROM labels),
i AS (SELECT toxic, row_number() OVER (ORDER BY count(*) DESC, CAST(toxic AS VARCHAR)) - 1 AS idx FROM y GROUP BY toxic)
SELECT doc_id, toxic, CAST(idx AS DOUBLE) AS by_frequency, CAST(toxic AS DOUBLE) AS label FROM y JOIN i USING (toxic)"""
)
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by falling frequency, and as they are."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return learn.with_label(learn.label_indexer("toxic", "by_frequency").fit(labels).transform(labels), "toxic")


_LINES_SQL = """
a AS (SELECT avg(l_quantity * l_extendedprice) AS mean FROM lineitem),
f AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
cut AS (SELECT quantile_disc(n, 0.8) AS cut FROM f),
x AS (SELECT CAST(l_linenumber AS VARCHAR) AS line, l_linestatus, CAST(CAST(floor(l_quantity / 10) AS INTEGER) AS VARCHAR) AS band, l_quantity, l_extendedprice, l_discount, l_tax,
             CASE WHEN n <= cut THEN 'RARE' ELSE CAST(l.l_suppkey AS VARCHAR) END AS supplier,
             epoch_us(l_shipdate) // 1000000 AS t, CAST(l_quantity * l_extendedprice > 2 * mean AS INTEGER) AS costly
      FROM lineitem l JOIN f ON l.l_suppkey = f.l_suppkey, cut, a),
b AS (SELECT min(t) AS first, max(t) AS last FROM x),
s AS (SELECT x.*, CASE WHEN t <= first + floor((last - first) * CAST(0.6 AS DOUBLE)) THEN 'train'
                       WHEN t <= first + floor((last - first) * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part
      FROM x, b),
r AS (SELECT greatest(1, count(*) FILTER (costly = 0) // count(*) FILTER (costly = 1)) AS times FROM s WHERE part = 'train'),
p AS (SELECT s.*, unnest(range(CASE WHEN part = 'train' AND costly = 1 THEN times ELSE 1 END)) AS copy FROM s, r)"""


@query(
    f"""
WITH {_LINES_SQL},
li AS (SELECT line, row_number() OVER (ORDER BY count(*) DESC, line) - 1 AS i FROM p WHERE part = 'train' GROUP BY line),
su AS (SELECT supplier, row_number() OVER (ORDER BY count(*) DESC, supplier) - 1 AS i FROM p WHERE part = 'train' GROUP BY supplier),
d AS (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_extendedprice) AS e,
             stddev_samp(CASE WHEN li.i = 0 THEN 1.0 ELSE 0.0 END) AS line
      FROM p JOIN li USING (line) WHERE part = 'train')
SELECT part, costly AS label, CAST(li.i AS INTEGER) AS line_idx, CAST(su.i AS INTEGER) AS supplier_idx,
       round(l_quantity / d.q, 4) AS quantity, round(l_extendedprice / d.e, 4) AS price,
       round(CASE WHEN li.i = 0 THEN 1.0 ELSE 0.0 END / d.line, 4) AS first_line
FROM p LEFT JOIN li USING (line) LEFT JOIN su USING (supplier), d"""
)
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, indexed, encoded, assembled and scaled as the training part says; some slots of the vectors."""
    parts = line_parts(spark, sf_dir)
    prepared = learn.linear_features(LINE_COLUMNS.categoricals, LINE_COLUMNS.numericals).fit(parts.train)
    ready = parts.through(prepared)
    indexer = prepared.stages[0]
    at = {name: sum(indexer.getSizes()) + i for i, name in enumerate(LINE_COLUMNS.numericals)}
    slots = {"quantity": at["l_quantity"], "price": at["l_extendedprice"], "first_line": slot_starts(indexer)["line"]}
    named = [
        learn.slot_values(frame, "scaledFeatures", slots, ["label", "line_idx", "supplier_idx"]).select(
            F.lit(part).alias("part"),
            F.col("label").cast("int").alias("label"),
            F.col("line_idx").cast("int").alias("line_idx"),
            F.col("supplier_idx").cast("int").alias("supplier_idx"),
            *[F.round(name, 4).alias(name) for name in slots],
        )
        for part, frame in (("train", ready.train), ("val", ready.val), ("test", ready.test))
    ]
    return named[0].union(named[1]).union(named[2])


def _between(*columns: str) -> F.Column:
    """Whether all of these lie between 0 and 1."""
    return reduce(and_, [F.col(c).between(0, 1) for c in columns])


def _part_sizes(parts: Parts) -> list[F.Column]:
    """Rows of the training part, rows and positives of the validation part."""
    positive = F.count_if(F.col("label") == 1)
    return [
        parts.train.agg(F.count("*")).scalar().alias("train_rows"),
        parts.val.agg(F.count("*")).scalar().alias("val_rows"),
        parts.val.agg(positive).scalar().alias("val_positives"),
    ]


_SIZES_SQL = """count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'val') AS val_rows,
       count(*) FILTER (part = 'val' AND costly = 1) AS val_positives"""

# Slots of the encoded vector: levels by frequency in the training part, then the numbers.
_SLOTS_SQL = f"""
WITH {_LINES_SQL},
o AS (SELECT 0 AS c, 'line_class_' || line AS name, row_number() OVER (ORDER BY count(*) DESC, line) AS i
      FROM p WHERE part = 'train' GROUP BY line
      UNION ALL
      SELECT 1, 'l_linestatus_class_' || l_linestatus, row_number() OVER (ORDER BY count(*) DESC, l_linestatus)
      FROM p WHERE part = 'train' GROUP BY l_linestatus
      UNION ALL
      SELECT 2, 'supplier_class_' || supplier, row_number() OVER (ORDER BY count(*) DESC, supplier)
      FROM p WHERE part = 'train' GROUP BY supplier
      UNION ALL
      SELECT 3, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'month_sin', 'month_cos']), unnest(range(6)))
SELECT CAST(row_number() OVER (ORDER BY c, i) - 1 AS INTEGER) AS idx, name, true AS kept_if_weighed, true AS some_kept FROM o"""


@query(_SLOTS_SQL)
def l1_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature slot, and whether the L1 penalty keeps just those it gives a weight."""
    with linear_parts(line_parts(spark, sf_dir), LINE_COLUMNS) as (ready, prepared):
        rows, weight = ready.weighted()
        slicer, lasso = learn.l1_slicer(rows, weight=weight)
    weights = learn.slot_weights(spark, lasso.coefficients.toArray(), prepared.stages[0], LINE_COLUMNS.numericals)
    kept = F.col("idx").isin(*slicer.getIndices())
    return weights.select(
        "idx", "name", ((F.col("score") != 0) == kept).alias("kept_if_weighed"), F.lit(len(slicer.getIndices()) > 0).alias("some_kept")
    )


def _grid(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The combinations in order, that exactly one is best and none better, and what they were fitted and scored on."""
    parts = line_parts(spark, sf_dir)
    trials = explore(parts, LINE_COLUMNS, [kind], score=False).trials[kind]
    tried = learn.trial_table(spark, trials)
    best_area = tried.where("best").agg(F.max("val_auroc")).scalar()
    n_best = tried.agg(F.count_if("best")).scalar()
    return tried.select(
        "params",
        _between("val_auroc", "val_aupr").alias("bounded"),
        (F.col("val_auroc") <= best_area).alias("none_better"),
        n_best.alias("n_best"),
        *_part_sizes(parts),
    )


def _grid_sql(grid: dict) -> str:
    rows = ", ".join("('" + ", ".join(f"{k}={v}" for k, v in params.items()) + "')" for params in learn.combinations_of(grid))
    return f"""
WITH {_LINES_SQL},
n AS (SELECT {_SIZES_SQL} FROM p)
SELECT params, true AS bounded, true AS none_better, CAST(1 AS BIGINT) AS n_best, n.* FROM (VALUES {rows}) g(params), n"""


@query(_grid_sql(learn.LOGISTIC_GRID))
def lr_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "logistic")


@query(_grid_sql(learn.FOREST_GRID))
def rf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "forest")


@query(_grid_sql(learn.BOOSTING_GRID))
def gbt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "boosting")


@query(
    f"""
WITH {_LINES_SQL}
SELECT model, true AS bounded, (SELECT count(*) FROM p WHERE part = 'test') AS test_rows
FROM (VALUES ('baseline logistic'), ('tuned logistic'), ('forest'), ('boosting')) m(model)"""
)
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per kind of model, the baseline included; all areas are such, and better than chance on training rows."""
    parts = line_parts(spark, sf_dir)
    areas = ["train_auroc", "train_aupr", "test_auroc", "test_aupr"]
    return explore(parts, LINE_COLUMNS).scores.select(
        "model",
        (_between(*areas) & (F.col("train_auroc") > 0.5)).alias("bounded"),
        parts.test.agg(F.count("*")).scalar().alias("test_rows"),
    )


@query(
    f"""
WITH {_LINES_SQL}
SELECT CAST(costly AS DOUBLE) AS label, count(*) AS n, true AS bounded, true AS sided FROM p WHERE part = 'test' GROUP BY costly"""
)
def gbt_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows by label, scored by the tuned trees after a round trip of the model through storage.

    Probabilities are such, and the prediction is the likelier class.
    """
    parts = line_parts(spark, sf_dir)
    root = query_root(spark)
    save_model(train_boosting(parts, LINE_COLUMNS).model, root, "boosting")
    scored = metrics.scored(load_model(PipelineModel, root, "boosting").transform(parts.test), "probability")
    written = restage(scored.select("label", "score", "prediction"), root, "lines", "predictions")
    return written.groupBy("label").agg(
        F.count("*").alias("n"),
        F.every(_between("score")).alias("bounded"),
        F.every((F.col("prediction") == 1) == (F.col("score") > 0.5)).alias("sided"),
    )


@query(
    """
SELECT CAST(i AS INTEGER) AS idx, name, true AS bounded, true AS sum_is_one
FROM (SELECT unnest(range(9)) AS i, unnest(['line_idx', 'l_linestatus_idx', 'supplier_idx', 'l_quantity', 'l_extendedprice',
      'l_discount', 'l_tax', 'month_sin', 'month_cos']) AS name) WHERE EXISTS (SELECT 1 FROM lineitem)"""
)
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every feature counts in a forest of the default depth; they share one."""
    parts = line_parts(spark, sf_dir)
    with tree_parts(parts, LINE_COLUMNS) as (ready, _):
        model = learn.fitted(learn.forest("indexedFeatures", learn.max_bins(ready.train, "indexedFeatures")), ready.train)
    table_ = learn.importances(spark, model.featureImportances.toArray(), ready.train, "indexedFeatures")
    whole = F.abs(table_.agg(F.sum("score")).scalar() - 1) < 1e-9
    return table_.select("idx", "name", _between("score").alias("bounded"), whole.alias("sum_is_one"))


# Models whose fit can be written down: a logistic regression on one category without a penalty gives each level its
# share of costly lines; a tree of depth one, grown on all rows, makes the split of levels that leaves least
# variance. They pass through the same parts, grids and scores as the other models.
CLOSED_LINEAR = Columns(categoricals=["line"], numericals=[], outcome="costly", time="t")
CLOSED_TREES = Columns(categoricals=["band", "l_linestatus"], numericals=[], outcome="costly", time="t")
ONE_TREE = {"maxDepth": [1], "numTrees": [1], "bootstrap": [False], "featureSubsetStrategy": ["all"]}
ONE_ROUND = {"maxDepth": [1], "maxIter": [1]}


def closed_models(spark: SparkSession, parts: Parts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the three models by level on the test part, their areas, and what each category counts in the trees.

    The boosted tree scores as a pipeline over raw columns that went through storage.
    """
    root, carried = query_root(spark), ["line", "band", "l_linestatus"]
    with linear_parts(parts, CLOSED_LINEAR, keep=carried) as (ready, _):
        rows, weight = ready.weighted()
        trial = learn.best(learn.holdout_grid(learn.logistic("scaledFeatures", weight=weight), {"regParam": [0.0]}, rows, ready.val))
        linear = learn.model_scores(spark, {"logistic": trial.model}, rows, ready.test, weight=weight)
        share = vector_to_array("probability")[1].alias("score")
        by_line = restage(trial.model.transform(ready.test).select(F.lit("logistic").alias("model"), *carried, share), root, "closed", "logistic")
    with tree_parts(parts, CLOSED_TREES, keep=carried) as (ready, indexing):
        bins = learn.max_bins(ready.train, "indexedFeatures")
        rows, weight = ready.weighted()
        estimators = {
            "forest": (learn.forest("indexedFeatures", bins, weight=weight), ONE_TREE, rows),
            "boosting": (learn.boosting("indexedFeatures", bins, weight=weight), ONE_ROUND, rows),
        }
        models = {name: learn.best(learn.holdout_grid(*how, ready.val)).model for name, how in estimators.items()}
        trees = learn.model_scores(spark, models, rows, ready.test, weight=weight)
        by_tree = restage(learn.scored_by_all({"forest": models["forest"]}, ready.test, carried=carried), root, "closed", "forest")
        weights = [
            learn.importances(spark, m.featureImportances.toArray(), ready.train, "indexedFeatures").select(F.lit(name).alias("model"), "name", "score")
            for name, m in models.items()
        ]
    save_model(PipelineModel(stages=[*indexing.stages, models["boosting"]]), root, "boosting")
    loaded = metrics.scored(load_model(PipelineModel, root, "boosting").transform(parts.test)).select(F.lit("boosting").alias("model"), *carried, "score")
    levels = by_line.union(by_tree.select("model", *carried, "score")).union(loaded)
    return levels, linear.union(trees), weights[0].union(weights[1])


_CLOSED_SQL = f"""
WITH {_LINES_SQL},
tr AS (SELECT * FROM p WHERE part = 'train'),
lg AS (SELECT line, avg(costly) AS score FROM tr GROUP BY line),
lv AS (SELECT 'band' AS col, band AS level, count(*) AS n, sum(costly) AS s FROM tr GROUP BY band
       UNION ALL SELECT 'status', l_linestatus, count(*), sum(costly) FROM tr GROUP BY l_linestatus),
o AS (SELECT *, row_number() OVER w AS i, CAST(sum(n) OVER w AS DOUBLE) AS nl, CAST(sum(s) OVER w AS DOUBLE) AS sl,
             CAST(sum(n) OVER (PARTITION BY col) AS DOUBLE) AS nt, CAST(sum(s) OVER (PARTITION BY col) AS DOUBLE) AS st
      FROM lv WINDOW w AS (PARTITION BY col ORDER BY s / n, level ROWS UNBOUNDED PRECEDING)),
best AS (SELECT * FROM o WHERE nl < nt ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, col LIMIT 1),
side AS (SELECT o.col, o.level, CASE WHEN o.i <= best.i THEN best.sl / best.nl ELSE (best.st - best.sl) / (best.nt - best.nl) END AS share
         FROM o JOIN best USING (col)),
scores AS (SELECT 'logistic' AS model, part, line, band, l_linestatus, costly, score FROM p JOIN lg USING (line)
           UNION ALL SELECT 'forest', part, line, band, l_linestatus, costly, share FROM p JOIN side
             ON side.level = CASE WHEN side.col = 'band' THEN band ELSE l_linestatus END
           UNION ALL SELECT 'boosting', part, line, band, l_linestatus, costly, 2 * share - 1 FROM p JOIN side
             ON side.level = CASE WHEN side.col = 'band' THEN band ELSE l_linestatus END)"""


@query(
    f"""{_CLOSED_SQL}
SELECT model, line, band, l_linestatus, round(score, 3) + 0 AS score, count(*) AS n FROM scores WHERE part = 'test' GROUP BY ALL"""
)
def models_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a saturated logistic regression, one tree and one round of boosting say of each level, as their formulas do."""
    levels, _, _ = closed_models(spark, line_parts(spark, sf_dir))
    return levels.groupBy("model", "line", "band", "l_linestatus", (F.round("score", 3) + 0).alias("score")).agg(F.count("*").alias("n"))


@query(
    f"""{_CLOSED_SQL},
pts AS (SELECT model, part, score, CAST(count(*) FILTER (costly = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (costly = 0) AS DOUBLE) AS neg
       FROM scores WHERE part <> 'val' GROUP BY ALL),
run AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM pts WINDOW w AS (PARTITION BY model, part ORDER BY score DESC)),
area AS (SELECT model, part, sum(neg * (tp - pos + tp) / 2) / sum(pos) / sum(neg) AS auroc,
                sum(pos * (CASE WHEN tp - pos + fp - neg = 0 THEN tp / (tp + fp) ELSE (tp - pos) / (tp - pos + fp - neg) END + tp / (tp + fp)) / 2)
                / sum(pos) AS aupr FROM run GROUP BY model, part)
SELECT a.model, round(a.auroc, 6) AS train_auroc, round(a.aupr, 6) AS train_aupr, round(b.auroc, 6) AS test_auroc, round(b.aupr, 6) AS test_aupr
FROM area a JOIN area b ON a.model = b.model AND a.part = 'train' AND b.part = 'test'"""
)
def model_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score table of the same three models."""
    _, areas, _ = closed_models(spark, line_parts(spark, sf_dir))
    names = ["train_auroc", "train_aupr", "test_auroc", "test_aupr"]
    return areas.select("model", *[F.round(c, 6).alias(c) for c in names])


@query(
    f"""{_CLOSED_SQL}
SELECT model, name, CAST(name = CASE WHEN col = 'band' THEN 'band_idx' ELSE 'l_linestatus_idx' END AS DOUBLE) AS score
FROM (SELECT DISTINCT col FROM side), (VALUES ('forest'), ('boosting')) m(model), (VALUES ('band_idx'), ('l_linestatus_idx')) c(name)"""
)
def stump_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category that makes the best split counts for all, the other for nothing."""
    _, _, weights = closed_models(spark, line_parts(spark, sf_dir))
    return weights


# Events as departures, views as readings: the whole way from as-of join to balanced training rows.
EVENT_COLUMNS = Columns(
    categoricals=["user_folded", "prev_outcome"],
    numericals=["reading_value", "age", "minute_sin", "minute_cos"],
    outcome="label",
    time="t",
)


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed_events(spark, sf_dir)
    departures = events.where(F.col("event_type") != "view").select("event_id", "user_id", "k", "t", "label")
    readings = events.where(F.col("event_type") == "view").select(
        "k",
        F.col("event_id").alias("reading_id"),
        F.col("t").alias("reading_time"),
        F.col("value").alias("reading_value"),
    )
    joined = asof_bucketed(departures, readings, "k", "t", "reading_time", "reading_id")
    root = query_root(spark)
    joined = restage(joined.withColumn("user", F.col("user_id").cast("string")), root, "events", "original")
    folded = fold_rare_levels(joined, "user", "user_folded", "RARE")
    minute_sin, minute_cos = cyclic(F.floor(F.col("t") / 60) % 1440, "TIME")
    cycled = folded.withColumns({"minute_sin": minute_sin, "minute_cos": minute_cos})
    return previous_outcome(cycled, "user_id", "t", "label", "event_id")


_EVENT_FEATURES_SQL = f"""
WITH e AS ({EVENTS_SQL}),
d AS (SELECT event_id, user_id, k, t, label FROM e WHERE event_type <> 'view'),
v AS (SELECT k, event_id AS reading_id, t AS reading_time, value AS reading_value FROM e WHERE event_type = 'view'),
near AS (SELECT d.*, reading_id, reading_value, d.t - reading_time AS age FROM d JOIN v ON d.k = v.k
         AND round(d.t / 3600) - round(reading_time / 3600) IN (2, 3)),
j AS (SELECT * FROM near WHERE age >= 7200
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY age, reading_id) = 1),
f AS (SELECT user_id, count(*) AS n FROM j GROUP BY user_id),
c AS (SELECT quantile_disc(n, 0.8) AS cut FROM f),
h AS (SELECT j.*, CASE WHEN n <= cut THEN 'RARE' ELSE CAST(j.user_id AS VARCHAR) END AS user_folded,
             lag(label) OVER w AS before, lag(t) OVER w AS before_t
      FROM j JOIN f ON j.user_id = f.user_id CROSS JOIN c WINDOW w AS (PARTITION BY j.user_id ORDER BY t, event_id)),
g AS (SELECT event_id, t, label, reading_value, age, user_folded,
             CASE WHEN before IS NULL OR t - before_t < 7200 THEN 0 ELSE before END AS prev_outcome,
             round(sin((t // 60) % 1440 * 2 * pi() / 1440), 6) + 0 AS minute_sin FROM h),
b AS (SELECT min(t) AS first, max(t) AS last FROM g),
s AS (SELECT g.*, CASE WHEN t <= first + floor((last - first) * CAST(0.6 AS DOUBLE)) THEN 'train'
                       WHEN t <= first + floor((last - first) * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part
      FROM g, b),
r AS (SELECT greatest(1, count(*) FILTER (label = 0) // count(*) FILTER (label = 1)) AS times FROM s WHERE part = 'train')
SELECT * EXCLUDE (copy) FROM (
  SELECT s.* REPLACE (CASE WHEN minute_sin = 0 THEN 0.0 ELSE minute_sin END AS minute_sin),
         unnest(range(CASE WHEN part = 'train' AND label = 1 THEN times ELSE 1 END)) AS copy FROM s, r)"""


@query(_EVENT_FEATURES_SQL)
def engineered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = query_root(spark)
    features = restage(event_features(spark, sf_dir), root, "events", "proposed_features")
    return oversample_minority(time_split(features, "t", 0.6, 0.2), "label", only=F.col("part") == "train").select(
        "event_id",
        "t",
        "label",
        "reading_value",
        "age",
        "user_folded",
        "prev_outcome",
        F.round("minute_sin", 6).alias("minute_sin"),
        "part",
    )


_DELAY_SQL = _EVENT_FEATURES_SQL[: _EVENT_FEATURES_SQL.index("SELECT * EXCLUDE")] + """
SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, true AS bounded
FROM s WHERE part = 'test'"""


@query(_DELAY_SQL)
def delay_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way on to tuned trees: test rows by class, and whether the quality metrics of the test part are such."""
    root = query_root(spark)
    features = restage(event_features(spark, sf_dir), root, "events", "proposed_features")
    parts = parts_of(features, EVENT_COLUMNS).staged(root, "events")
    final = train_boosting(parts, EVENT_COLUMNS)
    scored = restage(
        metrics.scored(final.predictions).select("label", "score", "prediction"), root, "events", "predictions"
    )
    measured = metrics.curve_areas(scored).select(
        "*",
        metrics.accuracy(scored).scalar().alias("accuracy"),
        metrics.false_positive_rate(scored).scalar().alias("fpr"),
    )
    # Areas are null where the test part lacks a class.
    lacking = (F.col("positives") == 0) | (F.col("negatives") == 0)
    return measured.select("positives", "negatives", F.coalesce(_between("auroc", "aupr", "accuracy", "fpr"), lacking).alias("bounded"))
