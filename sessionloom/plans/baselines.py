"""Queries: baseline classifiers with hold-out and cross-validation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sessionloom.operators import models, ranking
from sessionloom.plans import stand_ins as v

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEED = 0


def _vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


def standardize(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)
    return models.standardise(lines, MEASURES).withColumns({c: F.round(c, 6) for c in MEASURES})


def holdout_split(spark, sf):
    return models.holdout(v.table(spark, sf, "labels"), "doc_id", 0.2, SEED)


def majority_baseline(spark, sf):
    return models.majority_accuracy(holdout_split(spark, sf), "quality")


def majority_text(spark, sf):
    """The majority baseline on a text label."""
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return models.majority_accuracy(models.holdout(orders, "o_orderkey", 0.2, SEED), "o_orderstatus")


def stratified_folds(spark, sf):
    return ranking.stratified_folds(v.table(spark, sf, "labels"), "quality", "doc_id", 5)


def majority_cv(spark, sf):
    labels = models.assemble(v.table(spark, sf, "labels"), ["toxic"], ["doc_id", "quality"])
    scores = models.cross_validated_scores(labels, "doc_id", "quality", ["majority"])
    return scores.withColumn("accuracy", F.round("accuracy", 6))


def logistic_holdout(spark, sf):
    return models.holdout_scores(_vectors(spark, sf), "vec_id", "label", ["majority", "logistic"])


def forest_holdout(spark, sf):
    return models.holdout_scores(_vectors(spark, sf), "vec_id", "label", ["majority", "forest"])


def snapshot_holdout(spark, sf):
    """All three baselines on the session snapshot, predicting the final result."""
    snap = v.sessions(spark, sf).withColumns(
        {"session_key": F.concat_ws("|", *v.SESSION), "label": F.col("final_result").cast("int")}
    )
    vectors = models.assemble(snap, [*v.ACTIVITY, "balance", "region"], ["session_key", "label"])
    return models.holdout_scores(vectors, "session_key", "label", ["majority", "logistic", "forest"])


def model_cv(spark, sf):
    return models.cross_validated_scores(_vectors(spark, sf), "vec_id", "label", ["majority", "logistic", "forest"])


QUICK = models.makers(max_iter=200, trees=10, max_depth=5)
LARGE = 25


def _sized_parts(spark, sf):
    """Parts labelled by size: one feature tells the label, the other doesn't."""
    parts = v.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") > LARGE).cast("int").alias("label"), "p_size", "p_retailprice"
    )
    return models.assemble(parts, ["p_size", "p_retailprice"], ["p_partkey", "label"])


def _check(scores):
    shown = scores.withColumn("majority_accuracy", F.round("majority_accuracy", 6))
    return shown.withColumn("above_09", F.col("accuracy") > 0.9).drop("accuracy")


def logistic_check(spark, sf):
    """A separable label: what SQL can state of the fit, that is its rows, the majority's hits and that it wins."""
    return _check(models.against_majority(_sized_parts(spark, sf), "p_partkey", "label", "logistic", made=QUICK))


def forest_check(spark, sf):
    return _check(models.against_majority(_sized_parts(spark, sf), "p_partkey", "label", "forest", made=QUICK))


def cv_check(spark, sf):
    scores = models.folds_against_majority(_sized_parts(spark, sf), "p_partkey", "label", "logistic", 3, QUICK)
    return _check(scores).drop("above_09")


QUERIES = {
    f.__name__: f
    for f in (
        v.display(majority_baseline, {"accuracy": 6}), v.display(majority_text, {"accuracy": 6}),
        standardize, holdout_split, stratified_folds, majority_cv, logistic_holdout,
        forest_holdout, snapshot_holdout, model_cv, logistic_check, forest_check, cv_check,
    )
}

_SPLIT = f"""
SELECT *, CAST(('0x' || substr(md5('{SEED}:' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.2::DOUBLE AS is_test
FROM labels"""
_FOLDS = """
SELECT *, CAST(ntile(5) OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM labels"""

_PARTS = f"SELECT p_partkey, CAST(p_size > {LARGE} AS INTEGER) AS label FROM part"
_CHECK = f"""
WITH s AS (SELECT *, CAST(('0x' || substr(md5('0:' || p_partkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.2::DOUBLE AS is_test
           FROM ({_PARTS})),
m AS (SELECT label AS guess FROM s WHERE NOT is_test GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT count(*) AS n_test, round(avg(CASE WHEN label = guess THEN 1.0::DOUBLE ELSE 0 END), 6) AS majority_accuracy,
       TRUE AS beats_majority, TRUE AS above_09
FROM s, m WHERE is_test"""

ORACLE = {
    "logistic_check": _CHECK,
    "forest_check": _CHECK,
    "cv_check": f"""
WITH f AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY label ORDER BY p_partkey) - 1 AS INTEGER) AS fold FROM ({_PARTS})),
c AS (SELECT k.fold, f.label, count(*) AS n FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY ALL),
m AS (SELECT fold, arg_max(label, n * 10 - label) AS guess FROM c GROUP BY fold)
SELECT fold, count(*) AS n_test, round(avg(CASE WHEN label = guess THEN 1.0::DOUBLE ELSE 0 END), 6) AS majority_accuracy,
       TRUE AS beats_majority
FROM f JOIN m USING (fold) GROUP BY fold""",
    "majority_text": f"""
WITH s AS (SELECT o_orderstatus, CAST(('0x' || substr(md5('{SEED}:' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE
                  < 0.2::DOUBLE AS is_test FROM orders),
m AS (SELECT o_orderstatus FROM s WHERE NOT is_test GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT count(*) AS n_test, round(avg(CASE WHEN s.o_orderstatus = m.o_orderstatus THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM s, m WHERE is_test""",
    "standardize": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round((l.{c} - s.m_{c}) / COALESCE(nullif(s.s_{c}, 0), 1), 6) AS {c}" for c in MEASURES
    )
    + " FROM lineitem l, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES)
    + " FROM lineitem) s",
    "holdout_split": _SPLIT,
    "majority_baseline": f"""
WITH s AS ({_SPLIT}),
m AS (SELECT quality FROM s WHERE NOT is_test GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)
SELECT count(*) AS n_test, round(avg(CASE WHEN s.quality = m.quality THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM s, m WHERE is_test""",
    "stratified_folds": _FOLDS,
    "majority_cv": f"""
WITH f AS ({_FOLDS}),
c AS (SELECT k.fold, f.quality, count(*) AS n FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY ALL),
m AS (SELECT fold, arg_max(quality, n * 10 - quality) AS guess FROM c GROUP BY fold)
SELECT 'majority' AS model, fold, count(*) AS n_test,
       round(avg(CASE WHEN quality = guess THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM f JOIN m USING (fold) GROUP BY fold""",
}
