"""Baseline classifiers and their scores on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.columns import all_present, hash_fraction, number
from sessionloom.operators.ranking import stratified_folds
from sessionloom.sources.scratch import materialise


def holdout(df: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    """Adds ``is_test``. The draw depends on (seed, key) only: no shuffle, repeatable on retry. Rows
    without a key are on one side together."""
    return df.withColumn("is_test", hash_fraction(key, seed) < F.lit(test_share))


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and scale by the population sd. A constant column is only centred; NaN counts as missing."""
    stats = df.agg(
        F.struct(
            *[F.avg(number(c)).alias(f"m_{c}") for c in cols],
            *[F.coalesce(F.nullif(F.stddev_pop(number(c)), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in cols],
        )
    ).scalar()
    scaled = {c: (number(c) - F.col(f"__stats.m_{c}")) / F.col(f"__stats.s_{c}") for c in cols}
    return df.withColumn("__stats", stats).withColumns(scaled).drop("__stats")


def most_frequent(train: DataFrame, label: str):
    """Most frequent label of the training rows (smallest on a tie), as a scalar subquery."""
    counts = train.filter(all_present([label])).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label)))).scalar()


def accuracy(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("accuracy"))


def majority_accuracy(df: DataFrame, label: str) -> DataFrame:
    """Accuracy on the test rows of always predicting the training majority class."""
    test = df.filter("is_test").withColumn("prediction", most_frequent(df.filter(~F.col("is_test")), label))
    return accuracy(test, label).select("n_test", "accuracy")


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Numeric columns as one vector column ``features``."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return assembled.select(*keep, "features")


def _scaler() -> StandardScaler:
    # Uses the n-1 sd: all features differ from population scaling by one common factor near 1.
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def logistic(label: str, n_train: int, max_iter: int = 1000) -> Pipeline:
    """Multinomial logistic regression on standardised features, L2 penalty 1/n."""
    model = LogisticRegression(
        featuresCol="scaled",
        labelCol=label,
        family="multinomial",
        maxIter=max_iter,
        tol=1e-4,
        regParam=1.0 / max(n_train, 1),
        elasticNetParam=0.0,
        standardization=False,
    )
    return Pipeline(stages=[_scaler(), model])


def forest(label: str, trees: int = 100, max_depth: int = 10, seed: int = 7) -> Pipeline:
    """Random forest with sqrt(p) candidate features per split."""
    model = RandomForestClassifier(
        featuresCol="scaled",
        labelCol=label,
        numTrees=trees,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        maxMemoryInMB=512,
        seed=seed,
    )
    return Pipeline(stages=[_scaler(), model])


PARALLEL = 3  # fits at a time in a cross-validation
TASK_ROWS = 10_000  # training rows a task; a solver passes over them hundreds of times

Maker = Callable[[str, int], Pipeline]
MAKERS: Mapping[str, Maker] = {
    "logistic": logistic,
    "forest": lambda label, n_train: forest(label),
}


def makers(max_iter: int = 1000, trees: int = 100, max_depth: int = 10, seed: int = 7) -> dict[str, Maker]:
    """The named models with other settings than the defaults, for ``holdout_scores`` and the like."""
    return {
        "logistic": lambda label, n_train: logistic(label, n_train, max_iter),
        "forest": lambda label, n_train: forest(label, trees, max_depth, seed),
    }


def _score(train: DataFrame, test: DataFrame, label: str, model: str, made: Mapping[str, Maker]) -> DataFrame:
    if model == "majority":
        scored = test.withColumn("prediction", most_frequent(train, label))
    else:
        # The scaler is fitted on the training rows only, inside the pipeline.
        scored = made[model](label, train.count()).fit(train).transform(test)
    return accuracy(scored, label).select(F.lit(model).alias("model"), "n_test", "accuracy")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by their number: vectors are small on disk, and a file would be a single task's."""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(tasks, key).sortWithinPartitions(key) if tasks > 1 else df


def holdout_scores(
    df: DataFrame, key: str, label: str, models: Sequence[str], test_share: float = 0.2, made: Mapping[str, Maker] = MAKERS
) -> DataFrame:
    """Hold-out accuracy per model ``(model, n_test, accuracy)``; each model gets its own draw.

    ``df`` has the key, the label and a ``features`` vector. It is written once: the solvers pass
    over it many times, and a lost executor re-reads its part instead of replaying the plan. ``made``
    maps each model's name to its maker.
    """
    data = materialise(_spread(df.select(key, label, "features"), key), "features")
    scores = []
    for seed, model in enumerate(models):
        split = holdout(data, key, test_share, seed)
        scores.append(_score(split.filter(~F.col("is_test")), split.filter("is_test"), label, model, made))
    return reduce(DataFrame.unionByName, scores)


def cross_validated_scores(
    df: DataFrame, key: str, label: str, models: Sequence[str], folds: int = 5, made: Mapping[str, Maker] = MAKERS
) -> DataFrame:
    """Accuracy per (model, fold) over unshuffled stratified folds.

    The fits do not depend on each other: PARALLEL of them run at a time, as a fit alone leaves cores idle
    between its many short jobs.
    """
    data = materialise(_spread(stratified_folds(df.select(key, label, "features"), label, key, folds), key), "folds")

    def score(model: str, fold: int) -> DataFrame:
        train, test = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        return _score(train, test, label, model, made).withColumn("fold", F.lit(fold))

    with ThreadPool(PARALLEL) as pool:
        todo = [(model, fold) for model in models for fold in range(folds)]
        scores = pool.starmap(inheritable_thread_target(data.sparkSession)(score), todo, chunksize=1)
    return reduce(DataFrame.unionByName, scores)


def against_majority(
    df: DataFrame, key: str, label: str, model: str, test_share: float = 0.2, made: Mapping[str, Maker] = MAKERS
) -> DataFrame:
    """One row ``(n_test, majority_accuracy, accuracy, beats_majority)``: a model and the majority class on the
    same draw (seed 0), so that the difference is the model's."""
    data = holdout(materialise(_spread(df.select(key, label, "features"), key), "features"), key, test_share, 0)
    train, test = data.filter(~F.col("is_test")), data.filter("is_test")
    both = [_score(train, test, label, m, made) for m in ("majority", model)]
    return _compared(reduce(DataFrame.unionByName, both))


def folds_against_majority(
    df: DataFrame, key: str, label: str, model: str, folds: int = 5, made: Mapping[str, Maker] = MAKERS
) -> DataFrame:
    """``against_majority`` for each fold of the cross-validation, with the column ``fold``."""
    return _compared(cross_validated_scores(df, key, label, ["majority", model], folds, made), ["fold"])


def _compared(scores: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    base = F.col("model") == "majority"
    both = scores.groupBy(*on).agg(
        F.max(F.when(base, F.col("n_test"))).alias("n_test"),
        F.max(F.when(base, F.col("accuracy"))).alias("majority_accuracy"),
        F.max(F.when(~base, F.col("accuracy"))).alias("accuracy"),
    )
    return both.withColumn("beats_majority", F.col("accuracy") > F.col("majority_accuracy"))
