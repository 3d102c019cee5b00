"""Learners of the cohort study on Spark's own library, and their validation over folds.

A fold is fitted on the whole cluster, so the loops below are over a few folds of large data, not over thousands of small fits;
those are done for all keys at once in small_models.py and regions.py.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.operators import rules, small_models
from stripcohort.sources.shared import durable

#: rows (vector features, double label), how many, how many features -> a fitted model with a probability.
Learner = Callable[[DataFrame, int, int], object]


def logistic(c: float = 1.0) -> Learner:
    """L2 logistic regression whose strength is that of a sum of losses weighted by c."""
    return lambda rows, n, d: LogisticRegression(regParam=1 / (c * n), standardization=False, maxIter=200, featuresCol="scaled", labelCol="label").fit(rows)


def forest(trees: int = 100, depth: int = 10, seed: int = 42) -> Learner:
    """Trees up to a depth; the library allows 30, where full trees of a few thousand rows end, at several times the cost."""
    return lambda rows, n, d: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="scaled", labelCol="label").fit(rows)


def perceptron(hidden: tuple[int, ...] = (100, 50), steps: int = 100, seed: int = 42) -> Learner:
    """Hidden layers of sigmoids, fitted by L-BFGS."""
    return lambda rows, n, d: MultilayerPerceptronClassifier(layers=[d, *hidden, 2], maxIter=steps, seed=seed, featuresCol="scaled", labelCol="label").fit(rows)


LEARNERS: dict[str, Callable[[], Learner]] = {"logistic": logistic, "forest": forest, "perceptron": perceptron}


def held(rows: DataFrame, per_part: int = 10_000) -> DataFrame:
    """rows kept for the many passes of a fit (the caller lets go of them), in no more partitions than their number asks for, nor than tasks can run:
    a task of a forest gives the histograms of all nodes, however few its rows, so what is shuffled grows with the partitions."""
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // per_part + 1)
    return rows.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)


def vectors(rows: DataFrame) -> DataFrame:
    """rows with features (array of numbers) and y (boolean) as the library's columns."""
    return rows.withColumns({"features": array_to_vector(F.col("features").cast("array<double>")), "label": F.col("y").cast("double")})


def fitted(train: DataFrame, learners: dict[str, Learner]) -> dict[str, PipelineModel]:
    """Standardises on train alone (population deviation, a constant column becomes 0), once for all learners, then fits; nothing where train lacks a class."""
    n, kinds = train.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if kinds < 2:
        return {}
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="sampled").fit(train)
    d = len(scaler.mean)
    # the library divides by the sample deviation
    exact = ElementwiseProduct(scalingVec=Vectors.dense([(n / max(n - 1, 1)) ** 0.5] * d), inputCol="sampled", outputCol="scaled")
    ready = exact.transform(scaler.transform(train)).persist(StorageLevel.MEMORY_AND_DISK)
    models = {name: PipelineModel([scaler, exact, learner(ready, n, d)]) for name, learner in learners.items()}
    ready.unpersist()
    return models


def scored(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, score (probability of class 1), pred."""
    return model.transform(rows).select(*keep, F.element_at(vector_to_array("probability"), 2).alias("score"), (F.col("prediction") == 1).alias("pred"))


def _empty(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.limit(0).select(*keep, F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("pred"))


def cross_validated(rows: DataFrame, learners: dict[str, Learner], fold: str = "fold", k: int = 5, tests: DataFrame | None = None) -> DataFrame:
    """clf, id, fold, y, score, pred of rows (id, y, features, fold): each fold scored by a model of all other folds.

    With tests (id, condition, features), condition too: the same models, fitted on rows, score every condition of the fold's ids; rows
    themselves are condition clean. A fold whose training part lacks a class has no predictions.
    """
    ready = held(vectors(rows))
    keep = ["id", fold, "y"]
    asked = ready
    if tests is not None:
        keep = ["id", fold, "y", "condition"]
        other = tests.join(rows.select("id", fold, "y"), "id")
        asked = ready.withColumn("condition", F.lit("clean")).unionByName(vectors(other), allowMissingColumns=True)
    out = [_empty(asked, keep).select(F.lit("").alias("clf"), *keep, "score", "pred")]
    # folds are fitted side by side, since a fit's jobs are small
    with ThreadPool(k) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(lambda f: fitted(ready.filter(F.col(fold) != f), learners)), range(k))
    for f in range(k):
        test = asked.filter(F.col(fold) == f)
        for name, model in models[f].items():
            out.append(scored(model, test, keep).select(F.lit(name).alias("clf"), *keep, "score", "pred"))
    found = durable(reduce(DataFrame.unionByName, out))
    ready.unpersist()
    return found


def compared_fusion(rows: DataFrame, blocks: list[str], k: int = 5, inner: int = 5, seed: int = 42) -> DataFrame:
    """model, id, fold, y, score, pred of rows (id, y, and an array per block): every block alone and their stack, over the same folds."""
    return small_models.stacked(rules.stratified_folds(rows, "y", k, seed), blocks, k, inner, seed)
