"""Queries that fit models over folds. Their scores can't be said in SQL; tests/test_learners.py holds them to planted signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.operators import comparison, learners, metrics, neighbourhoods, perceptrons, photometric, prefix, rules, small_models
from stripcohort.sources import shared, views

QUERIES: dict = {}
SQL: dict = {}


def query(f: object) -> object:
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """id, y, features, fold: embeddings of two classes."""
    base = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).alias("y"), F.col("embedding").alias("features"))
    return rules.stratified_folds(base, "y")


def _measured(found: DataFrame, keys: list[str]) -> DataFrame:
    """Every key's metrics and AUC, rounded."""
    found = shared.durable(found.select(*keys, "y", "score", "pred"))
    out = prefix.joined(metrics.fold_metrics(found, keys), metrics.auc(found, keys), keys, "left")
    return out.select(*keys, *[F.round(m, 6).alias(m) for m in [*metrics.RATES, "auc"]])


@query
def c10_cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """Three learners over five folds, with every fold's metrics and AUC; the logistic models of all folds are one batch, and so are the perceptrons."""
    rows = shared.durable(_rows(spark, d))
    found = learners.cross_validated(rows, {"forest": learners.forest()}).select("clf", "fold", "y", "score", "pred")
    long = rows.withColumnRenamed("features", "x")
    for name, batch in (("logistic", small_models.cross_validated(long, [])), ("perceptron", perceptrons.cross_validated(long))):
        found = found.unionByName(batch.select(F.lit(name).alias("clf"), "fold", "y", "score", "pred"))
    return _measured(found, ["clf", "fold"])


@query
def c9_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Boosted stumps over five folds, all folds' stumps in one pass per round; 20 rounds here, the operator's default is 50."""
    rows = shared.durable(_rows(spark, d).withColumnRenamed("features", "x"))
    stumps = small_models.boosted(small_models.training_rows(rows, [], "fold", 5), ["fold"], rounds=20)
    return _measured(small_models.boosted_scores(stumps, rows, ["fold"], ["id", "y"]), ["fold"])


@query
def c11_grid(spark: SparkSession, d: str) -> DataFrame:
    """C11: a logistic model for every configuration (quarters of the embedding), repeat and fold, fitted in one batch, with every model's metrics."""
    base = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).alias("y"), F.col("embedding").alias("e"))
    folds = rules.repeated_folds(base.select("id", "y"), "y", repeats=2).select("id", "repeat", "fold")
    size = F.greatest(F.lit(1), F.ceil(F.size("e") / 4).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.struct(q.alias("config"), F.slice("e", q * size + 1, size).alias("x")))
    rows = base.select("id", "y", F.inline(parts)).filter(F.size("x") > 0).join(folds, "id")
    found = small_models.cross_validated(rows, ["config", "repeat"])
    return _measured(found, ["config", "repeat", "fold"])


def _images(image: DataFrame, keys: list[str]) -> DataFrame:
    """id, keys and features: the values of an image in the order of its places."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda x: x["value"].cast("double"))
    return image.groupBy(F.col("image_id").alias("id"), *keys).agg(whole.alias("features"))


@query
def c13_robustness(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on clean images, scored on eight perturbations of the held-out ones, change of balanced accuracy against the clean fold."""
    px = views.pixels(spark, d)
    clean = px.select("image_id", "row", "col", F.col("b").alias("value"))
    labels = px.select(F.col("image_id").alias("id"), (F.col("label") == 1).alias("y")).distinct()
    folds = shared.durable(rules.stratified_folds(labels, "y"))
    named = lambda df, k: df.select("image_id", "row", "col", "value", F.lit(k).alias("kind"))
    every = named(clean, "clean").unionByName(photometric.perturb(clean)).unionByName(named(neighbourhoods.noisy(clean, 8.0), "noise")).unionByName(named(neighbourhoods.blurred(clean, 1.5, 8, 8), "blur"))
    rows = shared.durable(_images(every, ["kind"]).withColumnRenamed("features", "x").join(folds, "id"))
    models = small_models.logistic(small_models.training_rows(rows.filter("kind = 'clean'").drop("kind"), [], "fold", 5), ["fold"])
    found = small_models.scores(models, rows, ["fold"], ["id", "y", "kind"]).withColumn("clf", F.lit("logistic"))
    metric = shared.durable(metrics.fold_metrics(found, ["clf", "kind", "fold"]).withColumnRenamed("kind", "condition"))
    base = metric.filter("condition = 'clean'").select("clf", "fold", F.col("bal_acc").alias("_b"))
    deltas = metric.filter("condition <> 'clean'").join(base, ["clf", "fold"]).withColumn("delta", F.col("bal_acc") - F.col("_b"))
    out = comparison.robustness(deltas, ["clf"], "condition", "delta", 0.25)
    return out.select("clf", "condition", "k", *[F.round(c, 6).alias(c) for c in ("mean_delta", "lo", "hi", "worst", "mean_abs")])


@query
def c14_fusion(spark: SparkSession, d: str) -> DataFrame:
    """C14: two blocks of features alone and stacked, over the same five folds, with five inner ones; all models are two batches."""
    base = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).alias("y"), F.col("embedding").alias("e"))
    cut = F.ceil(F.size("e") * 0.75).cast("int")
    rows = base.select("id", "y", F.slice("e", 1, cut).alias("texture"), F.slice("e", cut + 1, F.size("e") - cut).alias("geometry"))
    folds = _measured(learners.compared_fusion(rows, ["texture", "geometry"]), ["model", "fold"])
    return folds.groupBy("model").agg(*[F.round(f(m), 6).alias(f"{n}_{m}") for m in ("auc", "bal_acc") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
