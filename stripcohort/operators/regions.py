"""Validation of one small classifier per region, for all regions, folds and images in one pass.

The classifier is the nearer class mean of standardised features. Its training part is the whole less a fold, so sums
per fold, class and feature are all that is needed: no region is fitted by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import metrics


def centroid_predictions(rows: DataFrame, region: list[str]) -> DataFrame:
    """region, image_id, fold, y, score, pred of rows (region, image_id, fold, y, dim, x), one per image and feature.

    score is the squared distance to the mean of class 0 less that to class 1, features by the training deviation; a feature
    that is constant says nothing. Null where the training part of a fold lacks a class.
    """
    at = [*region, "dim"]
    one = F.col("y").cast("int")
    sums = {"n1": F.sum(one), "s1": F.sum(F.col("x") * one), "n": F.count("x"), "s": F.sum("x"), "q": F.sum(F.col("x") * F.col("x"))}
    part = rows.groupBy(*at, "fold").agg(*[c.alias(k) for k, c in sums.items()])
    whole = part.groupBy(*at).agg(*[F.sum(k).alias("w" + k) for k in sums])
    left = {k: F.col("w" + k) - F.col(k) for k in sums}
    mean = F.try_divide(left["s"], left["n"])
    spread = F.sqrt(F.greatest(F.try_divide(left["q"], left["n"]) - mean * mean, F.lit(0.0)))
    means = {"m1": F.try_divide(left["s1"], left["n1"]), "m0": F.try_divide(left["s"] - left["s1"], left["n"] - left["n1"]), "sd": spread}
    train = part.join(whole, at).select(*at, "fold", *[c.alias(k) for k, c in means.items()])

    def away(m: str) -> Column:
        z = F.try_divide(F.col("x") - F.col(m), F.col("sd"))
        return F.when(F.col("m0").isNull() | F.col("m1").isNull(), None).when(F.col("sd") > 1e-9, z * z).otherwise(0.0)

    scored = rows.join(train, [*at, "fold"]).groupBy(*region, "image_id", "fold", "y").agg(F.round(F.sum(away("m0") - away("m1")), 9).alias("score"))
    return scored.withColumn("pred", F.col("score") > 0)


def validated(rows: DataFrame, region: list[str], failed: float = 0.5) -> DataFrame:
    """region, n (images with a prediction), acc, sens, spec, f1 over all folds; a region that no fold could fit has the failed accuracy."""
    out = metrics.fold_metrics(centroid_predictions(rows, region).filter("pred is not null"), region)
    every = rows.select(*region).distinct()
    n = F.coalesce(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.lit(0))
    rest = ("sens", "spec", "f1")
    return every.join(out, region, "left").select(*region, n.alias("n"), F.coalesce("acc", F.lit(failed)).alias("acc"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in rest])


def of_at_least(scores: DataFrame, metric: str, least: float, order: list[str]) -> DataFrame:
    """Regions whose metric reaches a threshold, with their place from the largest down; of equals the first by order. One row per region goes in."""
    place = F.row_number().over(W.orderBy(F.desc(metric), *order))
    return scores.filter(F.col(metric) >= least).withColumn("place", place)
