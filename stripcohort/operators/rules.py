"""Multiple-testing correction, deterministic folds, and the ring-geometry rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import prefix
from stripcohort.sources.shared import durable


def _by_value(tests: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """family, p, n of the distinct p of a family, and each family's number of tests m; null p are no tests."""
    points = tests.filter(F.col("p").isNotNull()).groupBy(family, "p").agg(F.count(F.lit(1)).alias("_n"))
    return points, points.groupBy(family).agg(F.sum("_n").alias("_m"))


def holm(tests: DataFrame, family: str) -> DataFrame:
    """p_holm: running maximum of (m - rank) * p within a family, at most 1.

    Of equal p the first has the largest step, so the result is one per distinct p: a family of any size is cut into pieces.
    The tests are written once: they meet their p again, and a mean that executors sum anew may end in another last bit.
    """
    tests = durable(tests)
    points, m = _by_value(tests, family)
    upto = prefix.joined(prefix.running(points, [family], "p", {"_upto": ("sum", "_n")}), m, [family])
    step = upto.withColumn("_s", (F.col("_m") - F.col("_upto") + F.col("_n")) * F.col("p"))
    top = prefix.running(step, [family], "p", {"_top": ("max", "_s")})
    return prefix.joined(tests, top.select(family, "p", F.least(F.lit(1.0), "_top").alias("p_holm")), [family, "p"], "left")


def benjamini_hochberg(tests: DataFrame, family: str) -> DataFrame:
    """q: running minimum of p * m / rank from the largest p on, at most 1. Of equal p the last has the least step, and tests are written once, as in holm()."""
    tests = durable(tests)
    points, m = _by_value(tests, family)
    upto = prefix.joined(prefix.running(points, [family], "p", {"_upto": ("sum", "_n")}), m, [family])
    step = upto.withColumns({"_s": F.col("p") * F.col("_m") / F.col("_upto"), "_fall": -F.col("p")})
    low = prefix.running(step, [family], "_fall", {"_low": ("min", "_s")})
    return prefix.joined(tests, low.select(family, "p", F.least(F.lit(1.0), "_low").alias("q")), [family, "p"], "left")


def numbered(rows: DataFrame, stratum: str, order: Column, key: str, name: str) -> DataFrame:
    """Adds the row's number (from 0) within its stratum by a hex hash, then key.

    A stratum may hold half of all rows, so no task sorts one whole: it is cut at the hash's first three digits, and
    each piece starts at the count of those before it (4096 counts per stratum).
    """
    cut = rows.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 3))
    before = W.partitionBy(stratum).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    start = cut.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n")).select(F.col(stratum).alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_0"))
    piece = F.row_number().over(W.partitionBy(stratum, "_b").orderBy("_h", key))
    both = cut.withColumn("_r", piece).join(start, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    return both.withColumn(name, F.col("_r") - 1 + F.col("_0")).drop("_h", "_b", "_s", "_c", "_0", "_r")


def seeded(seed: Column | int, key: str) -> Column:
    """A row's place in the order of a seed: md5(seed|key)."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), F.col(key).cast("string")))


def stratified_folds(rows: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id") -> DataFrame:
    """fold 0..k-1: rows of a label in the order of md5(seed|id), dealt in turn."""
    return numbered(rows, label, seeded(seed, key), key, "_at").withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at")


def repeated_folds(rows: DataFrame, label: str, repeats: int, k: int = 5, seed: int = 2026, key: str = "id") -> DataFrame:
    """stratified_folds() once per repeat 0..repeats-1, whose seed is seed + repeat."""
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_of", F.concat_ws("|", "repeat", label))
    return numbered(each, "_of", seeded(F.col("repeat") + seed, key), key, "_at").withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at", "_of")


def group_folds(rows: DataFrame, group: str, y: str, repeats: int, k: int = 5, seed: int = 2026) -> DataFrame:
    """repeat, group, n, fold: repeated folds that keep a group whole, groups dealt within their majority label. Join rows to them by group."""
    of = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (2 * F.count_if(y) >= F.count(F.lit(1))).cast("int").alias("_y"))
    return repeated_folds(of, "_y", repeats, k, seed, key=group).drop("_y")


def geometry(circles: DataFrame) -> DataFrame:
    """rho, tau, eps of circles (pupil_r, iris_r, dx); null where the iris has no radius."""
    by = lambda c: F.try_divide(c, F.col("iris_r"))
    return circles.withColumns({"rho": by(F.col("pupil_r")), "tau": by(F.col("iris_r") - F.col("pupil_r")), "eps": by(F.abs("dx"))})


def quality_label(rings: DataFrame) -> DataFrame:
    """score, quality and reasons: the rule on rho, tau and eps; fixed values are its thresholds and penalties.

    Radii that are missing, zero or the wrong way round are invalid with score 0, whatever else is there.
    """
    rho, tau, eps = F.col("rho"), F.col("tau"), F.col("eps")
    bad = F.coalesce((F.col("pupil_r") <= 0) | (F.col("iris_r") <= F.col("pupil_r")), F.lit(True))
    hard, soft = (rho < 0.15) | (rho > 0.80), (rho < 0.20) | (rho > 0.70)
    off: Column = F.when(hard, 0.6).when(soft, 0.25).otherwise(0.0) + F.when(tau < 0.25, 0.3).otherwise(0.0) + F.when(eps > 0.30, 0.3).otherwise(0.0)
    score = F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(1 - off, 6)))
    label = F.when(bad | hard | (F.col("score") < 0.5), "invalid").when(F.col("score") < 1, "borderline").otherwise("valid")
    named = {"radii": bad, "ratio_hard": ~bad & hard, "ratio_soft": ~bad & soft & ~hard, "thickness": ~bad & (tau < 0.25), "offset": ~bad & (eps > 0.30)}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return rings.withColumn("score", score).withColumn("quality", label).withColumn("reasons", reasons)
