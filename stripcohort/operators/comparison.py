"""Comparisons over fold tables: corrected intervals and tests, ranks, wins, and geometry of fitted rings.

A fold table has one row per configuration and fold, so it is small beside the rows that it was made of.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stripcohort.operators import dist, prefix, rules

#: The studentised range over sqrt(2) at 0.05 for 2 to 10 configurations.
NEMENYI_Q = [1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164]


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([known.setdefault((a, b), dist.t_quantile(a, b)) if b and b >= 1 else math.nan for a, b in zip(p, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.t_two_sided(a, b) if b and b >= 1 and a == a else math.nan for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.chi2_sf(a, int(b)) for a, b in zip(x, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def f_sf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([dist.f_sf(a, b, c) if a == a else math.nan for a, b, c in zip(x, d1, d2, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def nemenyi_q(k: pd.Series) -> pd.Series:
    return k.map(lambda n: NEMENYI_Q[int(n) - 2] if 2 <= n <= 10 else dist.range_quantile(0.95, int(n)) / math.sqrt(2) if n > 10 else math.nan)


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(dist.normal_cdf)


def interval(folds: DataFrame, keys: list[str], value: str, test_share: float | None = None, level: float = 0.95) -> DataFrame:
    """mean, sd (sample), k, lo, hi of a value across folds; null and NaN values fall away, one value gives no interval (null).

    test_share is n_test / n_train: then the variance is corrected for folds that share training rows; None is Student's plain interval.
    """
    finite = folds.filter(F.col(value).isNotNull() & ~F.isnan(value))
    s = finite.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("k"))
    half = t_quantile(F.lit(0.5 + level / 2), (F.col("k") - 1).cast("double")) * F.col("sd") * F.sqrt(1 / F.col("k") + F.lit(test_share or 0.0))
    return s.withColumn("_h", half).select(*keys, "mean", "sd", "k", (F.col("mean") - F.col("_h")).alias("lo"), (F.col("mean") + F.col("_h")).alias("hi"))


def paired(folds: DataFrame, config: str, baseline: str, keys: list[str], pairing: list[str], value: str, test_share: float) -> DataFrame:
    """diff, t, p, lo, hi, k of every configuration against the baseline on equal folds, variance corrected.

    Without variance t is 0 or infinite and the interval a point; one fold has no t, p or interval (NaN or null).
    """
    base = folds.filter(F.col(config) == baseline).select(*keys, *pairing, F.col(value).alias("_b"))
    both = folds.filter(F.col(config) != baseline).join(base, [*keys, *pairing]).withColumn("_d", F.col(value) - F.col("_b"))
    both = both.filter(F.col("_d").isNotNull() & ~F.isnan("_d"))
    s = both.groupBy(*keys, config).agg(F.avg("_d").alias("diff"), F.var_samp("_d").alias("_v"), F.count(F.lit(1)).alias("k"))
    one = F.col("k") < 2
    se = F.sqrt(F.coalesce("_v", F.lit(0.0)) * (1 / F.col("k") + test_share))
    still = F.when(F.col("diff") == 0, 0.0).otherwise(F.signum("diff") * float("inf"))
    t = F.when(one, F.lit(float("nan"))).when(se > 0, F.try_divide(F.col("diff"), se)).otherwise(still)
    df = (F.col("k") - 1).cast("double")
    half = F.when(one, F.lit(float("nan"))).otherwise(t_quantile(F.lit(0.975), df) * se)
    s = s.withColumns({"t": t, "_h": half})
    out = s.withColumns({"p": t_two_sided("t", df), "lo": F.col("diff") - F.col("_h"), "hi": F.col("diff") + F.col("_h")})
    return out.select(*keys, config, "diff", "k", "t", "p", "lo", "hi")


def average_ranks(folds: DataFrame, config: str, block: list[str], value: str) -> DataFrame:
    """Mean rank per configuration over blocks, 1 the largest, ties averaged; n blocks."""
    at = W.partitionBy(*block)
    rank = F.rank().over(at.orderBy(F.desc(value))) + (F.count(F.lit(1)).over(W.partitionBy(*block, value)) - 1) / 2
    return folds.withColumn("_r", rank).groupBy(config).agg(F.avg("_r").alias("rank"), F.count(F.lit(1)).alias("n"))


def friedman(ranks: DataFrame) -> DataFrame:
    """chi2 and its p, Iman and Davenport's f and its p, and the critical difference, of average_ranks().

    Where all blocks agree f is infinite and its p 0. The difference of up to 10 configurations comes from the table,
    of more from the studentised range itself.
    """
    s = ranks.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.sum(F.col("rank") * F.col("rank")).alias("q")).filter("k > 0")
    k, n = F.col("k"), F.col("n")
    s = s.withColumn("chi2", 12 * n / (k * (k + 1)) * (F.col("q") - k * (k + 1) * (k + 1) / 4))
    rest = n * (k - 1) - F.col("chi2")
    f = F.when(rest > 1e-9, F.try_divide((n - 1) * F.col("chi2"), rest)).otherwise(F.lit(float("inf")))
    s = s.withColumn("f", f).withColumn("p_f", f_sf("f", (k - 1).cast("double"), ((k - 1) * (n - 1)).cast("double")))
    return s.select("k", "n", "chi2", chi2_sf("chi2", k - 1).alias("p"), "f", "p_f", (nemenyi_q(k) * F.sqrt(k * (k + 1) / (6 * n))).alias("cd"))


def cliques(ranks: DataFrame, config: str, difference: float) -> DataFrame:
    """first, last, members: runs of configurations in the order of their rank whose ends are less than the critical difference apart.

    Only runs of two or more that no other contains. One row per configuration goes in.
    """
    order = W.orderBy("rank", config)
    at = ranks.select(config, "rank").withColumn("at", F.row_number().over(order))
    # the place of the last one within reach, by a frame over the ranks themselves
    reach = F.expr(f"max(at) over (order by rank range between current row and {difference - 1e-12!r}D following)")
    runs = at.withColumn("_z", reach).filter("_z > at").select(F.col(config).alias("first"), F.col("at").alias("_a"), "_z")
    # a run that ends where an earlier one does lies inside it
    lone = runs.groupBy("_z").agg(F.min_by("first", "_a").alias("first"), F.min("_a").alias("_a"))
    return lone.join(at.select(F.col("at").alias("_z"), F.col(config).alias("last")), "_z").select("first", "last", (F.col("_z") - F.col("_a") + 1).cast("long").alias("members"))


def permutation_p(null: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """p = (1 + null values of at least the observed one) / (1 + n), and the null's mean, deviation and 95th percentile."""
    both = null.join(observed, keys)
    beyond = F.count_if(F.col("null_value") >= F.col("observed"))
    return both.groupBy(*keys).agg(((1 + beyond) / (1 + F.count("null_value"))).alias("p"), F.avg("null_value").alias("mean"), F.stddev_pop("null_value").alias("sd"), F.percentile("null_value", 0.95).alias("p95"))


def spearman(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks, per key."""
    ranked = prefix.mean_ranks(prefix.mean_ranks(pairs, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def wins(folds: DataFrame, config: str, baseline: str, pairing: list[str], value: str, family: list[str] | None = None, test_share: float = 0.25) -> DataFrame:
    """How often a configuration is above the baseline, its mean and worst change and, with a family, how many of its tests are significant.

    A test is one value of the family's columns (of pairing): the corrected paired t over the other columns of pairing, p
    by Holm's correction over a configuration's tests; up and down count those below 0.05 by their direction.
    """
    base = folds.filter(F.col(config) == baseline).select(*pairing, F.col(value).alias("_b"))
    both = folds.filter(F.col(config) != baseline).join(base, pairing).withColumn("_d", F.col(value) - F.col("_b"))
    out = both.groupBy(config).agg(F.count("_d").alias("n"), F.count_if(F.col("_d") > 0).alias("wins"), F.avg("_d").alias("mean_delta"), F.min("_d").alias("worst"), F.avg(F.abs("_d")).alias("mean_abs"))
    if not family:
        return out
    tests = paired(folds, config, baseline, family, [c for c in pairing if c not in family], value, test_share)
    held = rules.holm(tests.withColumn("p", F.when(~F.isnan("p"), F.col("p"))), config)
    clear = F.col("p_holm") < 0.05
    found = held.groupBy(config).agg(F.count_if(clear & (F.col("diff") > 0)).alias("up"), F.count_if(clear & (F.col("diff") < 0)).alias("down"))
    zero = F.lit(0).cast("long")
    return out.join(found, config, "left").withColumns({c: F.coalesce(c, zero) for c in ("up", "down")})


def signed_ranks(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon's w_plus over pairs that differ, n, z with ties corrected, and the one-sided p that a is larger. Ranks are of distinct sizes, in pieces."""
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).filter("_d <> 0").withColumn("_m", F.abs("_d"))
    points = d.groupBy(*keys, "_m").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_p"))
    at = prefix.running(points, keys, "_m", {"_upto": ("sum", "_n")})
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    n, ties = F.col("n"), F.col("_n").cast("double")
    s = at.groupBy(*keys).agg(F.sum(F.col("_p") * rank).alias("w_plus"), F.sum("_n").alias("n"), F.sum(ties * (ties * ties - 1)).alias("_t"))
    spread = F.sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - F.col("_t") / 48)
    z = F.try_divide(F.col("w_plus") - n * (n + 1.0) / 4, spread)
    return s.withColumn("z", z).withColumn("p", 1 - normal_cdf("z")).drop("_t")


def gain(values: DataFrame, keys: list[str], method: str, baselines: list[str], value: str) -> DataFrame:
    """value over the largest value of the baselines of its key; null where they have none or 0."""
    best = F.max(F.when(F.col(method).isin(baselines), F.col(value))).over(W.partitionBy(*keys))
    return values.withColumn("best", best).withColumn("gain", F.when(F.col("best") != 0, F.col(value) / F.col("best")))


def votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """hard: the mean of pred rounded half to even; soft: whether the mean of proba reaches 0.5."""
    return rows.groupBy(*keys).agg(F.rint(F.avg(F.col("pred").cast("int"))).cast("int").alias("hard"), F.round(F.avg("proba"), 9).alias("proba")).withColumn("soft", (F.col("proba") >= 0.5).cast("int"))


def circle_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares circle (Kasa) of points x, y per key from sums alone: cx, cy, radius; null if they lie on a line."""
    n, x, y = F.lit(1.0), F.col("x"), F.col("y")
    z = x * x + y * y
    named = {"n": n, "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "sz": z, "sxz": x * z, "syz": y * z}
    s = points.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(k) for k, c in named.items()])
    c = {k: F.col(k) for k in named}
    a, b, d = c["n"] * c["sxx"] - c["sx"] * c["sx"], c["n"] * c["sxy"] - c["sx"] * c["sy"], c["n"] * c["syy"] - c["sy"] * c["sy"]
    e, f = c["n"] * c["sxz"] - c["sx"] * c["sz"], c["n"] * c["syz"] - c["sy"] * c["sz"]
    det = a * d - b * b
    out = s.withColumns({"cx": F.when(det != 0, (e * d - f * b) / (2 * det)), "cy": F.when(det != 0, (f * a - e * b) / (2 * det))})
    r2 = (F.col("sz") - 2 * F.col("cx") * F.col("sx") - 2 * F.col("cy") * F.col("sy")) / F.col("n") + F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")
    return out.select(*keys, "cx", "cy", F.sqrt(r2).alias("radius"))


def error_report(rows: DataFrame, keys: list[str], measured: str, truth: str, limit: float) -> DataFrame:
    """mae, median, p95, worst, bias, how many errors exceed the limit, and the correlation with the truth."""
    e = F.col(measured) - F.col(truth)
    a = F.abs(e)
    whole = rows.groupBy(*keys).agg(F.avg(a).alias("mae"), F.max(a).alias("worst"), F.avg(e).alias("bias"), F.count_if(a > limit).alias("over"), F.corr(measured, truth).alias("r"))
    ends = prefix.quantiles(rows.select(*keys, a.alias("_e")), keys, "_e", {"median": 0.5, "p95": 0.95})
    return prefix.joined(whole, ends, keys, "left").select(*keys, "mae", "median", "p95", "worst", "bias", "over", "r")


def ring_edges(rays: DataFrame, share: float = 0.3) -> DataFrame:
    """ray, edge, limbus: order of the first local maximum of the derivative that reaches a share of the ray's largest, and of the largest itself."""
    along = W.partitionBy("ray").orderBy("at")
    whole = W.partitionBy("ray")
    d = rays.withColumn("d", (F.lead("value").over(along) - F.lag("value").over(along)) / 2).filter("d is not null")
    d = d.withColumns({"before": F.lag("d").over(along), "after": F.lead("d").over(along), "top": F.max("d").over(whole)})
    peak = (F.col("d") >= F.coalesce("before", "d")) & (F.col("d") >= F.coalesce("after", "d")) & (F.col("d") >= share * F.col("top"))
    return d.groupBy("ray").agg(F.min(F.when(peak, F.col("at"))).alias("edge"), F.min(F.when(F.col("d") == F.col("top"), F.col("at"))).alias("limbus"))


def ring_coordinates(points: DataFrame, pupil: tuple[float, float, float], iris: tuple[float, float, float]) -> DataFrame:
    """s and theta of points (x, y) between two circles (x, y, radius) that need not share a centre; s is -1 inside the pupil."""
    (px, py, pr), (ix, iy, ir) = pupil, iris
    dx, dy, dr = ix - px, iy - py, ir - pr
    u, v = F.col("x") - F.lit(px), F.col("y") - F.lit(py)
    a, b, c = dx * dx + dy * dy - dr * dr, u * dx + v * dy + pr * dr, u * u + v * v - pr * pr
    root = (b - F.sqrt(b * b - a * c)) / a  # a < 0 while the pupil lies inside the iris: the larger root
    out = points.withColumn("s", F.when(c < 0, -1.0).otherwise(root))
    theta = F.atan2(F.col("y") - (py + F.col("s") * dy), F.col("x") - (px + F.col("s") * dx))
    return out.withColumn("theta", F.when(F.col("s") >= 0, F.when(theta < 0, theta + 2 * math.pi).otherwise(theta)))


def effect(folds: DataFrame, config: str, baseline: str, fold: str, value: str, test_share: float) -> DataFrame:
    """diff, k, t, p, lo, hi and p_holm of every configuration against the baseline, all classifiers of a fold averaged first."""
    mean = folds.groupBy(config, fold).agg(F.avg(value).alias(value)).withColumn("_all", F.lit("all"))
    return rules.holm(paired(mean, config, baseline, ["_all"], [fold], value, test_share), "_all").drop("_all")


def summary(folds: DataFrame, keys: list[str], metrics: list[str], test_share: float) -> DataFrame:
    """keys, metric, mean, sd (sample), lo, hi, k (folds with a value), n_folds: every metric of a configuration in one pass, in long form."""
    long = folds.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    each = interval(long, [*keys, "metric"], "value", test_share)
    n = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n_folds"))
    return prefix.joined(n, each, [*keys, "metric"], "left").select(*keys, "metric", "mean", "sd", "lo", "hi", F.coalesce("k", F.lit(0)).alias("k"), "n_folds")


def robustness(deltas: DataFrame, keys: list[str], condition: str, delta: str, test_share: float) -> DataFrame:
    """keys, condition, mean_delta, lo, hi, k; and per keys worst (the least mean) and mean_abs (of the means) over conditions."""
    each = interval(deltas, [*keys, condition], delta, test_share).withColumnRenamed("mean", "mean_delta")
    over = each.groupBy(*keys).agg(F.min("mean_delta").alias("worst"), F.avg(F.abs("mean_delta")).alias("mean_abs"))
    return prefix.joined(each, over, keys).select(*keys, condition, "mean_delta", "lo", "hi", "k", "worst", "mean_abs")


def bootstrap_median(values: DataFrame, keys: list[str], item: str, value: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """keys, n, median, lo, hi: the median of value and the 95 % interval of its medians over resamples drawn with replacement.

    For small tables (sectors of an image, folds): each of a key's n rows is drawn by hashes of seed, resample and turn, an equi-join of
    n * resamples narrow rows. Null values take no part.
    """
    order = W.partitionBy(*keys).orderBy(item)
    rows = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.row_number().over(order) - 1).alias("_i"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", 0.5).alias("median"))
    turns = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_s")).withColumn("_t", F.explode(F.expr("sequence(0, cast(n as int) - 1)")))
    drawn = turns.select(*keys, "_s", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "_s", "_t")), 1, 8), 16, 10).cast("long"), F.col("n")).cast("int").alias("_i"))
    medians = prefix.joined(drawn, rows, [*keys, "_i"]).groupBy(*keys, "_s").agg(F.percentile("_v", 0.5).alias("_m"))
    ends = medians.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_e"))
    return prefix.joined(n, ends, keys).select(*keys, "n", "median", F.col("_e")[0].alias("lo"), F.col("_e")[1].alias("hi"))


def consensus_circle(points: DataFrame, keys: list[str], triples: int = 300, tolerance: float = 2.0, seed: int = 0) -> DataFrame:
    """cx, cy, radius, inliers of the circle that most points agree on: hashed triples of a key's points, each one's circle, then a fit of its inliers.

    A triple counts the points less than tolerance away from its circle; the most count, of equals the first triple. Keys of fewer than 3
    points, or of points on a line, have nulls. A key's points are few (one ring of an image); keys spread over the cluster.
    """
    order = W.partitionBy(*keys).orderBy("x", "y")
    at = points.filter("x is not null and y is not null").select(*keys, "x", "y", (F.row_number().over(order) - 1).alias("_i"))
    n = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draw = n.filter("_n >= 3").select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(triples - 1))).alias("_s"))

    def hashed(turn: int, below: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "_s", F.lit(turn))), 1, 8), 16, 10).cast("long"), below)

    # three different places: the second and third are drawn among those left, and pass over the ones before
    a, b, c = hashed(0, F.col("_n")), hashed(1, F.col("_n") - 1), hashed(2, F.col("_n") - 2)
    draw = draw.withColumn("_a", a).withColumn("_b", b + (b >= F.col("_a")).cast("long"))
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    draw = draw.withColumn("_c", c + (c >= low).cast("long")).withColumn("_c", F.col("_c") + (F.col("_c") >= high).cast("long"))
    picked = draw.select(*keys, "_s", F.explode(F.array("_a", "_b", "_c").cast("array<int>")).alias("_i"))
    circles = circle_fit(prefix.joined(picked, at, [*keys, "_i"]).select(*keys, "_s", "x", "y"), [*keys, "_s"]).filter("radius > 0")
    near = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("radius")) < tolerance
    counted = prefix.joined(at, circles, keys).filter(near)
    votes_ = counted.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_votes"))
    best = votes_.groupBy(*keys).agg(F.max(F.struct("_votes", (-F.col("_s")).alias("_o"))).alias("_best")).select(*keys, (-F.col("_best._o")).alias("_s"), F.col("_best._votes").alias("_votes"))
    # fewer than three inliers: all points are fitted
    inside = counted.join(best.filter("_votes >= 3").select(*[F.col(k).alias("_k" + k) for k in keys], F.col("_s").alias("_t")), [F.col(k).eqNullSafe(F.col("_k" + k)) for k in keys] + [F.col("_s") == F.col("_t")], "left_semi").select(*keys, "x", "y")
    rest = prefix.joined(at, inside.select(*keys).distinct().withColumn("_has", F.lit(1)), keys, "left").filter("_has is null").select(*keys, "x", "y")
    used = inside.unionByName(rest)
    found = prefix.joined(circle_fit(used, keys), used.groupBy(*keys).agg(F.count(F.lit(1)).alias("inliers")), keys)
    enough = F.col("_n") >= 3
    return prefix.joined(n, found, keys, "left").select(*keys, *[F.when(enough, F.col(c)).alias(c) for c in ("cx", "cy", "radius", "inliers")])
