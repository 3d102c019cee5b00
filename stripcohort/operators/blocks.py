"""Feature blocks of images: regions, fusion, standardising within folds, null labels, difference maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.sources.shared import durable

from stripcohort.operators import comparison, features, prefix, rules

#: Groups of a permutation by their hash, rows that a task puts in order, and places that a task compares at once.
CUTS, ROWS, BLOCK = 4096, 2_000_000, 8192


def region_block(image: DataFrame, regions: DataFrame) -> DataFrame:
    """image_id, region, mean, std, n over the columns [lo, hi) of each region (region, lo, hi); regions may overlap, one that no column meets gives no row."""
    columns = regions.filter("lo < hi").select("region", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("col"))
    return image.join(columns, "col").groupBy("image_id", "region").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))


def joined(block: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """keys, features: the values of all rows of a key, in the order of a column."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct(order, *values))), lambda x: F.array(*[x[v] for v in values]))
    return block.groupBy(*keys).agg(F.flatten(whole).alias("features"))


def fused(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """key, features: the features of both, concatenated; rows without a partner fall away."""
    return one.join(two.withColumnRenamed("features", "_f"), key).select(key, F.concat("features", "_f").alias("features"))


def dimensions(blocks: DataFrame, kind: str) -> DataFrame:
    """kind, dims: the longest feature array of a kind."""
    return blocks.groupBy(kind).agg(F.max(F.size("features")).alias("dims"))


def standardised(rows: DataFrame, fold: str, dim: str, value: str) -> DataFrame:
    """Adds z: the value by mean and population deviation of all other folds; a constant column gives 0, one without another fold null.

    A fold's training part is the whole without the fold, so sums per fold are enough and no row is repeated.
    The variance comes from sums of squares: values far from zero should be centred first.
    """
    v = F.col(value)
    part = rows.groupBy(dim, fold).agg(F.count(value).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    whole = part.groupBy(dim).agg(*[F.sum(c).alias(c + "w") for c in ("_n", "_s", "_q")])
    n = F.col("_nw") - F.col("_n")
    mean = F.try_divide(F.col("_sw") - F.col("_s"), n)
    variance = F.try_divide(F.col("_qw") - F.col("_q"), n) - mean * mean
    spread = part.join(whole, dim).select(dim, fold, mean.alias("_m"), F.when(n > 0, F.greatest(variance, F.lit(0.0))).alias("_v"))
    z = F.when(F.col("_v") > 1e-12, (v - F.col("_m")) / F.sqrt("_v")).when(F.col("_v").isNotNull(), 0.0)
    return rows.join(spread, [dim, fold]).withColumn("z", z).drop("_m", "_v")


def permuted_labels(rows: DataFrame, label: str, seed: int, key: str = "id") -> DataFrame:
    """key, label: the labels dealt anew: the n-th row by one hash gets the label of the n-th by another."""
    all_ = rows.select(key, label, F.lit("all").alias("_all"))
    to = rules.numbered(all_, "_all", rules.seeded(seed, key), key, "_at").select(key, "_at")
    of = rules.numbered(all_, "_all", rules.seeded(seed + 1, key), key, "_at").select(label, "_at")
    return to.join(of, "_at").drop("_at")


def permuted_hits(rows: DataFrame, config: str, seeds: range) -> DataFrame:
    """config, seed, n, hits: how many predictions equal the label that a permutation of their configuration deals them, once per seed.

    Per seed, the n-th prediction by one hash meets the n-th label by another. What moves is an id and a bit per row, side and
    seed: a group (a hash's first three digits) is put in the order of the hashes, which are made anew, and from there on bits move
    as arrays, cut where both sides' places meet.
    """
    own = rows.select(config, "id", F.col("y").cast("boolean").alias("y"), F.col("pred").cast("boolean").alias("pred"))
    drawn = [(seed, side, seed + 1000 * side) for seed in seeds for side in (0, 1)]
    named = [F.struct(F.lit(n).alias("d"), F.col("y" if side else "pred").alias("bit"), F.substring(rules.seeded(of, "id"), 1, 3).alias("cut")) for n, (_, side, of) in enumerate(drawn)]
    at = F.conv("cut", 16, 10).cast("int") + F.lit(CUTS) * F.col("d")
    each = own.select(config, "id", F.inline(F.array(*named))).select(config, "id", "bit", at.alias("at"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() * len(drawn) // ROWS + 1)
    lists = each.repartition(parts, config, "at").groupBy(config, "at").agg(F.collect_list(F.struct("id", "bit")).alias("_l"))
    table = F.array(*[F.struct(F.lit(seed).alias("seed"), F.lit(side).alias("side"), F.lit(of).alias("of")) for seed, side, of in drawn])
    lists = lists.select(config, "at", "_l", F.get(table, F.floor(F.col("at") / CUTS).cast("int")).alias("_d")).select(config, "at", "_d.*", "_l")
    order = F.transform("_l", lambda x: F.struct(F.md5(F.concat_ws("|", F.col("of").cast("string"), x["id"].cast("string"))).alias("h"), x["id"].alias("id"), x["bit"].alias("bit")))
    bits = durable(lists.select(config, "seed", "side", "at", F.sort_array(order).getField("bit").alias("bits")))
    before = W.partitionBy(config, "seed", "side").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    starts = bits.select(config, "seed", "side", "at", F.coalesce(F.sum(F.size("bits")).over(before), F.lit(0)).alias("first"))
    placed = prefix.joined(bits, starts, [config, "seed", "side", "at"])
    first, end = F.col("first"), F.col("first") + F.size("bits")
    block = placed.select("*", F.explode(F.sequence(F.floor(first / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    lo, hi = F.greatest(first, F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    piece = F.struct("side", lo.alias("lo"), F.slice("bits", (lo - first + 1).cast("int"), (hi - lo).cast("int")).alias("bits"))
    whole = block.select(config, "seed", "block", piece.alias("piece")).groupBy(config, "seed", "block").agg(F.sort_array(F.collect_list("piece")).alias("_p"))
    of = lambda side: F.flatten(F.filter("_p", lambda x: x["side"] == side).getField("bits"))
    equal = whole.select(config, "seed", F.zip_with(of(0), of(1), lambda a, b: a == b).alias("_e"))
    known = F.size(F.filter("_e", lambda x: x.isNotNull())).cast("long")
    return equal.groupBy(config, "seed").agg(F.sum(known).alias("n"), F.sum(F.size(F.filter("_e", lambda x: x)).cast("long")).alias("hits"))


def masked_otsu(image: DataFrame, mask: Column) -> DataFrame:
    """image_id, threshold, cnr of the pixels within a mask alone; null where a class is empty."""
    inside = image.filter(mask)
    both = inside.join(features.otsu(inside), "image_id", "left").withColumn("_fg", F.col("value") > F.col("threshold"))
    up, down = F.when(F.col("_fg"), F.col("value")), F.when(~F.col("_fg"), F.col("value"))
    return both.groupBy("image_id").agg(F.max("threshold").alias("threshold"), ((F.avg(up) - F.avg(down)) / (F.stddev_pop(down) + 1e-6)).alias("cnr"))


def similarity(pairs: DataFrame, image: DataFrame) -> DataFrame:
    """a, b, r: Pearson's r of the pixels of two strips, for stated pairs (a, b); null if one is constant."""
    one = image.select(F.col("image_id").alias("a"), "row", "col", F.col("value").alias("_x"))
    two = image.select(F.col("image_id").alias("b"), "row", "col", F.col("value").alias("_y"))
    x, y = F.col("_x").cast("double"), F.col("_y").cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.when(spread > 0, F.covar_pop(x, y) / spread)
    return pairs.join(one, "a").join(two, ["b", "row", "col"]).groupBy("a", "b").agg(r.alias("r"))


def difference_map(image: DataFrame) -> DataFrame:
    """row, col, cohen_d, welch_t, p, q: the classes' difference at every place by the pooled deviation, Welch's test, and q over all places.

    p is 1 where the test isn't defined (no variance, or a class of one).
    """
    of = lambda f, k: f(F.when(F.col("label") == k, F.col("value")))
    s = image.groupBy("row", "col").agg(*[of(f, k).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    gap, n1, n0 = F.col("m1") - F.col("m0"), F.col("n1"), F.col("n0")
    pooled = F.greatest(F.sqrt(F.try_divide((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0"), n1 + n0 - 2)), F.lit(1e-9))
    a, b = F.try_divide(F.col("v1"), n1), F.try_divide(F.col("v0"), n0)
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n0 - 1))
    tests = s.select("row", "col", (gap / pooled).alias("cohen_d"), F.try_divide(gap, F.sqrt(a + b)).alias("welch_t"), df.alias("_df"))
    p = F.coalesce(F.nanvl(comparison.t_two_sided(F.coalesce("welch_t", F.lit(float("nan"))), F.coalesce("_df", F.lit(0.0))), F.lit(1.0)), F.lit(1.0))
    tests = tests.withColumn("p", p).withColumn("_all", F.lit("all"))
    return rules.benjamini_hochberg(tests, "_all").select("row", "col", "cohen_d", "welch_t", "p", "q")


def difference_summary(places: DataFrame, height: int) -> DataFrame:
    """One row of a difference map: median and largest d, the share of places with q below 0.05, and the mean d of three bands of rows, the first ones one larger where rows are left over."""
    d = F.abs("cohen_d")
    ends = [height // 3 + (height % 3 > 0), 2 * (height // 3) + min(height % 3, 2)]
    band = F.when(F.col("row") < ends[0], 0).when(F.col("row") < ends[1], 1).otherwise(2)
    share = F.avg((F.col("q") < 0.05).cast("int"))
    return places.agg(F.percentile(d, 0.5).alias("median_d"), F.max(d).alias("max_d"), share.alias("significant"), *[F.avg(F.when(band == k, d)).alias(f"d_{k}") for k in range(3)])
