"""Intake audit: exact copies, label conflicts, overlap between layouts, empty columns, similar images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import prefix, similar
from stripcohort.sources import shared as shared_tables


def unique_within(images: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """One row per key and hash, the first by order. Only ids and hashes are shuffled: join what else is wanted to the survivors."""
    first = images.groupBy(*keys, "sha").agg(F.min(order).alias(order))
    return first.select(*keys, order, "sha")


def copies(images: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each id that goes: its hash, and the id that stays (the least). However many copies an image has, none is a long row."""
    first = images.groupBy(*keys, "sha").agg(F.min("id").alias("kept"))
    return prefix.joined(images.select(*keys, "sha", F.col("id").alias("removed")), first, [*keys, "sha"]).filter("removed <> kept").select(*keys, "sha", "kept", "removed")


def label_conflicts(images: DataFrame) -> DataFrame:
    """Hashes that stand under more than one label, with an id of either."""
    return images.groupBy("sha").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("id", F.struct("label", "id")).alias("id_lo"), F.max_by("id", F.struct("label", -F.col("id"))).alias("id_hi")).filter("lo <> hi")


def multiplicity(images: DataFrame, keys: list[str]) -> DataFrame:
    """How many hashes occur how many times."""
    return images.groupBy(*keys, "sha").agg(F.count(F.lit(1)).alias("copies")).groupBy(*keys, "copies").agg(F.count(F.lit(1)).alias("hashes"))


def audit(images: DataFrame, key: str = "layout") -> DataFrame:
    """Rows and unique images per class, removed copies, and the largest multiplicity, per layout."""
    per = images.groupBy(key, "label", "sha").agg(F.count(F.lit(1)).alias("n"))
    of = lambda label, what: F.coalesce(F.sum(F.when(F.col("label") == label, what)), F.lit(0)).cast("long")
    return per.groupBy(key).agg(of(0, F.col("n")).alias("rows_0"), of(1, F.col("n")).alias("rows_1"), of(0, F.lit(1)).alias("unique_0"), of(1, F.lit(1)).alias("unique_1"), (F.sum("n") - F.count(F.lit(1))).cast("long").alias("removed"), F.max("n").alias("most_copies"))


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many different images two layouts share."""
    return a.select("sha").intersect(b.select("sha")).agg(F.count(F.lit(1)).alias("shared"))


def membership(images: DataFrame, sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Share of rows whose image is in each side."""
    out = images
    for name, side in sides.items():
        seen = side.select("sha").distinct().withColumn(f"_{name}", F.lit(1))
        out = out.join(seen, "sha", "left")
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("double")).alias(f"in_{n}") for n in sides])


def empty_columns(image: DataFrame) -> DataFrame:
    """image_id, col of columns that are 0 in every row."""
    return image.groupBy("image_id", "col").agg(F.max("value").alias("top")).filter("top = 0").select("image_id", "col")


def mirrored(image: DataFrame, width: int) -> DataFrame:
    """image_id, n_empty, mirrored: whether the one empty column is the middle one."""
    n = image.groupBy("image_id", "col").agg((F.max("value") == 0).alias("empty"))
    return n.groupBy("image_id").agg(F.count_if("empty").alias("n_empty"), F.min(F.when(F.col("empty"), F.col("col"))).alias("at")).select("image_id", "n_empty", ((F.col("n_empty") == 1) & F.coalesce(F.col("at") == width // 2, F.lit(False))).alias("mirrored"))


def repair_seam(image: DataFrame, width: int) -> DataFrame:
    """Empty columns become the floor of the mean of the nearest others to the left and right, around the circle.

    Images without an empty column, or with half of them or more, stay as they are.
    """
    empty = empty_columns(image).withColumn("empty", F.lit(True))
    marked = image.join(empty, ["image_id", "col"], "left").withColumn("empty", F.coalesce("empty", F.lit(False)))
    solid = F.when(~F.col("empty"), F.col("value"))
    line = W.partitionBy("image_id", "row").orderBy("col")
    # around the circle: what lies beyond an end is the far end's nearest
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.coalesce(F.last(solid, True).over(line.rowsBetween(W.unboundedPreceding, -1)), F.last(solid, True).over(whole))
    right = F.coalesce(F.first(solid, True).over(line.rowsBetween(1, W.unboundedFollowing)), F.first(solid, True).over(whole))
    n_empty = F.count_if("empty").over(whole)
    out = marked.withColumns({"left": left, "right": right, "n": n_empty})
    fixed = F.when(F.col("empty") & (F.col("n") < width // 2), F.floor((F.col("left") + F.col("right")) / 2).cast("int")).otherwise(F.col("value"))
    return out.select("image_id", "row", "col", fixed.alias("value"))


def unmirror(image: DataFrame, flags: DataFrame, width: int) -> DataFrame:
    """Mirrored images rolled by half their width and turned round; others as they are. A relabelling of columns."""
    to = F.pmod(F.lit(width - 1 + width // 2) - F.col("col"), F.lit(width))
    return image.join(flags.select("image_id", "mirrored"), "image_id").select("image_id", "row", F.when(F.col("mirrored"), to).otherwise(F.col("col")).cast("int").alias("col"), "value")


def cohort_audit(images: DataFrame, width: int, least: float = 0.97) -> DataFrame:
    """Per layout: rows and unique images per class, removed copies, the largest multiplicity, unique mirrored images per class, unique images whose seam
    is repaired, pairs of them that correlate by least or more, and the groups that these make (lone images too).

    images is (layout, label, image_id, row, col, value), whole rectangles, read once: an image becomes one row with its
    values as an array, written to the shared folder. Copies and near pairs are found within a layout; a strip that
    other layouts hold too counts in each, under the same id or another.
    """
    cells = F.sort_array(F.collect_list(F.struct("row", "col", "value")))
    whole = shared_tables.durable(images.groupBy("layout", "label", F.col("image_id").alias("id")).agg(cells.getField("value").alias("v")))
    empty = F.expr(f"transform(sequence(0, {width - 1}), c -> forall(sequence(c, size(v) - 1, {width}), i -> v[i] = 0))")
    sha = F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)
    hashed = shared_tables.durable(whole.select("layout", "label", "id", "v", sha.alias("sha"), empty.alias("e")))
    first = hashed.groupBy("layout", "sha").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    n_empty = F.size(F.filter("e", lambda x: x))
    marked = hashed.withColumns({"n_empty": n_empty, "mirrored": (n_empty == 1) & F.get("e", F.lit(width // 2))})
    unique = shared_tables.durable(marked.join(first.select("layout", "id"), ["layout", "id"]).withColumn("uid", F.monotonically_increasing_id()))
    by = lambda c: F.count_if(c)
    rows = hashed.groupBy("layout").agg(by(F.col("label") == 0).alias("rows_0"), by(F.col("label") == 1).alias("rows_1"))
    some = first.groupBy("layout").agg((F.sum("n") - F.count(F.lit(1))).alias("removed"), F.max("n").alias("most_copies"))
    seam = (F.col("n_empty") > 0) & (F.col("n_empty") < width // 2)
    of = {f"{name}_{k}": by((F.col("label") == k) & on) for name, on in (("unique", F.lit(True)), ("mirrored", F.col("mirrored"))) for k in (0, 1)}
    kept = unique.groupBy("layout").agg(*[c.alias(n) for n, c in of.items()], by(seam).alias("repaired"), F.count(F.lit(1)).alias("_all"))
    # an empty column takes the mean of the nearest others around the circle, as repair_seam gives it
    side = lambda step: F.expr(f"transform(sequence(0, {width - 1}), c -> get(filter(transform(sequence(1, {width - 1}), k -> (c + {width} {step} k) % {width}), x -> not e[x]), 0))")
    sided = unique.select("layout", F.col("uid").alias("id"), "v", "e", seam.alias("seam"), side("-").alias("l"), side("+").alias("r"))
    mended = F.expr(f"transform(v, (x, i) -> cast(if(seam and e[i % {width}], floor((v[i - i % {width} + l[i % {width}]] + v[i - i % {width} + r[i % {width}]]) / 2), x) as double))")
    vectors = shared_tables.durable(sided).select("layout", "id", mended.alias("v"))
    layout_of = unique.select(F.col("uid").alias("id"), "layout")
    near = similar.near_pairs(vectors, least, within="layout")
    pairs = shared_tables.durable(near.join(layout_of, F.col("id") == F.col("a")).select("layout", "a", "b"))
    linked = pairs.groupBy("layout").agg(F.count(F.lit(1)).alias("near_pairs"))
    named = similar.groups(pairs).join(layout_of, "id").groupBy("layout").agg((F.count(F.lit(1)) - F.count_distinct("group_id")).alias("_fewer"))
    out = rows
    for part in (some, kept):
        out = prefix.joined(out, part, ["layout"])
    for part in (linked, named):
        out = prefix.joined(out, part, ["layout"], "left")
    zero = F.lit(0).cast("long")
    groups = (F.col("_all") - F.coalesce("_fewer", zero)).alias("groups")
    return out.select("layout", "rows_0", "rows_1", "unique_0", "unique_1", "removed", "most_copies", "mirrored_0", "mirrored_1", "repaired", F.coalesce("near_pairs", zero).alias("near_pairs"), groups)
