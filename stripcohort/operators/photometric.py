"""Photometric operators on images in long form (image_id, row, col, value).

Everything that concerns one image is a window or an aggregate over image_id, so images spread over the cluster and
one shuffle by image serves a whole chain of operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import neighbourhoods
from stripcohort.sources.shared import durable

#: The representations and whether they read the green channel (vessel maps) or gray.
REPRESENTATIONS = {"original": "gray", "histogram": "gray", "clahe": "gray", "blur": "gray", "frangi": "green", "gabor": "green", "blackhat": "green", "combined": "green"}


def of_image() -> WindowSpec:
    return W.partitionBy("image_id")


def channels(image: DataFrame) -> DataFrame:
    """Adds gray, h, s, v to b, g, r (0..255); hue runs to 179, ties round up."""
    top, low = F.greatest("b", "g", "r"), F.least("b", "g", "r")
    d = (top - low).cast("double")
    turn = lambda base, x, y: base + F.lit(30.0) * (F.col(x) - F.col(y)) / d
    hue = F.when(d == 0, 0.0).when(F.col("r") == top, turn(F.lit(0.0), "g", "b")).when(F.col("g") == top, turn(F.lit(60.0), "b", "r")).otherwise(turn(F.lit(120.0), "r", "g"))
    return image.withColumns(
        {
            "gray": F.expr("(299 * r + 587 * g + 114 * b + 500) div 1000").cast("int"),
            "h": F.pmod(F.floor(hue + 0.5), F.lit(180)).cast("int"),
            "s": F.when(top == 0, 0).otherwise(F.floor((510 * (top - low) + top) / (2 * top))).cast("int"),
            "v": top.cast("int"),
        }
    )


def fan_out(image: DataFrame) -> DataFrame:
    """Each pixel once per representation, with the channel that it reads and that channel's value, before any transform. No shuffle: rows are exploded."""
    pairs = F.array(*[F.struct(F.lit(n).alias("representation"), F.lit(c).alias("channel"), F.col({"gray": "gray", "green": "g"}[c]).alias("value")) for n, c in REPRESENTATIONS.items()])
    return image.select("image_id", "row", "col", F.inline(pairs))


def equalise(image: DataFrame) -> DataFrame:
    """Global histogram equalisation; an image of one value stays."""
    upto = F.count(F.lit(1)).over(of_image().orderBy("value").rangeBetween(W.unboundedPreceding, 0))
    out = image.withColumns({"_c": upto, "_n": F.count(F.lit(1)).over(of_image())}).withColumn("_0", F.min("_c").over(of_image()))
    new = F.when(F.col("_n") == F.col("_0"), F.col("value")).otherwise(F.rint((F.col("_c") - F.col("_0")) * 255.0 / (F.col("_n") - F.col("_0"))))
    return out.withColumn("value", new.cast("int")).drop("_c", "_n", "_0")


def min_max(image: DataFrame) -> DataFrame:
    """To 0..255, truncated; a constant image becomes 0."""
    lo, hi = F.min("value").over(of_image()), F.max("value").over(of_image())
    out = image.withColumns({"_lo": lo, "_hi": hi})
    return out.withColumn("value", F.when(F.col("_hi") - F.col("_lo") < 1e-12, 0).otherwise(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255.0)).cast("int")).drop("_lo", "_hi")


def stretch(image: DataFrame, low: float = 0.02, high: float = 0.99, gamma: float = 0.7) -> DataFrame:
    """Between two percentiles, raised to gamma, truncated; where they meet, as min_max."""
    ends = F.percentile("value", F.array(F.lit(low), F.lit(high))).over(of_image())
    out = image.withColumns({"_p": ends, "_lo": F.min("value").over(of_image()), "_hi": F.max("value").over(of_image())})
    a, b = F.col("_p")[0], F.col("_p")[1]
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - a) / (b - a)))
    plain = F.when(F.col("_hi") - F.col("_lo") < 1e-12, 0).otherwise(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255.0))
    return out.withColumn("value", F.when(b - a < 1e-12, plain).otherwise(F.floor(F.round(F.pow(part, F.lit(gamma)) * 255.0, 9))).cast("int")).drop("_p", "_lo", "_hi")


def normalise(image: DataFrame, mean: float = 128.0, std: float = 50.0) -> DataFrame:
    """To a mean and a population deviation, clipped and truncated; a constant image becomes the mean. Moments come from whole sums."""
    v = F.col("value").cast("long")
    out = image.withColumns({"_n": F.count(F.lit(1)).over(of_image()), "_s": F.sum(v).over(of_image()), "_q": F.sum(v * v).over(of_image())})
    spread = F.col("_n").cast("double") * F.col("_q") - F.col("_s").cast("double") * F.col("_s")
    new = (F.col("value") - F.col("_s") / F.col("_n")) / (F.sqrt(spread) / F.col("_n")) * std + mean
    return out.withColumn("value", F.when(spread == 0, F.floor(F.lit(mean))).otherwise(F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), new)))).cast("int")).drop("_n", "_s", "_q")


def crop_upper(image: DataFrame, rows: int) -> DataFrame:
    """Without the first rows; the rest move up."""
    return image.filter(F.col("row") >= rows).withColumn("row", F.col("row") - rows)


def vessel_maps(green: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    """frangi, gabor, blackhat and combined (0.6 and 0.4 of the first and third) of the locally equalised green channel, each 0..255.

    What more than one of them reads is a table in the shared folder.
    """
    fine = lambda df, n: neighbourhoods.placed(df.withColumn("value", F.round("value", n)))
    even = neighbourhoods.by_image(durable(neighbourhoods.local_equalised(green, height, width).select("image_id", "row", "col", "value")))
    frangi = durable(stretch(fine(neighbourhoods.vesselness(even, height, width), 12)))
    blackhat = durable(min_max(neighbourhoods.fine_structures(even, height)))
    both = frangi.join(blackhat.withColumnRenamed("value", "_other"), ["image_id", "row", "col"])
    combined = min_max(both.select("image_id", "row", "col", (F.col("value") / 255.0 * 0.6 + F.col("_other") / 255.0 * 0.4).alias("value")))
    return {"frangi": frangi, "gabor": min_max(fine(neighbourhoods.oriented(even, height, width), 9)), "blackhat": blackhat, "combined": combined}


#: Every representation's transform, as functions of image, height and width.
TRANSFORMS = {
    "original": lambda image, h, w: image,
    "histogram": lambda image, h, w: equalise(image),
    "clahe": neighbourhoods.local_equalised,
    "blur": neighbourhoods.smoothed,
} | {name: lambda image, h, w, name=name: vessel_maps(image, h, w)[name] for name in ("frangi", "gabor", "blackhat", "combined")}


def transformed(image: DataFrame, height: int, width: int) -> DataFrame:
    """Each image under every transform: image_id, representation, row, col, value (b, g, r, gray given).

    The maps of vessels read one equalised green channel.
    """
    image = neighbourhoods.by_image(image)
    channel = {of: neighbourhoods.placed(image.select("image_id", "row", "col", F.col(of).alias("value"))) for of in ("gray", "g")}
    each = {name: TRANSFORMS[name](channel["gray"], height, width) for name in ("original", "histogram", "clahe", "blur")} | vessel_maps(channel["g"], height, width)
    return reduce(DataFrame.unionByName, [out.select("image_id", F.lit(name).alias("representation"), "row", "col", F.col("value").cast("int").alias("value")) for name, out in each.items()])


def perturbations(value: Column) -> Column:
    """An array of (kind, value): six point perturbations of a value 0..255. Shifts, factors and exponents."""
    cut = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), c.cast("int")))
    power = lambda g: cut(F.floor(F.pow(value / 255.0, F.lit(g)) * 255.0 + 0.5))
    kinds = {
        "brightness-": cut(value - 30),
        "brightness+": cut(value + 30),
        "contrast-": cut(F.rint(value * 0.7)),
        "contrast+": cut(F.rint(value * 1.3)),
        "gamma-": power(0.7),
        "gamma+": power(1.5),
    }
    return F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()])


def perturb(image: DataFrame) -> DataFrame:
    """Each pixel under each point perturbation; a projection, no lookup table and no join."""
    return image.select("image_id", "row", "col", F.inline(perturbations(F.col("value"))))


def ring(image: DataFrame, x: float, y: float, inner: float, outer: float) -> DataFrame:
    """Pixels inside the outer circle and outside the inner one."""
    away = F.hypot(F.col("col") - F.lit(x), F.col("row") - F.lit(y))
    return image.filter((away <= outer) & (away > inner))
