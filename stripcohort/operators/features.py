"""Features of images in long form: textures, intensities, thresholds, and sweeps over regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import neighbourhoods
from stripcohort.sources.shared import durable

#: Distance, angle in degrees, and the step in rows and columns.
OFFSETS = [(1, 0, 0, 1), (1, 45, 1, 1), (1, 90, 1, 0), (1, 135, 1, -1), (2, 0, 0, 2), (2, 45, 1, 1), (2, 90, 2, 0), (2, 135, 1, -1), (3, 0, 0, 3), (3, 45, 2, 2), (3, 90, 3, 0), (3, 135, 2, -2)]


def cooccurrence(image: DataFrame, levels: int = 64) -> DataFrame:
    """image_id, distance, angle, and six properties of the symmetric co-occurrence matrix; correlation is 1 if a level stands alone.

    An image is one array (a whole rectangle, row by row), so a pixel finds its neighbours by place: one shuffle by image. Each step's
    properties come from the array of its pairs inside a row, cells from runs of equal ones, so a task holds an image, not its cells.
    """
    level = F.floor(F.col("value") * levels / 256).cast("int")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", level.alias("i")))), lambda x: x["i"])
    one = image.groupBy("image_id").agg(whole.alias("v"), (F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("distance", "angle", "dr", "dc"), o, strict=True)]) for o in OFFSETS])
    each = one.select("image_id", "v", "w", "h", F.inline(steps)).filter("dr < h and abs(dc) < w")
    # places whose neighbour lies inside, then the pair of levels at both
    down = F.expr("sequence(0, h - 1 - dr)")
    along = F.expr("sequence(greatest(0, -dc), least(w, w - dc) - 1)")
    pairs = F.flatten(F.transform(down, lambda r: F.transform(along, lambda c: F.struct(F.get("v", r * F.col("w") + c).alias("i"), F.get("v", (r + F.col("dr")) * F.col("w") + c + F.col("dc")).alias("j")))))
    met = each.select("image_id", "distance", "angle", pairs.alias("_p"))
    # a cell's number, both ways round; levels that are null have cells of their own
    cell = f"(coalesce({{}}, -1) + 1) * {levels + 1} + coalesce({{}}, -1) + 1"
    codes = F.expr(f"array_sort(concat(transform(_p, x -> {cell.format('x.i', 'x.j')}), transform(_p, x -> {cell.format('x.j', 'x.i')})))")
    runs = "aggregate(_c, struct(-1 as at, 0L as n, 0L as sum), (s, c) -> if(c = s.at, struct(c as at, s.n + 1 as n, s.sum + 2 * s.n + 1 as sum), struct(c as at, 1L as n, s.sum + 1 as sum)), s -> s.sum)"
    at = met.select("image_id", "distance", "angle", "_p", F.expr("filter(_p, x -> x.i is not null and x.j is not null)").alias("_k"), codes.alias("_c"))
    total = lambda of, start, x: f"aggregate({of}, {start}, (s, x) -> s + {x})"
    gap = "(x.i - x.j)"
    named = {
        "t": "2 * size(_p)",
        "contrast": f"2 * {total('_k', '0L', f'{gap} * {gap}')}",
        "dissimilarity": f"2 * {total('_k', '0L', f'abs({gap})')}",
        "homogeneity": f"2 * {total('_k', '0D', f'1 / (1D + {gap} * {gap})')}",
        "asm": runs,
        "si": total("_p", "0L", "coalesce(x.i, 0) + coalesce(x.j, 0)"),
        "sii": total("_p", "0L", "coalesce(x.i * x.i, 0) + coalesce(x.j * x.j, 0)"),
        "sij": f"2 * {total('_k', '0L', 'x.i * x.j')}",
    }
    sums = at.select("image_id", "distance", "angle", (F.size("_k") > 0).alias("_known"), *[F.expr(e).cast("double").alias(n) for n, e in named.items()])
    t = F.col("t")
    var = t * F.col("sii") - F.col("si") * F.col("si")
    asm = F.col("asm") / (t * t)
    known = lambda c: F.when(F.col("_known"), c)
    correlation = F.when(var == 0, 1.0).otherwise((t * F.col("sij") - F.col("si") * F.col("si")) / var)
    return sums.select("image_id", "distance", "angle", *[known(F.col(n) / t).alias(n) for n in ("contrast", "dissimilarity", "homogeneity")], F.sqrt(asm).alias("energy"), known(correlation).alias("correlation"), asm.alias("asm"))


def intensity(image: DataFrame, keys: list[str]) -> DataFrame:
    """mean, population std, skewness and excess kurtosis of value per key; the latter are 0 where all values are equal."""
    flat = F.min("value") == F.max("value")
    return image.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis("value")).alias("kurt"))


def histogram(image: DataFrame, keys: list[str], bins: int = 32, top: int = 255) -> DataFrame:
    """Density per bin over [0, top], the last bin closed; bins without values have no row."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("value") * bins / top)).cast("int")
    n = image.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, "bin", (F.col("n") / F.sum("n").over(W.partitionBy(*keys)) / (top / bins)).alias("density"))


def pattern_histogram(codes: DataFrame) -> DataFrame:
    """image_id, bin, density of the codes of an image; codes that it doesn't hold have no row."""
    n = codes.groupBy("image_id", F.col("code").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("image_id", "bin", (F.col("n") / F.sum("n").over(W.partitionBy("image_id"))).alias("density"))


def otsu(image: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, threshold: the least value that parts the histogram with the largest variance between the classes; null if all values are equal."""
    n = image.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    of = {"w": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col("value")).over(upto), "n_all": F.sum("n").over(whole), "s_all": F.sum(F.col("n") * F.col("value")).over(whole)}
    cum = n.select(*keys, "value", *[c.cast("double").alias(k) for k, c in of.items()])
    gap = F.col("s") * F.col("n_all") - F.col("w") * F.col("s_all")
    between = cum.filter("w < n_all").withColumn("b", gap * gap / (F.col("w") * (F.col("n_all") - F.col("w"))))
    best = between.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("b"), F.col("value"))).alias("threshold"))
    return image.select(*keys).distinct().join(best, list(keys), "left")


def contrast(image: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """keys, cnr: the mean where on holds less that elsewhere, by the deviation elsewhere; null without both classes."""
    up, down = F.when(on, F.col("value")), F.when(~on, F.col("value"))
    return image.groupBy(*keys).agg(((F.avg(up) - F.avg(down)) / (F.stddev_pop(down) + 1e-6)).alias("cnr"))


def visibility(image: DataFrame, height: int, width: int) -> DataFrame:
    """density over the threshold, contrast to noise, rms contrast, entropy in bits and ridge energy (variance of the Laplacian) per image; no contrast to noise without both classes."""
    marked = image.join(otsu(image), "image_id").withColumn("fg", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)))
    n = marked.groupBy("image_id", "value", "fg").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("image_id"))
    v, k = F.col("value"), F.col("n")
    of = lambda c, what: F.sum(F.when(c, what))
    fg, bg = F.col("fg"), ~F.col("fg")
    named = {"n": F.sum(k), "s": F.sum(k * v), "q": F.sum(k * v * v), "nf": of(fg, k), "sf": of(fg, k * v), "nb": of(bg, k), "sb": of(bg, k * v), "qb": of(bg, k * v * v), "entropy": -F.sum(F.col("p") * F.log2("p"))}
    sums = n.withColumn("p", share).groupBy("image_id").agg(*[c.alias(name) for name, c in named.items()])
    sd = lambda a, s, q: F.sqrt(F.col(a) * F.col(q) - F.col(s) * F.col(s)) / F.col(a)
    ridge = neighbourhoods.weighted(image, neighbourhoods.LAPLACE, height, width).groupBy("image_id").agg((F.var_pop("sum") / 255**2).alias("ridge"))
    cnr = (F.col("sf") / F.col("nf") - F.col("sb") / F.col("nb")) / (sd("nb", "sb", "qb") + 1e-6)
    out = sums.select("image_id", (F.coalesce("nf", F.lit(0)) / F.col("n")).alias("density"), cnr.alias("cnr"), (sd("n", "s", "q") / 255).alias("rms"), "entropy")
    return out.join(ridge, "image_id")


def radial_profile(image: DataFrame) -> DataFrame:
    """Per image and row: share of pixels over the image's threshold, and the mean."""
    marked = image.join(otsu(image), "image_id")
    return marked.groupBy("image_id", "row").agg(F.avg(F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).cast("double")).alias("share"), F.avg("value").alias("mean"))


def mask_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """dice of two masks, r of their values, either's contrast to noise, and the share of a's that b retains, per key; rows (image_id, row, col, value, on). Keys that only b has are its perturbations."""
    other = [k for k in keys if k != "image_id"]
    on = ["image_id", "row", "col", *[k for k in other if k in a.columns]]
    return overlap(a.join(b.select("image_id", "row", "col", *other, F.col("value").alias("value2"), F.col("on").alias("on2")), on), keys)


def overlap(both: DataFrame, keys: list[str]) -> DataFrame:
    """mask_overlap() of rows that hold both sides (value, on, value2, on2)."""
    total = F.count_if("on") + F.count_if("on2")

    def cnr(value: str, on: str) -> Column:
        up, down = F.when(F.col(on), F.col(value)), F.when(~F.col(on), F.col(value))
        return (F.avg(up) - F.avg(down)) / (F.stddev_pop(down) + 1e-6)

    dice = F.when(total > 0, 2 * F.count_if(F.col("on") & F.col("on2")) / total)
    out = both.groupBy(*keys).agg(dice.alias("dice"), F.corr("value", "value2").alias("r"), cnr("value", "on").alias("cnr"), cnr("value2", "on2").alias("cnr2"))
    return out.withColumn("retained", F.try_divide("cnr2", "cnr"))


def dominant_scale(responses: DataFrame) -> DataFrame:
    """image_id, scale, share, mean of responses (image_id, row, col, scale, value): the share of structure pixels, whose largest response is over
    its threshold, where the scale answers most (of equals the smallest), and its mean response over all pixels. Responses are
    read from a table in the shared folder, so they are made once."""
    responses = durable(responses.select("image_id", "row", "col", "scale", "value"))
    top = responses.groupBy("image_id", "row", "col").agg(F.max("value").alias("value"), F.min_by("scale", F.struct(-F.col("value"), F.col("scale"))).alias("scale"))
    on = top.join(otsu(top), "image_id").filter("value > threshold").groupBy("image_id", "scale").agg(F.count(F.lit(1)).alias("_n"))
    mean = responses.groupBy("image_id", "scale").agg(F.avg("value").alias("mean"))
    all_ = F.sum("_n").over(W.partitionBy("image_id"))
    return mean.join(on, ["image_id", "scale"], "left").select("image_id", "scale", (F.coalesce("_n", F.lit(0)) / all_).alias("share"), "mean")


def angular_contrast(image: DataFrame, x: float, y: float, sectors_: int, keys: list[str], least: int) -> DataFrame:
    """keys, sector, n, cnr of pixels (value, threshold) in equal sectors around a centre, counted from the right against the clock; those of fewer pixels than least are left out."""
    angle = F.pmod(F.degrees(F.atan2(F.lit(float(y)) - F.col("row"), F.col("col") - F.lit(float(x)))) + 360, F.lit(360.0))
    cut = image.withColumn("sector", F.floor(angle / (360.0 / sectors_)).cast("int"))
    n = cut.groupBy(*keys, "sector").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return n.join(contrast(cut, [*keys, "sector"], F.col("value") > F.col("threshold")), [*keys, "sector"])


def windows(at: Column, last: int, step: int, width: int) -> Column:
    """Starts of all windows of this width (0, step, ... last) that hold a place; empty if none does."""
    first = F.greatest(F.lit(0), F.ceil((at - (width - 1)) / step)).cast("int")
    final = F.least(F.lit(last // step), F.floor(at / step)).cast("int")
    return F.when(first <= final, F.transform(F.sequence(first, final), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def sectors(image: DataFrame, place: Column, last: int, step: int, width: int) -> DataFrame:
    """Each pixel in every overlapping window that it lies in: an explode, no range join."""
    return image.withColumn("start", F.explode(windows(place, last, step, width)))


def grid_cells(image: DataFrame, cells: int, height: int, width: int, top: int = 0) -> DataFrame:
    """cell_row, cell_col of pixels from row top on; rows and columns that don't fill a cell fall away."""
    h, w = max(1, (height - top) // cells), max(1, width // cells)
    out = image.filter(F.col("row") >= top).withColumns({"cell_row": F.floor((F.col("row") - top) / h).cast("int"), "cell_col": F.floor(F.col("col") / w).cast("int")})
    return out.filter((F.col("cell_row") < cells) & (F.col("cell_col") < cells))
