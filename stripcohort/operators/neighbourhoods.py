"""Neighbourhood filters on images in long form (image_id, row, col, value). Images are whole rectangles of a known height and width.

Rows are placed by image once (`by_image`). All later keys begin with image_id, so joins, groups and windows find their
rows where they are, and a chain of filters is one shuffle. Two forms cover every filter:

- `along` multiplies an axis by a band matrix (a pixel meets the few weights of its place): separable filters with any
  border, derivatives, resampling; weights of several results go through one pass;
- `around` gives a pixel its neighbours out of the image as one array, by steps: kernels that aren't separable.

Both are joins or explodes and sums that Spark compiles. Banks of wide kernels, which would give a pixel hundreds of rows, are
matrix products on images as arrays instead (`by_arrays`). Kernels and matrices are made from
their parameters on the driver, and are as large as an axis times a kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the 5 x 5 smoothing per axis, and of the 3 x 3 Laplacian.
SMOOTH = [1, 4, 6, 4, 1]
LAPLACE = [(-1, -1, 2), (-1, 1, 2), (0, 0, -8), (1, -1, 2), (1, 1, 2)]
#: Sizes of the elliptic footprints.
SCALES = (5, 11, 21)
PLACE = ["image_id", "row", "col"]


def by_image(image: DataFrame) -> DataFrame:
    """All rows of an image in one partition; nothing moves if an operator of this module has placed them already.

    The number of partitions is the session's, not fewer: images are small for the work that they take.
    """
    if getattr(image, "placed", False):
        return image
    return placed(image.repartition(int(image.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id"))


def placed(image: DataFrame) -> DataFrame:
    """Marks a table whose rows lie by image."""
    image.placed = True
    return image


# Matrices of an axis: entry [i][k] is the weight of place k for the result at place i.


def folded(at: int, size: int, border: str) -> int | None:
    """Where a place beyond an axis is read: mirror (c b | a b c), reflect (b a | a b c), wrap, or zero (nowhere)."""
    if border == "wrap":
        return at % size
    if border == "zero":
        return at if 0 <= at < size else None
    period = max(1, 2 * size - 2 * (border == "mirror"))
    at %= period
    return at if at < size else period - at - (border == "reflect")


def axis_matrix(size: int, weights: list[float], border: str) -> np.ndarray:
    """Correlation with weights, whose middle lies on the place."""
    out, m = np.zeros((size, size)), len(weights) // 2
    for i in range(size):
        for j, w in enumerate(weights):
            if (k := folded(i + j - m, size, border)) is not None:
                out[i, k] += w
    return out


def gaussian(sigma: float, radius: int) -> list[float]:
    g = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(g) for x in g]


def derivative(sigma: float, radius: int) -> list[float]:
    """The first derivative of a Gaussian."""
    return [i / (sigma * sigma) * w for i, w in zip(range(-radius, radius + 1), gaussian(sigma, radius), strict=True)]


def reduced_axis(size: int, factor: int) -> np.ndarray:
    """An axis at 1/factor: a Gaussian of (factor - 1) / 2, four deviations wide, edges mirrored, then linear interpolation at the new places' centres."""
    sigma, n = (factor - 1) / 2, max(1, round(size / factor))
    blur = axis_matrix(size, gaussian(sigma, int(4 * sigma + 0.5)), "mirror") if sigma > 0 else np.eye(size)
    out = np.zeros((n, size))
    for j in range(n):
        x = min(max((j + 0.5) * size / n - 0.5, 0), size - 1)
        lo = math.floor(x)
        out[j] = (1 - (x - lo)) * blur[lo] + (x - lo) * blur[min(lo + 1, size - 1)]
    return out


def along(image: DataFrame, axis: str, matrices: dict[str, list[np.ndarray]], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """image_id, row, col (and scale, if there is more than one) and, for every name in sums, the sum of a column times a matrix over one axis.

    matrices: name -> one per scale. sums: name -> (column, matrix). A column scale of the image meets its own matrices;
    an image without one meets those of every scale.
    """
    spark, names = image.sparkSession, list(matrices)
    scales = len(matrices[names[0]])
    rows = []
    for s in range(scales):
        stack = np.stack([matrices[n][s] for n in names])
        for i, k in zip(*np.nonzero(np.abs(stack).max(axis=0) > 1e-18), strict=True):
            rows.append((s, int(k), int(i), *stack[:, i, k].tolist()))
    table = spark.createDataFrame(rows, "_scale int, _from int, _to int, " + ", ".join(f"_{n} double" for n in names))
    on = F.col(axis) == F.col("_from")
    if "scale" in image.columns:
        on = on & (F.col("scale") == F.col("_scale"))
    other = "col" if axis == "row" else "row"
    keys = [F.col("image_id"), F.col(other), F.col("_to").alias(axis)] + ([F.col("_scale").alias("scale")] if scales > 1 else [])
    each = by_image(image).join(F.broadcast(table), on)  # as large as an axis times a kernel
    out = each.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col(f"_{m}")).alias(n) for n, (c, m) in sums.items()])
    return placed(out.select(*PLACE, *(["scale"] if scales > 1 else []), *sums))


def separable(image: DataFrame, across: np.ndarray, down: np.ndarray) -> DataFrame:
    """image_id, row, col, value: columns mixed by one matrix, then rows by another."""
    wide = along(image, "col", {"m": [across]}, {"value": ("value", "m")})
    return along(wide, "row", {"m": [down]}, {"value": ("value", "m")})


def smoothed(image: DataFrame, height: int, width: int) -> DataFrame:
    """The 5 x 5 blur of whole numbers, rounded half up."""
    out = separable(image, axis_matrix(width, SMOOTH, "mirror"), axis_matrix(height, SMOOTH, "mirror"))
    return placed(out.withColumn("value", F.floor((F.col("value") + 128) / 256).cast("int")))


def blurred(image: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian blur: 3 sigma to either side, rounded half to even."""
    g = gaussian(sigma, (round(sigma * 6 + 1) | 1) // 2)
    out = separable(image, axis_matrix(width, g, "mirror"), axis_matrix(height, g, "mirror"))
    return placed(out.withColumn("value", F.rint(F.round("value", 9)).cast("int")))


def reduced(image: DataFrame, height: int, width: int, factor: int = 4) -> DataFrame:
    """An image at 1/factor of its size; values aren't rounded."""
    return separable(image, reduced_axis(width, factor), reduced_axis(height, factor))


def noisy(image: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """Gaussian noise by hashes of seed, image and place (Box and Muller), rounded half to even and cut to 0..255."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), "image_id", "row", "col"))
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.sqrt(-2 * F.log(part(1))) * F.cos(2 * math.pi * part(9)) * sigma
    return image.select("image_id", "row", "col", F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.round(F.col("value") + noise, 9)))).cast("int").alias("value"))


# Images as arrays.


def as_array(image: DataFrame, *more: Column | str) -> DataFrame:
    """image_id, pixels (array<double>, row by row) and aggregates of the image."""
    whole = F.sort_array(F.collect_list(F.struct("row", "col", F.col("value").cast("double").alias("value"))))
    return placed(by_image(image).groupBy("image_id").agg(whole.getField("value").alias("pixels"), *more))


def by_arrays(image: DataFrame, height: int, width: int | None, f: Callable[[np.ndarray], np.ndarray], names: tuple[str, ...] = ("value",), at_once: int = 16) -> DataFrame:
    """image_id, row, col and names: what f makes of a stack of images (n, height, width), a stack per name; without a width, an image
    is as wide as its values make it. A task holds few images' stacks at a time; the images are placed anew as arrays."""
    arrays = as_array(image)
    kind = arrays.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("pixels").value_lengths().to_numpy()
            # stacks of images of one size
            starts = [i for i in range(batch.num_rows) if i == 0 or sizes[i] != sizes[i - 1]] + [batch.num_rows]
            for start, stop in ((i, min(i + at_once, b)) for a, b in zip(starts, starts[1:], strict=False) for i in range(a, b, at_once)):
                part = batch.slice(start, stop - start)
                made = f(part.column("pixels").flatten().to_numpy().reshape(part.num_rows, height, -1)).reshape(len(names), -1)
                ends = pa.array(np.arange(part.num_rows + 1) * int(sizes[start]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("image_id"), *[pa.ListArray.from_arrays(ends, pa.array(m, pa.float64())) for m in made]], names=["image_id", *names])

    made = by_image(arrays.mapInArrow(run, f"image_id {kind}, " + ", ".join(f"{n} array<double>" for n in names)))
    across = F.expr(f"size({names[0]}) div {height}").cast("int") if width is None else F.lit(width)
    each = made.select("image_id", across.alias("_n"), F.posexplode(F.arrays_zip(*names)).alias("_i", "_v"))
    return placed(each.select("image_id", F.expr("_i div _n").cast("int").alias("row"), (F.col("_i") % F.col("_n")).cast("int").alias("col"), *[F.col("_v").getField(n).alias(n) for n in names]))


def around(image: DataFrame, height: int, width: int, steps: list[tuple], border: str) -> DataFrame:
    """image_id, row, col, and for every step (rows, columns, weight, ...) of every place: middle and value (the place's and the neighbour's), step (its number), w0, w1, ...

    The neighbour comes out of the image's array; beyond the border as `folded` says, where zero gives 0.
    """
    tall, wide = (max((abs(s[i]) for s in steps), default=0) for i in (0, 1))
    stride = width + 2 * wide

    def tables(n: int, m: int) -> Column:
        return F.expr("array(" + ", ".join("-1" if (k := folded(i, n, border)) is None else str(k) for i in range(-m, n + m)) + ")")

    at = lambda v, r, c: F.when((r < 0) | (c < 0), 0.0).otherwise(F.get(v, r * width + c))
    frame = lambda v: F.flatten(F.transform(tables(height, tall), lambda r: F.transform(tables(width, wide), lambda c: at(v, r, c))))
    framed = F.get(F.transform(F.array("pixels"), frame), 0)  # so the array is made once, not for each of its places
    fields = ["step", "by", *[f"w{j}" for j in range(len(steps[0]) - 2)]]
    listed = ", ".join("struct(" + ", ".join([str(n), str(s[0] * stride + s[1]), *[f"{float(w)!r}D" for w in s[2:]]]) + ")" for n, s in enumerate(steps))
    places = F.sequence(F.lit(0), F.lit(height * width - 1))
    one = as_array(image).select("image_id", framed.alias("_p")).select("image_id", "_p", F.explode(places).alias("_i"))
    row, col = F.expr(f"_i div {width}").cast("int"), (F.col("_i") % width).cast("int")
    here = one.select("image_id", "_p", row.alias("row"), col.alias("col"), ((row + tall) * stride + col + wide).alias("_at"))
    many = here.select("image_id", "_p", "row", "col", "_at", F.inline(F.expr(f"array({listed})")).alias(*fields))
    return placed(many.select(*PLACE, F.get("_p", F.col("_at")).alias("middle"), F.get("_p", F.col("_at") + F.col("by")).alias("value"), *[f for f in fields if f != "by"]))


def weighted(image: DataFrame, steps: list[tuple[int, int, float]], height: int, width: int) -> DataFrame:
    """image_id, row, col, sum: the sum of weight * value over steps (rows, columns, weight) around each place, borders mirrored."""
    return placed(around(image, height, width, steps, "mirror").groupBy(*PLACE).agg(F.sum(F.col("value") * F.col("w0")).alias("sum")))


def gabor_kernels(size: int = 21, sigma: float = 4.0, wave: float = 10.0, aspect: float = 0.5, orientations: int = 8) -> list[tuple]:
    """(row, column, weight of every orientation): cosine waves under an elliptic Gaussian, without a mean."""
    m, places, out = size // 2, [], []
    places = [(r, c) for r in range(-m, m + 1) for c in range(-m, m + 1)]
    for i in range(orientations):
        cos, sin = math.cos(math.pi * i / orientations), math.sin(math.pi * i / orientations)
        turned = [(c * cos + r * sin, -c * sin + r * cos) for r, c in places]
        k = [math.exp(-0.5 * (x * x + aspect * aspect * y * y) / (sigma * sigma)) * math.cos(2 * math.pi * x / wave) for x, y in turned]
        out.append([w - sum(k) / len(k) for w in k])
    return [(*at, *w) for at, w in zip(places, zip(*out, strict=True), strict=True)]


def oriented(image: DataFrame, height: int, width: int, kernels: list[tuple] | None = None) -> DataFrame:
    """image_id, row, col, value: the largest absolute answer of a bank of kernels, all in one product; borders mirrored."""
    kernels = kernels or gabor_kernels()
    tall, wide = (max(abs(k[i]) for k in kernels) for i in (0, 1))
    down, across = ([folded(i, n, "mirror") for i in range(-m, n + m)] for n, m in ((height, tall), (width, wide)))
    weights = np.array([k[2:] for k in kernels]).T

    def answers(images: np.ndarray) -> np.ndarray:
        framed = images[:, down][:, :, across]
        out = np.empty(images.shape)
        for n, one in enumerate(framed):
            shifted = np.stack([one[tall + r : tall + r + height, wide + c : wide + c + width].ravel() for r, c, *_ in kernels])
            out[n] = np.abs(weights @ shifted).max(axis=0).reshape(height, width)
        return out

    return by_arrays(image, height, width, answers)


def second_derivatives(size: int, sigma: float) -> dict[str, np.ndarray]:
    """Matrices of two successive passes along an axis: smoothing twice, and a first derivative before, after or at both. Gaussians of
    sigma / sqrt(2), 8 deviations wide (or as far as weights reach 1e-17 of the largest, for sigma 1), edges repeated."""
    s = sigma / math.sqrt(2)
    radius = int((8 if sigma > 1 else 9) * s + 0.5)
    g, d = axis_matrix(size, gaussian(s, radius), "reflect"), axis_matrix(size, derivative(s, radius), "reflect")
    return {"gg": g @ g, "dg": d @ g, "gd": g @ d, "dd": d @ d}


def vesselness(image: DataFrame, height: int, width: int, sigmas: tuple[float, ...] = (1, 2, 3, 4), beta: float = 0.5, c: float = 15.0) -> DataFrame:
    """image_id, row, col, value of an image 0..255: the largest answer over scales of exp(-(l1/l2)^2 / 2 beta^2) (1 - exp(-(l1^2 + l2^2) / 2 c^2)).

    l1 and l2 are the eigenvalues, by rising size, of the second derivatives of value / 255, turned so that bright ridges
    count, l2 in the quotient 1e-10 at least.
    """
    across, down = ([second_derivatives(size, s) for s in sigmas] for size in (width, height))

    def answers(images: np.ndarray) -> np.ndarray:
        unit, most = images / 255.0, np.full(images.shape, -np.inf)
        for x, y in zip(across, down, strict=True):
            rr, rc, cc = y["dd"] @ (unit @ x["gg"].T), y["gd"] @ (unit @ x["dg"].T), y["gg"] @ (unit @ x["dd"].T)
            mean, root = -(rr + cc) / 2, np.sqrt((rr - cc) ** 2 / 4 + rc * rc)
            a, b = mean - root, mean + root
            first = np.abs(a) <= np.abs(b)
            l1, l2 = np.where(first, a, b), np.where(first, b, a)
            answer = np.exp(-((np.abs(l1) / np.maximum(l2, 1e-10)) ** 2) / (2 * beta * beta)) * (1 - np.exp(-(l1 * l1 + l2 * l2) / (2 * c * c)))
            most = np.maximum(most, answer)
        return most

    return by_arrays(image, height, width, answers)


def circle_steps(points: int, radius: float) -> list[tuple[float, float]]:
    """(rows, columns) of points on a circle, from the right against the clock, to 5 decimals."""
    turn = [2 * math.pi * p / points for p in range(points)]
    return [(round(-radius * math.sin(t), 5), round(radius * math.cos(t), 5)) for t in turn]


def circle_corners(points: int, radius: float) -> list[tuple[int, int, float, int]]:
    """(row, column, weight, point) of the pixels that each point on a circle is interpolated from."""
    out = []
    for p, (dr, dc) in enumerate(circle_steps(points, radius)):
        a, b = math.floor(dr), math.floor(dc)
        y, x = dr - a, dc - b
        corners = [(a, b, (1 - y) * (1 - x)), (a, b + 1, (1 - y) * x), (a + 1, b, y * (1 - x)), (a + 1, b + 1, y * x)]
        out += [(r, c, w, p) for r, c, w in corners if w]
    return out


def binary_patterns(image: DataFrame, height: int, width: int, points: int = 16, radius: float = 2) -> DataFrame:
    """image_id, row, col, code: uniform local binary patterns, the number of points on a circle that are as bright as the middle or
    brighter, or points + 1 if that changes more than twice from one point to the next. Values between pixels are interpolated, beyond the border they are 0."""
    corners = circle_corners(points, radius)
    each = around(image, height, width, corners, "zero")
    value = lambda p: F.sum(F.when(F.col("w1") == p, F.col("value") * F.col("w0")))
    bits = each.groupBy(*PLACE).agg(F.max("middle").alias("_m"), *[value(p).alias(f"_{p}") for p in range(points)])
    bit = F.expr(" + ".join(f"if(round(_{p} - _m, 9) >= 0, {1 << p}, 0)" for p in range(points)))
    coded = bits.select(*PLACE, bit.alias("_b"))
    changes = F.bit_count(F.expr(f"(_b ^ shiftright(_b, 1)) & {(1 << (points - 1)) - 1}"))
    return placed(coded.select(*PLACE, F.when(changes <= 2, F.bit_count("_b")).otherwise(points + 1).cast("int").alias("code")))


# Footprints.


def ellipse(size: int) -> list[tuple[int, int]]:
    """(step in rows, reach in columns) of an elliptic footprint."""
    r = size // 2
    return [(d, round(r * math.sqrt(max(1 - d * d / (r * r), 0)))) for d in range(-r, r + 1)]


def _largest(images: np.ndarray, size: int) -> np.ndarray:
    """The largest value under a footprint, of a stack of images; places beyond the border don't count."""
    n, height, width = images.shape
    r = size // 2
    framed = np.full((n, height + 2 * r, width + 2 * r), -np.inf)
    framed[:, r : r + height, r : r + width] = images
    reach, along_row = {0: framed[:, :, r : r + width]}, framed[:, :, r : r + width]
    for x in range(1, r + 1):
        along_row = np.maximum(along_row, np.maximum(framed[:, :, r - x : r - x + width], framed[:, :, r + x : r + x + width]))
        reach[x] = along_row
    return np.max([reach[x][:, r + d : r + d + height] for d, x in ellipse(size)], axis=0)


def hats(image: DataFrame, height: int, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """image_id, size, row, col, closed, opened: the image's closing and opening under each footprint, all in one pass."""
    kind = image.schema["value"].dataType
    names = tuple(f"{n}_{s}" for s in scales for n in ("closed", "opened"))

    def both(images: np.ndarray) -> np.ndarray:
        return np.stack([sign * -_largest(-_largest(sign * images, s), s) for s in scales for sign in (1, -1)])

    each = by_arrays(image, height, None, both, names).select(*PLACE, F.inline(F.array(*[F.struct(F.lit(s).alias("size"), F.col(f"closed_{s}").cast(kind).alias("closed"), F.col(f"opened_{s}").cast(kind).alias("opened")) for s in scales])))
    return placed(each.select("image_id", "size", "row", "col", "closed", "opened"))


def fine_structures(image: DataFrame, height: int, scales: tuple[int, ...] = SCALES, mode: str = "both") -> DataFrame:
    """image_id, row, col, value: closings less the image (black) and the image less openings (top), or both, summed over footprints."""
    image = by_image(image)
    both = hats(image, height, scales)
    if mode == "both":
        return placed(both.groupBy(*PLACE).agg(F.sum(F.col("closed") - F.col("opened")).cast("int").alias("value")))
    side = both.groupBy(*PLACE).agg(F.sum("closed" if mode == "black" else "opened").alias("_sum")).join(image.select(*PLACE, "value"), PLACE)
    gap = F.col("_sum") - len(scales) * F.col("value")
    return placed(side.select(*PLACE, (gap if mode == "black" else -gap).cast("int").alias("value")))


# Local equalisation, unrolling, autocorrelation.


def local_equalised(image: DataFrame, height: int, width: int, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Contrast-limited local equalisation: a lookup table per tile, its histogram cut at clip times the mean count (1 at least) and the
    excess dealt evenly, what is left of it at equal steps; a pixel blends the tables of the four nearest tiles. Ties round to even.

    An image that tiles don't divide is mirrored below and to the right for its tables. Histograms are counts by image,
    tile and level; a task gathers the tables of an image (tiles * tiles * 256 numbers) into one array, which meets its pixels.
    """
    image = by_image(image)
    th, tw = -(-height // tiles), -(-width // tiles)
    n = th * tw
    most = max(1, int(clip * n / 256))

    def places(at: str, size: int, whole: int) -> Column:
        """A place, and those beyond the border that mirror it."""
        of = [[i for i in range(whole) if folded(i, size, "mirror") == k] for k in range(size)]
        return F.get(F.expr("array(" + ", ".join(f"array({', '.join(map(str, x))})" for x in of) + ")"), F.col(at))

    wide = image.select("image_id", F.explode(places("row", height, th * tiles)).alias("_r"), "col", "value").select("image_id", "_r", F.explode(places("col", width, tw * tiles)).alias("_c"), "value")
    tile = F.expr(f"_r div {th} * {tiles} + _c div {tw}").cast("int")
    counts = wide.groupBy("image_id", tile.alias("tile"), "value").agg(F.count(F.lit(1)).cast("int").alias("n"))
    excess = counts.groupBy("image_id", "tile").agg(F.sum(F.greatest(F.lit(0), F.col("n") - most)).cast("int").alias("_e"), F.map_from_entries(F.collect_list(F.struct(F.col("value").cast("int"), "n"))).alias("_n"))
    level = excess.select("image_id", "tile", "_e", "_n", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level"))
    step = "greatest(256 div greatest(_e % 256, 1), 1)"
    dealt = level.select("image_id", "tile", "level", F.expr(f"least(coalesce(try_element_at(_n, level), 0), {most}) + _e div 256 + if(level % {step} = 0 and level div {step} < _e % 256, 1, 0)").cast("int").alias("n"))
    lists = dealt.groupBy("image_id", "tile").agg(F.sort_array(F.collect_list(F.struct("level", "n"))).getField("n").alias("_n"))
    upto = F.expr(f"transform(slice(aggregate(_n, array(0), (a, x) -> array_append(a, element_at(a, -1) + x)), 2, 256), x -> rint(x * {255 / n!r}D))")
    tables = lists.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("tile", upto.alias("t")))).alias("_t")).select("image_id", F.flatten(F.col("_t").getField("t")).alias("_t"))

    def near(at: str, size: int) -> tuple[Column, Column, Column]:
        """First and second tile of a place along an axis, and the weight of the second."""
        x = F.col(at) / float(size) - 0.5
        return F.greatest(F.lit(0), F.floor(x)), F.least(F.lit(tiles - 1), F.floor(x) + 1), x - F.floor(x)

    (r1, r2, y), (c1, c2, x) = near("row", th), near("col", tw)
    look = lambda r, c: F.get("_t", ((r * tiles + c) * 256 + F.col("value")).cast("int"))
    mix = lambda r: look(r, c1) * (1 - x) + look(r, c2) * x
    out = image.join(tables, "image_id").withColumn("value", F.rint(F.round(mix(r1) * (1 - y) + mix(r2) * y, 9)).cast("int"))
    return placed(out.select(*image.columns))


def unrolled(image: DataFrame, circles: DataFrame, height: int, width: int, out_height: int = 201, out_width: int = 720, up: bool = False) -> DataFrame:
    """image_id, row, col, value of images by circles (image_id, inner_x, inner_y, inner_r, outer_x, outer_y, outer_r): the ring between two
    circles, which need not share a centre, as a strip.

    Row s lies s / (out_height - 1) of the way from the inner to the outer circle, column t at the angle
    2 pi t / out_width, rows of an image pointing down (with up, angles turn the other way). Values between pixels are
    interpolated from four, places beyond the border count as on it, values are truncated. Images without circles, and
    circles without an image, give no rows.
    """
    both = as_array(image).join(circles, "image_id")
    at = both.select("image_id", "pixels", "inner_x", "inner_y", "inner_r", "outer_x", "outer_y", "outer_r", F.explode(F.sequence(F.lit(0), F.lit(out_height * out_width - 1))).alias("_i"))
    at = at.withColumns({"row": F.expr(f"_i div {out_width}").cast("int"), "col": (F.col("_i") % out_width).cast("int")})
    part, turn = F.col("row") / float(max(out_height - 1, 1)), F.col("col") * (2 * math.pi / out_width)
    mixed = lambda axis, f: (1 - part) * (F.col(f"inner_{axis}") + F.col("inner_r") * f) + part * (F.col(f"outer_{axis}") + F.col("outer_r") * f)
    clamp = lambda v, size: F.least(F.greatest(F.round(v, 9), F.lit(0.0)), F.lit(float(size - 1)))
    at = at.select("image_id", "pixels", "row", "col", clamp(mixed("x", F.cos(turn)), width).alias("_x"), clamp(mixed("y", F.sin(turn) * (-1 if up else 1)), height).alias("_y"))
    at = at.withColumns({"_x0": F.floor("_x"), "_y0": F.floor("_y")})
    x1, y1 = F.least(F.col("_x0") + 1, F.lit(width - 1)), F.least(F.col("_y0") + 1, F.lit(height - 1))
    wx, wy = F.col("_x") - F.col("_x0"), F.col("_y") - F.col("_y0")
    look = lambda x, y: F.get("pixels", (y * width + x).cast("int"))
    line = lambda y: look(F.col("_x0"), y) * (1 - wx) + look(x1, y) * wx
    value = F.floor(F.round(line(F.col("_y0")) * (1 - wy) + line(y1) * wy, 9)).cast("int")
    return placed(at.select(*PLACE, value.alias("value")))


def lags(reach: int) -> list[tuple[int, int]]:
    """One of each pair of opposite steps, the null step first."""
    return [(d, k) for d in range(reach + 1) for k in range(-reach, reach + 1) if (d, k) >= (0, 0)]


def wave_kernels(frequencies: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5), orientations: int = 8, sigma: float = 1.0) -> list[dict[tuple[int, int], float]]:
    """{(row, column): weight} for every orientation and, within it, frequency: cosine waves under a round Gaussian, three deviations wide as the orientation sees them."""
    out = []
    for i in range(orientations):
        turn = i / orientations * math.pi
        cos, sin = math.cos(turn), math.sin(turn)
        m = math.ceil(max(abs(3 * sigma * cos), abs(3 * sigma * sin), 1))
        for f in frequencies:
            places = [(r, c, c * cos + r * sin, -c * sin + r * cos) for r in range(-m, m + 1) for c in range(-m, m + 1)]
            out.append({(r, c): math.exp(-0.5 * (x * x + y * y) / (sigma * sigma)) / (2 * math.pi * sigma * sigma) * math.cos(2 * math.pi * f * x) for r, c, x, y in places})
    return out


def wave_energies(image: DataFrame, height: int, width: int, frequencies: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5), orientations: int = 8, sigma: float = 1.0) -> DataFrame:
    """image_id, orientation, frequency, energy: the mean squared answer of each kernel on value / 255, borders wrapped.

    Energies need no filtered image: the sum of squared answers is the image's autocorrelation times the kernel's, so
    one pass over a few steps serves all kernels. An image whose values don't exceed 1 isn't divided.
    """
    kernels = wave_kernels(frequencies, orientations, sigma)
    reach = 2 * max(r for k in kernels for r, _ in k)
    steps = lags(reach)
    each = around(image, height, width, [(d, k) for d, k in steps], "wrap")
    sums = each.groupBy("image_id", "step").agg(F.sum(F.col("middle") * F.col("value")).alias("r"), F.max("middle").alias("top"))
    weights = []
    for n, kernel in enumerate(kernels):
        for s, (d, k) in enumerate(steps):
            w = sum(x * kernel.get((r + d, c + k), 0.0) for (r, c), x in kernel.items()) * (1 if s == 0 else 2)
            weights.append((s, n // len(frequencies), frequencies[n % len(frequencies)], w))
    table = image.sparkSession.createDataFrame(weights, "step int, orientation int, frequency double, w double")
    scale = F.when(F.max("top") > 1, 255.0 * 255.0).otherwise(1.0) * (height * width)
    out = sums.join(F.broadcast(table), "step").groupBy("image_id", "orientation", "frequency").agg((F.sum(F.col("r") * F.col("w")) / scale).alias("energy"))
    return placed(out)


def oriented_gradients(image: DataFrame, height: int, width: int, bins: int = 6, cell: int = 32) -> DataFrame:
    """image_id, cell_row, cell_col, bin, value: gradient sizes by direction (without sign, `bins` equal parts of half a turn) over square
    cells, each cell scaled to unit length, cut at 0.2 and scaled again. Gradients across the border are 0; cells that the image doesn't fill fall away."""
    each = around(image, height, width, [(0, 1, 1, 0), (0, -1, -1, 0), (1, 0, 0, 1), (-1, 0, 0, -1)], "mirror")
    g = each.groupBy(*PLACE).agg(F.sum(F.col("value") * F.col("w0")).alias("gc"), F.sum(F.col("value") * F.col("w1")).alias("gr"))
    size = F.hypot("gr", "gc")
    turn = F.pmod(F.degrees(F.atan2("gr", "gc")), F.lit(180.0))
    at = g.select("image_id", F.expr(f"row div {cell}").cast("int").alias("cell_row"), F.expr(f"col div {cell}").cast("int").alias("cell_col"), size.alias("size"), F.floor(F.round(turn, 9) / (180.0 / bins)).cast("int").alias("bin"))
    inside = at.filter((F.col("cell_row") < height // cell) & (F.col("cell_col") < width // cell))
    keys = ["image_id", "cell_row", "cell_col"]
    sums = inside.groupBy(*keys).agg(*[(F.sum(F.when(F.col("bin") == b, F.col("size")).otherwise(0.0)) / (cell * cell)).alias(f"_{b}") for b in range(bins)])
    norm = F.sqrt(sum((F.col(f"_{b}") * F.col(f"_{b}") for b in range(bins)), F.lit(1e-10)))
    cut = sums.select(*keys, *[F.least(F.lit(0.2), F.col(f"_{b}") / norm).alias(f"_{b}") for b in range(bins)])
    values = F.array(*[F.struct(F.lit(b).alias("bin"), (F.col(f"_{b}") / norm).alias("value")) for b in range(bins)])
    return placed(cut.select(*keys, F.inline(values)))
