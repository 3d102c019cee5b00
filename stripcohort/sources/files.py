"""Reading image folders and writing results: class folders, label maps, CSV, series, split strips."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder names of the two classes, and endings of image files.
NEGATIVE, POSITIVE = ("control", "Control", "healthy"), ("diabetic", "Diabetic", "DM2")
ENDINGS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")

#: The columns of the geometry table.
GEOMETRY = ["file", "label", "pupil_diameter", "iris_diameter", "iris_thickness", "pupil_iris_ratio", "thickness_ratio", "concentricity_offset", "quality"]


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, label, content: every image file under a class folder once; other folders and endings are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = F.element_at(F.split("path", "/"), -2)
    label = F.when(folder.isin(*NEGATIVE), 0).when(folder.isin(*POSITIVE), 1)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.filter(ending.isin(*ENDINGS)).select("path", label.alias("label"), "content").filter("label is not null").dropDuplicates(["path"])


def with_status(files: DataFrame) -> DataFrame:
    """Adds readable: the content starts as one of the image formats does; others are counted, not fatal."""
    head = F.hex(F.substring("content", 1, 4))
    known = reduce(Column.__or__, [head.startswith(x) for x in ("FFD8FF", "89504E47", "424D", "49492A00", "4D4D002A")])
    return files.withColumn("readable", F.coalesce(known, F.lit(False)))


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """path, label, readable, height, width, n_channels, data (blue, green, red by rows): every image file under a class folder, decoded.

    A file that can't be decoded comes back as not readable, so that a caller counts it; it stops nothing.
    """
    every = image_files(spark, root).select("path", "label")
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root).select("image.*")
    name = lambda c: F.regexp_replace(c, "^file:/*", "file:/")
    known = found.select(name(F.col("origin")).alias("_of"), "height", "width", F.col("nChannels").alias("n_channels"), "data")
    out = every.join(known, name(F.col("path")) == F.col("_of"), "left").withColumn("readable", F.col("_of").isNotNull())
    return out.select("path", "label", "readable", "height", "width", "n_channels", "data")


def violations(rows: DataFrame, label: str, values: str, length: int, low: float = 0, high: float = 255) -> DataFrame:
    """label, n, violating: rows per class whose array is missing, has another length, holds a gap, or a value outside low .. high."""
    fine = F.forall(values, lambda x: F.coalesce((x >= low) & (x <= high), F.lit(False)))
    whole = F.col(values).isNotNull() & (F.size(values) == length) & fine
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("violating"))


def mapping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A mapping of file names, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def with_mapping(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds the columns of a mapping (file, ...) by file name; files without one stay, with nulls. A name that the mapping repeats gives one row per entry."""
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(mapping, "file", "left")


def write_geometry(rings: DataFrame, path: str) -> None:
    """The geometry table as CSV with a header; columns that are missing are written empty."""
    rings.select(*[F.col(c) if c in rings.columns else F.lit(None).cast("string").alias(c) for c in GEOMETRY]).write.csv(path, header=True)


def united(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of all columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_series(df: DataFrame, x: str, ys: list[str], path: str) -> None:
    """x and ys separated by blanks, sorted by x, for plotting tools."""
    df.select(x, *ys).orderBy(x).write.csv(path, sep=" ", header=True)


def write_split(strips: DataFrame, path: str) -> None:
    """Processed strips by layout and class."""
    strips.repartition("layout", "label", F.pmod(F.xxhash64("id"), F.lit(32))).write.partitionBy("layout", "label").parquet(path)
