"""Domain views over the given tables, once as DataFrames and once as SQL (``CTE``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, layout, sha: documents that are labelled, as images of a cohort."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("source").alias("layout"), "sha")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, clf, fold, y, pred, score: scored rows of cross-validation."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linestatus").alias("clf"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        (F.col("l_discount") > 0.05).alias("y"),
        (F.col("l_tax") > 0.04).alias("pred"),
        F.col("l_extendedprice").alias("score"),
        F.year("l_shipdate").alias("repeat"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, group_id, y, score, config: scored rows that belong to groups."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("y"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("config"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, row, col, b, g, r: an 8 x 8 image of the first 64 components of an embedding, channels as columns; null where it is shorter."""
    level = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.6) * 200))).cast("int"))
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") >= 5).cast("int").alias("label"), level.alias("v"))
    cells = base.select("image_id", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    at = lambda shift: F.try_element_at("v", ((F.col("pos") + shift) % 64 + 1).cast("int"))
    return cells.select("image_id", "label", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), at(0).alias("b"), at(21).alias("g"), at(42).alias("r"))


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, row, col, b, g, r: images of 64 x 64, each made of 64 of the small ones that follow each other; places of missing ones are 0.

    An image is gathered from whole vectors, so what is shuffled is a row per vector, and an image's pixels lie together.
    """
    level = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.6) * 200))).cast("int"))
    cells = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image_id"), F.struct((F.col("vec_id") % 64).cast("int").alias("at"), level.alias("v")).alias("cell"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # images are small for the work that they take
    whole = cells.repartition(parts, "image_id").groupBy("image_id").agg(F.map_from_entries(F.collect_list("cell")).alias("_m"))
    every = whole.select("image_id", F.flatten(F.expr("transform(sequence(0, 63), t -> if(map_contains_key(_m, t), _m[t], array_repeat(0, 64)))")).alias("_v"))
    at = every.select("image_id", "_v", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("_at"))
    row, col = F.floor(F.col("_at") / 64).cast("int"), (F.col("_at") % 64).cast("int")
    place = at.select("image_id", "_v", row.alias("row"), col.alias("col"))
    tile, pos = F.expr("row div 8 * 8 + col div 8"), F.expr("row % 8 * 8 + col % 8")
    look = lambda shift: F.get("_v", (tile * 64 + (pos + shift) % 64).cast("int"))
    return place.select("image_id", (F.col("image_id") % 2).cast("int").alias("label"), "row", "col", look(0).alias("b"), look(21).alias("g"), look(42).alias("r"))


def seamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, row, col, value: images with an empty column, 4 for even images (mirrored) and 7 for odd ones."""
    p = pixels(spark, sf_dir)
    empty = F.when(F.col("image_id") % 2 == 0, 4).otherwise(7)
    return p.select("image_id", "row", "col", F.when(F.col("col") == empty, 0).otherwise(F.col("b")).alias("value"))


def radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cohort, pupil_r, iris_r, dx: measured circles, dx between centres."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_returnflag").alias("cohort"), F.col("l_quantity").alias("pupil_r"), (45 + F.col("l_partkey") % 40).cast("double").alias("iris_r"), (F.col("l_suppkey") % 30).cast("double").alias("dx"))


CTE = {
    "subjects": "subjects as (select d.doc_id as id, l.quality as label, d.source as layout, sha256(d.text) as sha from documents d join labels l using (doc_id))",
    "predictions": "predictions as (select l_returnflag as dataset, l_linestatus as clf, cast(l_orderkey % 5 as int) as fold, l_discount > 0.05 as y, l_tax > 0.04 as pred, l_extendedprice as score, cast(year(l_shipdate) as int) as repeat from lineitem)",
    "scored": "scored as (select o_orderkey as id, o_custkey as group_id, o_orderpriority in ('1-URGENT', '2-HIGH') as y, o_totalprice as score, o_orderstatus as config from orders)",
    "pixels": """levels as (select vec_id as image_id, cast(label >= 5 as int) as label, list_transform(embedding, lambda v: cast(least(255, greatest(0, floor((cast(v as double) + 0.6) * 200))) as int)) as v from embeddings),
cells as (select *, unnest(range(0, 64)) as pos from levels),
pixels as (select image_id, label, cast(pos // 8 as int) as row, cast(pos % 8 as int) as col, v[pos + 1] as b, v[(pos + 21) % 64 + 1] as g, v[(pos + 42) % 64 + 1] as r from cells)""",
    "radii": "radii as (select l_returnflag as cohort, l_quantity as pupil_r, cast(45 + l_partkey % 40 as double) as iris_r, cast(l_suppkey % 30 as double) as dx from lineitem)",
}
CTE["mosaics"] = CTE["pixels"] + """,
mcells as (select image_id // 64 as image_id, cast((image_id % 64) // 8 * 8 + row as int) as row, cast((image_id % 64) % 8 * 8 + col as int) as col, b, g, r from pixels),
mgrid as (select image_id, cast(pos // 64 as int) as row, cast(pos % 64 as int) as col from (select distinct vec_id // 64 as image_id, unnest(range(0, 4096)) as pos from embeddings)),
mosaics as (select image_id, cast(image_id % 2 as int) as label, row, col, coalesce(b, 0) as b, coalesce(g, 0) as g, coalesce(r, 0) as r from mgrid left join mcells using (image_id, row, col))"""
CTE["seamed"] = CTE["pixels"] + ",\nseamed as (select image_id, row, col, case when col = case when image_id % 2 = 0 then 4 else 7 end then 0 else b end as value from pixels)"


def sql(*views: str, body: str, more: str = "") -> str:
    """A statement with these views before it."""
    return "with " + ",\n".join([CTE[v] for v in views] + ([more] if more else [])) + "\n" + body
