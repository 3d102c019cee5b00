"""Queries that write files and read them back, and the audit of a whole cohort of images, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.jobs.imaging import rounded
from stripcohort.jobs.statistics import RULE
from stripcohort.operators import audit, features, metrics, rules
from stripcohort.sources import files, shared, store, views
from stripcohort.sources.views import sql

QUERIES: dict = {}
SQL: dict = {}


def query(statement: str) -> object:
    def add(f: object) -> object:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = statement
        return f

    return add


def _write_images(images: DataFrame, root: str) -> None:
    """Writes (name, content) as files under root, by the tasks that hold them."""
    uri = root if urlparse(root).scheme else f"file://{root}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                system.create_dir(f"{path}/{name.as_py().rsplit('/', 1)[0]}", recursive=True)
                with system.open_output_stream(f"{path}/{name.as_py()}") as f:
                    f.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    images.select("name", "content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


#: A bitmap's header: 8 x 8 pixels of 24 bits, 192 bytes of them, the first row at the top (its height is written as -8).
BITMAP = "424DF600000000000000360000002800000008000000F8FFFFFF0100180000000000C000000000000000000000000000000000000000"


@query(
    sql(
        "pixels",
        more="m as (select image_id, any_value(label) as label, count(*) as n, sum(b) as b, sum(g) as g, sum(r) as r from pixels group by 1)",
        body="select concat(image_id, '.BMP') as file, label, image_id % 10 <> 3 as readable, cast(case when image_id % 10 <> 3 then 8 end as int) as height, cast(case when image_id % 10 <> 3 then b + g + r end as bigint) as total from m",
    )
)
def s1_class_folders(spark: SparkSession, d: str) -> DataFrame:
    """Images written to class folders as bitmaps, every tenth one broken, read back and decoded; broken ones are counted, not fatal."""
    px = views.pixels(spark, d)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "b", "g", "r"))), lambda x: F.format_string("%02X%02X%02X", x["b"], x["g"], x["r"]))
    made = px.groupBy("image_id", "label").agg(F.array_join(rows, "").alias("hex"))
    content = F.unhex(F.when(F.col("image_id") % 10 == 3, F.lit("424D00")).otherwise(F.concat(F.lit(BITMAP), "hex")))
    folder = F.when(F.col("label") == 0, "control").otherwise("DM2")
    root = shared.fresh(spark)
    _write_images(made.select(F.concat_ws("/", folder, F.concat("image_id", F.lit(".BMP"))).alias("name"), content.alias("content")), root)
    read = files.decoded(spark, root)
    data = F.aggregate(F.sequence(F.lit(1), F.length("data")), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long"))
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "label", "readable", "height", F.when(F.col("readable"), data).alias("total"))


@query("select concat(d.doc_id, '.txt') as file, quality from documents d left join labels using (doc_id)")
def s2_mapped_labels(spark: SparkSession, d: str) -> DataFrame:
    """A mapping of file names to labels, written and read as JSON, joined to the files that it names."""
    path = shared.fresh(spark)
    views.table(spark, d, "labels").select(F.concat("doc_id", F.lit(".txt")).alias("file"), "quality").write.json(path)
    found = views.table(spark, d, "documents").select(F.concat_ws("/", F.lit("in"), "source", F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return files.with_mapping(found, files.mapping(spark, path, "file string, quality int")).select("file", "quality")


@query("select label, count(*)::bigint as n, count_if(embedding is null or len(embedding) <> 64 or len(list_filter(embedding, lambda x: x is null or x < -0.4 or x > 0.4)) > 0)::bigint as violating from embeddings group by 1")
def s3_shape_violations(spark: SparkSession, d: str) -> DataFrame:
    """Per class: rows, and those whose array is missing, of another length than 64, with gaps, or with a value outside -0.4 .. 0.4 (bytes would be 0 .. 255)."""
    rows = views.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return files.violations(rows, "label", "embedding", 64, -0.4, 0.4)


@query(
    sql(
        "pixels",
        more="m as (select image_id, avg(b) as mean, stddev_pop(b) as std from pixels group by 1)",
        body="select image_id, round(mean, 6) as mean, round(std, 6) as std, 1 as computed from m",
    )
)
def s4_reused_features(spark: SparkSession, d: str) -> DataFrame:
    """Features asked for twice under one content and one set of parameters: the second time they are read, not computed."""
    image = views.pixels(spark, d).select("image_id", "row", "col", F.col("b").alias("value"))
    root, times = shared.fresh(spark), []

    def compute() -> DataFrame:
        times.append(1)
        return features.intensity(image, ["image_id"]).select("image_id", "mean", "std")

    for _ in range(2):
        out = store.reused(root, image, {"features": "moments", "version": 1}, compute)
    return rounded(out, "mean", "std").withColumn("computed", F.lit(len(times)))


GEOMETRY = """geo as (select cohort as file, case when cohort = 'R' then '1' else '0' end as label, 2 * pupil_r as pupil_diameter, 2 * iris_r as iris_diameter, iris_r - pupil_r as iris_thickness,
  round(rho, 6) as pupil_iris_ratio, round(tau, 6) as thickness_ratio, round(eps, 6) as concentricity_offset, quality from rule)"""


@query(sql("radii", more=RULE + ", " + GEOMETRY, body="select *, count(*)::bigint as n from geo group by all"))
def s5_geometry_table(spark: SparkSession, d: str) -> DataFrame:
    """The geometry table with all of its columns, written as CSV and read back, its rows counted."""
    path = shared.fresh(spark)
    rated = rules.quality_label(rules.geometry(views.radii(spark, d)))
    made = {
        "file": F.col("cohort"), "label": F.when(F.col("cohort") == "R", "1").otherwise("0"),
        "pupil_diameter": 2 * F.col("pupil_r"), "iris_diameter": 2 * F.col("iris_r"), "iris_thickness": F.col("iris_r") - F.col("pupil_r"),
        "pupil_iris_ratio": F.round("rho", 6), "thickness_ratio": F.round("tau", 6), "concentricity_offset": F.round("eps", 6), "quality": F.col("quality"),
    }
    files.write_geometry(rated.select(*[c.alias(n) for n, c in made.items()]), path)
    back = spark.read.csv(path, header=True, schema=", ".join(f"{c} {'string' if c in ('file', 'label', 'quality') else 'double'}" for c in files.GEOMETRY))
    return back.groupBy(*files.GEOMETRY).agg(F.count(F.lit(1)).alias("n"))


@query(sql("predictions", more="f as (select dataset, clf, fold, avg((y = pred)::int) as acc from predictions group by 1, 2, 3)", body="select dataset, clf, fold, round(acc, 6) as acc, null::double as mean from f union all select dataset, null, null, null, round(avg(acc), 6) from f group by 1"))
def s6_result_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of other columns under the union of their keys, written as JSON and read back."""
    folds = metrics.fold_metrics(views.predictions(spark, d), ["dataset", "clf", "fold"]).select("dataset", "clf", "fold", "acc")
    path = shared.fresh(spark)
    files.united([rounded(folds, "acc"), folds.groupBy("dataset").agg(F.round(F.avg("acc"), 6).alias("mean"))]).write.json(path)
    return spark.read.json(path, schema="dataset string, clf string, fold int, acc double, mean double")


@query(sql("subjects", body="select id, layout, label, sha from subjects"))
def s7_split_strips(spark: SparkSession, d: str) -> DataFrame:
    """Rows written apart by layout and class, and read back with both from the folders' names."""
    path = shared.fresh(spark)
    files.write_split(views.subjects(spark, d), path)
    return spark.read.schema("id long, sha string, layout string, label int").parquet(path).select("id", "layout", "label", "sha")


#: Images of three layouts: every 15th a second time as it is, every tenth a second time with one level more at every seventh place.
STRIPS = """base as (select *, image_id % 3 as layout from (select image_id, label, row, col, b, case when image_id % 2 = 0 then 4 else 7 end as e from pixels)),
strips0 as (select layout, label, image_id as id, row, col, b, e from base union all select layout, label, image_id + 2000000, row, col, b, e from base where image_id % 15 = 0 union all select layout, label, image_id + 1000000, row, col, b + case when (row * 8 + col) % 7 = 0 then 1 else 0 end, e from base where image_id % 10 = 0),
strips as (select layout, label, id, row, col, case when col = e then 0 else b end as value, e from strips0)"""


def _strips(spark: SparkSession, d: str) -> DataFrame:
    px = views.pixels(spark, d)
    empty = F.when(F.col("image_id") % 2 == 0, 4).otherwise(7)
    base = px.select((F.col("image_id") % 3).alias("layout"), "label", F.col("image_id").alias("id"), "row", "col", F.col("b").alias("value"), empty.alias("e"))
    jitter = F.col("value") + ((F.col("row") * 8 + F.col("col")) % 7 == 0).cast("int")
    copies = base.filter("id % 15 = 0").withColumn("id", F.col("id") + 2_000_000)
    near = base.filter("id % 10 = 0").withColumns({"id": F.col("id") + 1_000_000, "value": jitter})
    whole = base.union(copies).union(near)
    return whole.select("layout", "label", F.col("id").alias("image_id"), "row", "col", F.when(F.col("col") == F.col("e"), 0).otherwise(F.col("value")).alias("value"))


@query(
    sql(
        "pixels",
        more=STRIPS
        + """,
hashes as (select layout, label, id, sha256(string_agg(value::varchar, ',' order by row, col)) as sha, min(e) = 4 as mirrored from strips group by 1, 2, 3),
firsts as (select layout, sha, min(id) as id, count(*) as n from hashes group by 1, 2),
uniq as (select h.* from hashes h join firsts f on f.id = h.id),
fixed as (select s.layout, s.id, s.row, s.col, case when s.col = s.e then floor(((select value from strips x where x.id = s.id and x.row = s.row and x.col = (s.e + 7) % 8) + (select value from strips x where x.id = s.id and x.row = s.row and x.col = (s.e + 1) % 8)) / 2) else value end as value from strips s join uniq using (id)),
unit as (select layout, id, row * 8 + col as i, (value - avg(value) over w) / sqrt(64 * var_pop(value) over w) as x from fixed window w as (partition by id)),
arr as (select layout, id, list(x order by i) as u from unit group by 1, 2),
pairs as (select p.layout, p.id as a, q.id as b from arr p join arr q on p.layout = q.layout and p.id < q.id where list_inner_product(p.u, q.u) >= 0.97),
joined_ as (select layout, count(distinct b) as fewer, count(*) as near_pairs from pairs group by 1)""",
        body="""select h.layout, count_if(label = 0)::bigint as rows_0, count_if(label = 1)::bigint as rows_1, u.u0 as unique_0, u.u1 as unique_1, (count(*) - u.u0 - u.u1)::bigint as removed, f.most as most_copies, u.m0 as mirrored_0, u.m1 as mirrored_1, (u.u0 + u.u1)::bigint as repaired, coalesce(j.near_pairs, 0)::bigint as near_pairs, (u.u0 + u.u1 - coalesce(j.fewer, 0))::bigint as groups
from hashes h join (select layout, count_if(label = 0)::bigint as u0, count_if(label = 1)::bigint as u1, count_if(label = 0 and mirrored)::bigint as m0, count_if(label = 1 and mirrored)::bigint as m1 from uniq group by 1) u using (layout)
join (select layout, max(n)::bigint as most from firsts group by 1) f using (layout) left join joined_ j using (layout) group by h.layout, u.u0, u.u1, u.m0, u.m1, f.most, j.near_pairs, j.fewer""",
    )
)
def a6_cohort_audit(spark: SparkSession, d: str) -> DataFrame:
    """The whole audit row of every layout: copies, mirrored strips, repaired seams, near pairs and the groups that folds keep whole."""
    return audit.cohort_audit(_strips(spark, d), 8)


@query(
    sql(
        "pixels",
        more=STRIPS
        + """,
turned as (select id, id % 3 as layout, row, case when e = 4 then (11 - col) % 8 else col end as col, value from strips),
hashes as (select layout, id, sha256(string_agg(value::varchar, ',' order by row, col)) as sha from turned group by 1, 2)""",
        body="select layout, count(*)::bigint as n, round(avg((sha in (select sha from hashes where layout = 0))::int), 6) as in_left, round(avg((sha in (select sha from hashes where layout = 1))::int), 6) as in_right from hashes group by 1",
    )
)
def a8_unmirrored_membership(spark: SparkSession, d: str) -> DataFrame:
    """A8 on images: the share of a layout's strips, turned back where they are mirrored, that stand in either side."""
    strips = _strips(spark, d).select("image_id", "row", "col", "value")
    turned = audit.unmirror(strips, audit.mirrored(strips, 8), 8)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda x: x["value"].cast("string")), ",")
    hashed = turned.groupBy("image_id").agg(F.sha2(whole, 256).alias("sha")).withColumn("layout", F.col("image_id") % 3)
    sides = {"left": hashed.filter("layout = 0"), "right": hashed.filter("layout = 1")}
    return rounded(audit.membership(hashed, sides, ["layout"]), "in_left", "in_right")
