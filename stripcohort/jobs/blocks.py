"""Queries on feature blocks, similar strips and effects over fold tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.jobs.imaging import OTSU, PX, rounded
from stripcohort.operators import blocks, comparison, metrics, rules, similar
from stripcohort.sources import views
from stripcohort.sources.views import sql

QUERIES: dict = {}
SQL: dict = {}
REGIONS = [(0, 0, 4), (1, 2, 6), (2, 4, 8)]
REGION_SQL = "regions(region, lo, hi) as (values (0, 0, 4), (1, 2, 6), (2, 4, 8)), rb as (select image_id, region, avg(value) as mean, stddev_pop(value) as std from px join regions on col >= lo and col < hi group by 1, 2)"
VECTORS = "vectors as (select vec_id as id, embedding::double[] as v from embeddings union all select vec_id + 1000000, list_transform(range(1, 65), lambda i: embedding[i]::double + 0.001e0 * ((i - 1) % 3 - 1)) from embeddings where vec_id % 10 = 0), flat as (select id, unnest(v) as x, unnest(range(0, 64)) as i from vectors), unit as (select id, i, (x - avg(x) over w) / sqrt(64 * var_pop(x) over w) as x from flat window w as (partition by id)), arr as (select id, list(x order by i) as u from unit group by 1), pairs as (select p.id as a, q.id as b, list_inner_product(p.u, q.u) as r from arr p join arr q on p.id < q.id where list_inner_product(p.u, q.u) >= 0.97)"


def query(*views_: str, **more: str) -> object:
    def add(f: object) -> object:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(*views_, **more)
        return f

    return add


def _image(spark: SparkSession, d: str, channel: str = "b") -> DataFrame:
    return views.pixels(spark, d).select("image_id", "label", "row", "col", F.col(channel).alias("value"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return blocks.region_block(_image(spark, d), spark.createDataFrame(REGIONS, "region int, lo int, hi int"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and jittered copies of every tenth."""
    base = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    copies = base.filter("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.transform("v", lambda x, i: x + 0.001 * (i % 3 - 1)).alias("v"))
    return similar.near_pairs(base.union(copies))


@query("pixels", more=PX + ", " + REGION_SQL, body="select image_id, region, round(mean, 6) as mean, round(std, 6) as std from rb")
def f8_region_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of named, overlapping column ranges."""
    return rounded(_regions(spark, d).drop("n"), "mean", "std")


@query("pixels", more=PX + ", " + REGION_SQL + ", w as (select image_id, avg(value) as mean, stddev_pop(value) as std from px group by 1)", body="select image_id, pos::int as pos, round(case pos when 6 then w.mean when 7 then w.std else f[pos + 1] end, 6) as value from (select image_id, flatten(list([mean, std] order by region)) as f, unnest(range(0, 8)) as pos from rb group by 1) join w using (image_id)")
def f7_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the regions and of the whole image in one vector."""
    regions = blocks.joined(_regions(spark, d), ["image_id"], "region", ["mean", "std"])
    whole = _image(spark, d).groupBy("image_id").agg(F.array(F.avg("value"), F.stddev_pop("value")).alias("features"))
    return rounded(blocks.fused(regions, whole, "image_id").select("image_id", F.posexplode("features").alias("pos", "value")), "value")


@query("pixels", more=PX, body="select kind, max(dims)::int as dims from (select 'regions' as kind, image_id, 2 * count(distinct case when col < 4 then 0 when col < 6 then 1 else 2 end) as dims from px group by 2 union all select 'rows', image_id, count(distinct row) from px group by 2) group by 1")
def f9_dimensions(spark: SparkSession, d: str) -> DataFrame:
    regions = blocks.joined(_regions(spark, d), ["image_id"], "region", ["mean", "std"]).withColumn("kind", F.lit("regions"))
    rows = blocks.joined(_image(spark, d).groupBy("image_id", "row").agg(F.avg("value").alias("mean")), ["image_id"], "row", ["mean"]).withColumn("kind", F.lit("rows"))
    return blocks.dimensions(regions.unionByName(rows), "kind")


@query("pixels", more="px as (select image_id, row, col, b as value from pixels where row between 2 and 5), " + OTSU, body="select image_id, max(threshold) as threshold, round((avg(value) filter (value > threshold) - avg(value) filter (value <= threshold)) / (stddev_pop(value) filter (value <= threshold) + 1e-6), 6) as cnr from px left join otsu using (image_id) group by 1")
def f12_masked_otsu(spark: SparkSession, d: str) -> DataFrame:
    """Threshold and contrast within the middle rows alone."""
    return rounded(blocks.masked_otsu(_image(spark, d).drop("label"), F.col("row").between(2, 5)), "cnr")


@query("pixels", body="select p.image_id as a, q.image_id as b, round(covar_pop(p.b, q.b) / nullif(stddev_pop(p.b) * stddev_pop(q.b), 0), 6) as r from pixels p join pixels q on q.image_id = p.image_id + 1 and p.row = q.row and p.col = q.col group by 1, 2")
def g11_strip_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every strip against the next one."""
    pairs = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return rounded(blocks.similarity(pairs, _image(spark, d)), "r")


@query("pixels", more="f as (select image_id, (row_number() over (partition by label order by md5(concat('42|', image_id::varchar)), image_id) - 1) % 5 as fold from (select distinct image_id, label from pixels)), v as (select image_id, row as dim, avg(b) as x from pixels group by 1, 2), vf as (select * from v join f using (image_id)), s as (select t.dim, k.fold, avg(t.x) as m, stddev_pop(t.x) as sd from vf t join (select distinct fold from f) k on t.fold <> k.fold group by 1, 2)", body="select image_id, vf.dim::int as dim, vf.fold::int as fold, round(case when sd > 1e-6 then (x - m) / sd else 0 end, 6) as z from vf join s on s.dim = vf.dim and s.fold = vf.fold")
def c4_standardised(spark: SparkSession, d: str) -> DataFrame:
    """Row means of an image by the training part of its fold."""
    labels = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") >= 5).cast("int").alias("label"))
    folds = rules.stratified_folds(labels, "label", key="image_id").select("image_id", "fold")
    dims = _image(spark, d).groupBy("image_id", F.col("row").alias("dim")).agg(F.avg("value").alias("x")).join(folds, "image_id")
    return rounded(blocks.standardised(dims, "fold", "dim", "x").select("image_id", "dim", "fold", "z"), "z")


@query("subjects", more="a as (select id, row_number() over (order by md5(concat('2026|', id::varchar)), id) as n from subjects), b as (select label, row_number() over (order by md5(concat('2027|', id::varchar)), id) as n from subjects)", body="select id, label from a join b using (n)")
def c16_permuted_labels(spark: SparkSession, d: str) -> DataFrame:
    return blocks.permuted_labels(views.subjects(spark, d), "label", 2026)


@query(more=VECTORS, body="select a, b, round(r, 6) as r from pairs")
def a13_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_near(spark, d), "r")


@query(more="e as (select a, b from pairs union select b, a from pairs), reach as (select a as id, a as g from e union select e.a, r.g from reach r join e on e.b = r.id), m as (select id, min(g) as group_id from reach group by 1)", body="select id, group_id, count(*) over (partition by group_id) as size from m")
def a14_near_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar.groups(_near(spark, d))


SQL["a14_near_groups"] = "with recursive " + VECTORS + ", " + SQL["a14_near_groups"].removeprefix("with ").lstrip()


@query("predictions", more="r as (select dataset, clf, repeat, y, rank() over (partition by dataset, clf, repeat order by score) + (count(*) over (partition by dataset, clf, repeat, score) - 1) / 2e0 as rk from predictions), a as (select dataset, clf, repeat, (sum(rk) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2e0) / (count(*) filter (y) * count(*) filter (not y)) as auc from r group by 1, 2, 3)", body="select dataset, clf, round(avg(auc), 6) as mean, round(stddev_samp(auc), 6) as sd, count(auc) as n from a group by 1, 2")
def m12_auc_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    """AUC of scores against a truth for every seed (here: year), its mean and sample deviation."""
    each = metrics.auc(views.predictions(spark, d), ["dataset", "clf", "repeat"])
    return rounded(each.groupBy("dataset", "clf").agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"), F.count("auc").alias("n")), "mean", "sd")


H6 = "f as (select dataset, clf, fold, avg((y = pred)::int) as acc from predictions group by 1, 2, 3), e as (select dataset, fold, avg(acc) as acc from f group by 1, 2), d as (select e.dataset, e.acc - b.acc as d from e join e b on b.fold = e.fold and b.dataset = 'A' where e.dataset <> 'A')"


#: Two tests: Student's p with 4 degrees of freedom in closed form, then Holm.
H6_P = """, t as (select dataset, avg(d) as diff, count(*) as k, sqrt(var_samp(d) * (1e0 / count(*) + 0.25e0)) as se from d group by 1),
p as (select *, diff / se as t, 1 - 2 * (0.375 * abs(diff / se) / sqrt(1 + pow(diff / se, 2) / 4) * (1 - pow(diff / se, 2) / (12 * (1 + pow(diff / se, 2) / 4)))) as p from t),
h as (select *, row_number() over (order by p) as pos, count(*) over () as m from p)"""


@query("predictions", more=H6 + H6_P, body="select dataset, round(diff, 6) as diff, k, round(t, 6) as t, round(p, 6) as p, round(least(1, max((m - pos + 1) * p) over (order by pos)), 6) as p_holm from h")
def h6_effect(spark: SparkSession, d: str) -> DataFrame:
    """Classifiers averaged per fold, then every dataset against the baseline, corrected over the datasets."""
    folds = views.predictions(spark, d).groupBy("dataset", "clf", "fold").agg(F.avg((F.col("y") == F.col("pred")).cast("int")).alias("acc"))
    return rounded(comparison.effect(folds, "dataset", "A", "fold", "acc", 0.25).select("dataset", "diff", "k", "t", "p", "p_holm"), "diff", "t", "p", "p_holm")
