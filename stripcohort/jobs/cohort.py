"""Queries on metrics, tables and the intake audit, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import audit, metrics
from stripcohort.sources import views
from stripcohort.sources.views import sql

QUERIES: dict = {}
SQL: dict = {}


def query(statement: str | None) -> object:
    def add(f: object) -> object:
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


CELLS = "cells as (select dataset, clf, {k} count_if(not y and not pred) as tn, count_if(not y and pred) as fp, count_if(y and not pred) as fn, count_if(y and pred) as tp from predictions group by all)"
FOLD = CELLS.format(k="fold, ").replace("cells as", "fcells as")
RATE = """folds as (select *, (tp + tn) / (tn + fp + fn + tp) as acc, tp / nullif(tp + fn, 0) as sens, tn / nullif(tn + fp, 0) as spec, tp / nullif(tp + fp, 0) as prec,
  tn / nullif(tn + fn, 0) as npv, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as bal_acc from fcells)"""
RS = "round(acc, 6) as acc, round(sens, 6) as sens, round(spec, 6) as spec, round(prec, 6) as prec, round(npv, 6) as npv, round(f1, 6) as f1, round(bal_acc, 6) as bal_acc"


@query(sql("predictions", more=CELLS.format(k=""), body="select dataset, clf, cast(tn as bigint) tn, cast(fp as bigint) fp, cast(fn as bigint) fn, cast(tp as bigint) tp from cells"))
def m1_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(views.predictions(spark, d), ["dataset", "clf"])


@query(sql("predictions", more=CELLS.format(k="").replace("cells as", "fcells as") + ",\n" + RATE, body="select dataset, clf, " + ", ".join(f"round(coalesce({m}, 0), 6) as {m}" for m in metrics.RATES[:-1]) + " from folds"))
def m2_report_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The simple report: a metric that is undefined is 0."""
    out = metrics.fold_metrics(views.predictions(spark, d), ["dataset", "clf"])
    return rounded(out.select("dataset", "clf", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics.RATES[:-1]]), *metrics.RATES[:-1])


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fold_metrics(views.predictions(spark, d), ["dataset", "clf", "fold"])


@query(sql("predictions", more=FOLD + ",\n" + RATE, body=f"select dataset, clf, fold, {RS} from folds"))
def m3_fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_folds(spark, d).select("dataset", "clf", "fold", *metrics.RATES), *metrics.RATES)


@query(sql("predictions", more="r as (select *, rank() over (partition by dataset, clf order by score) + (count(*) over (partition by dataset, clf, score) - 1) / 2 as rk from predictions)", body="select dataset, clf, round((sum(rk) filter (y) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(not y)), 6) as auc from r group by 1, 2"))
def m4_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(views.predictions(spark, d), ["dataset", "clf"]), "auc")


CURVE = """steps as (select config, score, count_if(y) as pos, count_if(not y) as neg from scored group by 1, 2),
curve as (select config, score, sum(neg) over w / sum(neg) over p as fpr, sum(pos) over w / sum(pos) over p as tpr, sum(pos) over w as tp, sum(neg) over w as fp, pos, sum(pos) over p as n_pos
  from steps window w as (partition by config order by score desc rows between unbounded preceding and current row), p as (partition by config))"""


@query(
    sql(
        "scored",
        more=CURVE + """,
best as (select config, fpr, max(tpr) as tpr from (select config, fpr, tpr from curve union all select distinct config, 0.0, 0.0 from scored) group by 1, 2),
grid as (select distinct config, unnest(range(0, 201)) as step from scored),
pts as (select g.config, g.step, (select max({'f': fpr, 't': tpr}) from best b where b.config = g.config and b.fpr <= g.step / 200 + 1e-12) as lo, (select min({'f': fpr, 't': tpr}) from best b where b.config = g.config and b.fpr > g.step / 200 + 1e-12) as hi from grid g)""",
        body="select config, cast(step as int) as step, round(case when hi is null then lo.t else lo.t + (step / 200 - lo.f) * (hi.t - lo.t) / (hi.f - lo.f) end, 6) as tpr from pts",
    )
)
def m5_roc_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_on_grid(views.scored(spark, d), ["config"]), "tpr")


@query(sql("scored", more=CURVE, body="select config, round(sum(pos / n_pos * tp / (tp + fp)), 6) as ap from curve group by 1"))
def m6_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(views.scored(spark, d), ["config"]), "ap")


@query(sql("predictions", more=FOLD + ",\n" + RATE, body="select dataset, clf, " + ", ".join(f"round(avg({m}), 6) as mean_{m}, round(stddev_pop({m}), 6) as sd_{m}" for m in metrics.RATES) + " from folds group by 1, 2"))
def m7_across_folds(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.across_folds(_folds(spark, d), ["dataset", "clf"], metrics.RATES)
    return rounded(out, *[c for c in out.columns if "_" in c])


MEAN = FOLD + ",\n" + RATE + ",\nmeans as (select dataset, clf, avg(acc) as acc from folds group by 1, 2)"


def _means(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d).groupBy("dataset", "clf").agg(F.avg("acc").alias("acc"))


@query(sql("predictions", more=MEAN, body="select dataset, clf, round(acc, 6) as acc from (select *, row_number() over (partition by dataset order by acc desc, clf) as r from means) where r = 1"))
def m9_best_classifier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.best_by(_means(spark, d), ["dataset"], "acc", "clf"), "acc")


@query(
    sql(
        "predictions",
        more=CELLS.format(k="")
        + """,
each as (select dataset, clf, '0' as class, coalesce(tn / nullif(tn + fn, 0), 0) as precision, coalesce(tn / nullif(tn + fp, 0), 0) as recall, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) as f1, tn + fp as support from cells
  union all select dataset, clf, '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn from cells),
every as (select * from each union all select dataset, clf, 'macro', avg(precision), avg(recall), avg(f1), sum(support) from each group by 1, 2
  union all select dataset, clf, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from each group by 1, 2)""",
        body="select dataset, clf, class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from every",
    )
)
def m10_class_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.class_report(views.predictions(spark, d), ["dataset", "clf"]), "precision", "recall", "f1")


@query(sql("predictions", more=MEAN, body="select dataset, round(max(acc) filter (clf = 'F'), 6) as acc_f, round(max(acc) filter (clf = 'O'), 6) as acc_o from means group by 1"))
def t1_accuracy_table(spark: SparkSession, d: str) -> DataFrame:
    """dataset by classifier; a combination that isn't there is null."""
    wide = _means(spark, d).groupBy("dataset").pivot("clf", ["F", "O"]).agg(F.round(F.first("acc"), 6))
    return wide.select("dataset", F.col("F").alias("acc_f"), F.col("O").alias("acc_o"))


@query(sql("predictions", more=MEAN, body="select dataset, clf, round(acc, 6) as acc, round(acc, 6) = max(round(acc, 6)) over (partition by dataset) as best from means"))
def t2_best_flag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_means(spark, d), "acc").withColumn("best", F.col("acc") == F.max("acc").over(W.partitionBy("dataset")))


@query(sql("predictions", more=MEAN, body="select dataset, clf, round(acc, 6) as acc from means order by acc desc, dataset, clf limit 5"))
def t3_top_combinations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_means(spark, d).orderBy(F.desc("acc"), "dataset", "clf").limit(5), "acc")


@query(sql("predictions", more=MEAN, body="select clf, dataset, round(acc, 6) as acc from (select *, row_number() over (partition by clf order by acc desc, dataset) as r from means) where r = 1"))
def t4_best_combination(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.best_by(_means(spark, d), ["clf"], "acc", "dataset"), "acc")


@query(sql("predictions", more=MEAN, body="select dataset, round(avg(acc), 6) as acc from means group by 1"))
def t5_mean_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_means(spark, d).groupBy("dataset").agg(F.avg("acc").alias("acc")), "acc")


@query(sql("predictions", more=FOLD + ",\n" + RATE, body="select dataset, clf, round(avg(acc), 6) as acc, round(avg(bal_acc), 6) as bal_acc from folds group by grouping sets ((dataset), (dataset, clf), ())"))
def t6_grand_means(spark: SparkSession, d: str) -> DataFrame:
    """Means per dataset, per dataset and classifier, and of all, from one pass."""
    out = _folds(spark, d).rollup("dataset", "clf").agg(F.avg("acc").alias("acc"), F.avg("bal_acc").alias("bal_acc"))
    return rounded(out, "acc", "bal_acc")


@query(sql("predictions", more=FOLD + ",\n" + RATE, body="select dataset, clf, array_to_string(list(round(acc, 6) order by fold), ',') as grid from (select dataset, clf, fold, cast(cast(round(acc * 10000) as bigint) as varchar) as a, round(acc * 10000) as acc from folds) group by 1, 2".replace("list(round(acc, 6) order by fold)", "list(a order by fold)")))
def t7_heatmap_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row of cells per combination, in the order of folds, in ten-thousandths."""
    cell = F.struct("fold", F.round(F.col("acc") * 10000).cast("long").cast("string").alias("a"))
    return _folds(spark, d).groupBy("dataset", "clf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["a"]), ",").alias("grid"))


@query(
    sql(
        "predictions",
        more=FOLD + ",\n" + RATE + """,
m as (select dataset, clf, avg(acc) as acc, avg(bal_acc) as bal, stddev_pop(acc) as sd, sum(tn + fp + fn + tp) as n from folds group by 1, 2),
l as (select dataset, clf, unnest(['acc', 'bal', 'sd', 'n']) as family, unnest([acc, bal, sd, n::double]) as v from m)""",
        body="select family || '_' || dataset || '_' || clf as key, round(v, 6) as value, case when family = 'n' then v::bigint::varchar else replace(format('{:.4f}', v), '.', ',') end as shown from l",
    )
)
def t8_number_table(spark: SparkSession, d: str) -> DataFrame:
    """One value per key over several families of numbers, and as each is printed: counts whole, the rest with a decimal comma."""
    folds = _folds(spark, d).withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    means = folds.groupBy("dataset", "clf").agg(F.avg("acc").alias("acc"), F.avg("bal_acc").alias("bal"), F.stddev_pop("acc").alias("sd"), F.sum("n").cast("double").alias("n"))
    return metrics.number_table(means, ["dataset", "clf"], ["acc", "bal", "sd"], ["n"])


@query("select doc_id as id, sha256(text) as sha from documents")
def a1_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))


@query(sql("subjects", body="select label, min(id) as id, sha from subjects group by label, sha"))
def a2_unique_in_class(spark: SparkSession, d: str) -> DataFrame:
    return audit.unique_within(views.subjects(spark, d), ["label"])


@query(sql("subjects", body="select sha, kept, id as removed from (select *, min(id) over (partition by sha) as kept from subjects) where id <> kept"))
def a3_copies(spark: SparkSession, d: str) -> DataFrame:
    """A row for each copy that goes, with the id that stays."""
    return audit.copies(views.subjects(spark, d), [])


@query(sql("subjects", body="select sha, min(label) as lo, max(label) as hi, arg_min(id, {'l': label, 'i': id}) as id_lo, arg_max(id, {'l': label, 'i': -id}) as id_hi from subjects group by sha having min(label) <> max(label)"))
def a4_label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return audit.label_conflicts(views.subjects(spark, d))


@query(sql("subjects", body="select cast(copies as bigint) as copies, cast(count(*) as bigint) as hashes from (select sha, count(*) as copies from subjects group by sha) group by copies"))
def a5_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return audit.multiplicity(views.subjects(spark, d), [])


@query(sql("subjects", more="per as (select layout, label, sha, count(*) as n from subjects group by all)", body="select layout, cast(coalesce(sum(n) filter (label = 0), 0) as bigint) as rows_0, cast(coalesce(sum(n) filter (label = 1), 0) as bigint) as rows_1, count_if(label = 0)::bigint as unique_0, count_if(label = 1)::bigint as unique_1, cast(sum(n) - count(*) as bigint) as removed, cast(max(n) as bigint) as most_copies from per group by layout"))
def a6_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(views.subjects(spark, d))


def _half(images: DataFrame, low: bool) -> DataFrame:
    """Low: src0 to src9; high: every other layout, as in the SQL."""
    in_low = F.col("layout").isin([f"src{i}" for i in range(10)])
    return images.filter(in_low if low else ~in_low)


LOW = "layout in (" + ", ".join(f"'src{i}'" for i in range(10)) + ")"


@query(sql("subjects", body=f"select count(*)::bigint as shared from (select sha from subjects where {LOW} intersect select sha from subjects where not {LOW})"))
def a7_shared_images(spark: SparkSession, d: str) -> DataFrame:
    s = views.subjects(spark, d)
    return audit.shared(_half(s, True), _half(s, False))


@query(sql("subjects", body=f"select layout, count(*)::bigint as n, round(avg((sha in (select sha from subjects where {LOW}))::int), 6) as in_low, round(avg((sha in (select sha from subjects where not {LOW}))::int), 6) as in_high from subjects group by layout"))
def a8_membership(spark: SparkSession, d: str) -> DataFrame:
    s = views.subjects(spark, d)
    return rounded(audit.membership(s, {"low": _half(s, True), "high": _half(s, False)}, ["layout"]), "in_low", "in_high")


@query(sql("seamed", body="select image_id, col from seamed group by 1, 2 having max(value) = 0"))
def a9_empty_columns(spark: SparkSession, d: str) -> DataFrame:
    return audit.empty_columns(views.seamed(spark, d))


@query(sql("seamed", more="e as (select image_id, col, max(value) = 0 as empty from seamed group by 1, 2)", body="select image_id, count_if(empty)::bigint as n_empty, count_if(empty) = 1 and coalesce(min(col) filter (empty) = 4, false) as mirrored from e group by 1"))
def a10_mirrored(spark: SparkSession, d: str) -> DataFrame:
    return audit.mirrored(views.seamed(spark, d), 8)


@query(
    sql(
        "seamed",
        more="""e as (select *, max(value) over (partition by image_id, col) = 0 as empty from seamed),
c as (select *, count_if(empty) over (partition by image_id, row) as n from e),
x as (select image_id, row, col + s * 8 as col, value from e, (values (-1), (0), (1)) t(s) where not empty)""",
        body="""select image_id, row, col, cast(case when empty and n < 4 then floor(((select arg_max(value, x.col) from x where x.image_id = c.image_id and x.row = c.row and x.col < c.col)
  + (select arg_min(value, x.col) from x where x.image_id = c.image_id and x.row = c.row and x.col > c.col)) / 2) else value end as int) as value from c""",
    )
)
def a11_repaired_seam(spark: SparkSession, d: str) -> DataFrame:
    return audit.repair_seam(views.seamed(spark, d), 8)


@query(sql("seamed", body="select image_id, row, cast(case when image_id % 2 = 0 then (11 - col) % 8 else col end as int) as col, value from seamed"))
def a12_unmirrored(spark: SparkSession, d: str) -> DataFrame:
    s = views.seamed(spark, d)
    return audit.unmirror(s, audit.mirrored(s, 8), 8)


@query(sql("pixels", body="select label, round(avg(b), 6) as b, round(avg(g), 6) as g, round(avg(r), 6) as r from pixels group by label"))
def a16_channel_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.pixels(spark, d).groupBy("label").agg(*[F.avg(c).alias(c) for c in "bgr"]), "b", "g", "r")


@query("select concat(case when quality = 0 then 'control' else 'positive' end, '-', lpad(cast(doc_id as varchar), cast(greatest(3, len(cast(doc_id as varchar))) as int), '0')) as sample_id, quality as label from labels")
def s3_tagged_classes(spark: SparkSession, d: str) -> DataFrame:
    """Two classes read apart, tagged, and put together."""
    rows = views.table(spark, d, "labels")
    side = lambda name, label: rows.filter(F.col("quality") == label).select(F.format_string(f"{name}-%03d", "doc_id").alias("sample_id"), F.lit(label).alias("label"))
    return side("control", 0).unionByName(side("positive", 1))


@query("select event_type as status, count(*)::bigint as n, count_if(value >= 0)::bigint as ok from events group by 1")
def s8_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 0).alias("ok"))
