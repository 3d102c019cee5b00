"""Queries on corrected p-values, folds and ring geometry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.operators import rules
from stripcohort.sources import views
from stripcohort.sources.views import sql

PVALUES = "tests as (select event_type as family, event_id as id, least(1.0, abs(value) / 500) as p from events where value is not null)"
RULE = """g as (select *, pupil_r / iris_r as rho, (iris_r - pupil_r) / iris_r as tau, abs(dx) / iris_r as eps from radii),
s as (select *, case when pupil_r <= 0 or iris_r <= pupil_r then 0.0 else greatest(0.0, round(1 - (case when rho < 0.15 or rho > 0.80 then 0.6 when rho < 0.20 or rho > 0.70 then 0.25 else 0.0 end + case when tau < 0.25 then 0.3 else 0.0 end + case when eps > 0.30 then 0.3 else 0.0 end), 6)) end as score from g),
rule as (select *, case when pupil_r <= 0 or iris_r <= pupil_r or rho < 0.15 or rho > 0.80 or score < 0.5 then 'invalid' when score < 1 then 'borderline' else 'valid' end as quality from s)"""


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").filter("value is not null").select(F.col("event_type").alias("family"), F.col("event_id").alias("id"), F.least(F.lit(1.0), F.abs("value") / 500).alias("p"))


def h1_holm(spark: SparkSession, d: str) -> DataFrame:
    return rules.holm(_tests(spark, d), "family").select("family", "id", F.round("p_holm", 6).alias("p_holm"))


def h2_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    return rules.benjamini_hochberg(_tests(spark, d), "family").select("family", "id", F.round("q", 6).alias("q"))


def c1_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return rules.stratified_folds(views.subjects(spark, d), "label").select("id", "label", "fold")


def g3_quality_counts(spark: SparkSession, d: str) -> DataFrame:
    """G1 and G2 on every measured pair of circles, counted per cohort."""
    rated = rules.quality_label(rules.geometry(views.radii(spark, d)))
    return rated.groupBy("cohort", "quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("rho"), 6).alias("rho"))


def g2_quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How often every label comes with which reasons, per cohort."""
    rated = rules.quality_label(rules.geometry(views.radii(spark, d)))
    return rated.groupBy("cohort", "quality", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (h1_holm, h2_benjamini_hochberg, c1_stratified_folds, g2_quality_reasons, g3_quality_counts)}
SQL = {
    "h1_holm": f"with {PVALUES}, s as (select *, (count(*) over (partition by family) - row_number() over w + 1) * p as st from tests window w as (partition by family order by p, id)) select family, id, round(least(1.0, max(st) over (partition by family order by p, id rows between unbounded preceding and current row)), 6) as p_holm from s",
    "h2_benjamini_hochberg": f"with {PVALUES}, s as (select *, p * count(*) over (partition by family) / row_number() over w as st from tests window w as (partition by family order by p, id)) select family, id, round(least(1.0, min(st) over (partition by family order by p, id rows between current row and unbounded following)), 6) as q from s",
    "c1_stratified_folds": sql("subjects", body="select id, label, cast((row_number() over (partition by label order by md5(concat('42|', id)), id) - 1) % 5 as int) as fold from subjects"),
    "g2_quality_reasons": sql(
        "radii",
        more=RULE,
        body="""select cohort, quality, concat_ws(',', case when pupil_r <= 0 or iris_r <= pupil_r then 'radii' end, case when iris_r > pupil_r and (rho < 0.15 or rho > 0.80) then 'ratio_hard' end,
  case when iris_r > pupil_r and (rho < 0.20 or rho > 0.70) and not (rho < 0.15 or rho > 0.80) then 'ratio_soft' end, case when iris_r > pupil_r and tau < 0.25 then 'thickness' end, case when iris_r > pupil_r and eps > 0.30 then 'offset' end) as reasons, count(*)::bigint as n from rule group by 1, 2, 3""",
    ),
    "g3_quality_counts": sql("radii", more=RULE, body="select cohort, quality, count(*)::bigint as n, round(avg(score), 6)::double as score, round(avg(rho), 6) as rho from rule group by 1, 2"),
}
