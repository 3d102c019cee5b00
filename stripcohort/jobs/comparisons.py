"""Queries on fold tables, votes and fitted geometry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.operators import blocks, comparison, dist, metrics, rules
from stripcohort.sources import shared, views
from stripcohort.sources.views import sql

QUERIES: dict = {}
SQL: dict = {}

#: Accuracy per dataset, clf, repeat and fold; and per fold alone.
FOLDS = """long_ as (select dataset, clf, repeat, fold, round(avg((y = pred)::int), 9) as acc from predictions group by all),
folds as (select dataset, clf, fold, round(avg((y = pred)::int), 9) as acc from predictions group by all)"""
T4 = "2.7764451051977987"  # Student's 0.975 quantile, 4 degrees of freedom
PAIRED = """d as (select a.dataset, a.clf, a.fold, a.acc - b.acc as d from folds a join folds b on b.dataset = 'A' and a.dataset <> 'A' and a.clf = b.clf and a.fold = b.fold),
t as (select dataset, clf, avg(d) as diff, count(*) as k, avg(d) / sqrt(var_samp(d) * (1e0 / count(*) + 0.25)) as t, sqrt(var_samp(d) * (1e0 / count(*) + 0.25)) as se from d group by 1, 2),
p as (select *, 1 - 2 * (0.375 * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))) as p from t)"""
RANKS = """r as (select *, rank() over (partition by clf, repeat, fold order by acc desc) + (count(*) over (partition by clf, repeat, fold, acc) - 1) / 2e0 as r from long_),
ranks as (select dataset, avg(r) as rank, count(*) as n from r group by 1)"""


def query(*of: str, **more: str) -> object:
    def add(f: object) -> object:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(*of, **more)
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _acc(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    rows = views.predictions(spark, d)
    return metrics.fold_metrics(rows, list(keys)).select(*keys, F.round("acc", 9).alias("acc"))


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return _acc(spark, d, "dataset", "clf", "fold")


def _long(spark: SparkSession, d: str) -> DataFrame:
    return _acc(spark, d, "dataset", "clf", "repeat", "fold")


@query("predictions", more=FOLDS, body=f"select dataset, clf, round(avg(acc), 6) as mean, round(stddev_samp(acc), 6) as sd, count(*)::bigint as k, round(greatest(0, avg(acc) - {T4} * stddev_samp(acc) / sqrt(5)), 6) as lo, round(least(1, avg(acc) + {T4} * stddev_samp(acc) / sqrt(5)), 6) as hi from folds group by 1, 2")
def m8_interval(spark: SparkSession, d: str) -> DataFrame:
    """Student's interval across folds, within 0 and 1."""
    out = comparison.interval(_folds(spark, d), ["dataset", "clf"], "acc")
    out = out.withColumns({"lo": F.greatest(F.lit(0.0), "lo"), "hi": F.least(F.lit(1.0), "hi")})
    return rounded(out, "mean", "sd", "lo", "hi")


@query("predictions", more=FOLDS, body=f"select dataset, clf, round(avg(acc), 6) as mean, round(stddev_samp(acc), 6) as sd, count(*)::bigint as k, round(avg(acc) - {T4} * stddev_samp(acc) * sqrt(1e0 / 5 + 0.25), 6) as lo, round(avg(acc) + {T4} * stddev_samp(acc) * sqrt(1e0 / 5 + 0.25), 6) as hi from folds group by 1, 2")
def h3_corrected_interval(spark: SparkSession, d: str) -> DataFrame:
    """The interval whose variance allows for shared training rows."""
    return rounded(comparison.interval(_folds(spark, d), ["dataset", "clf"], "acc", test_share=0.25), "mean", "sd", "lo", "hi")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return comparison.paired(_folds(spark, d), "dataset", "A", ["clf"], ["fold"], "acc", 0.25)


@query("predictions", more=FOLDS + ", " + PAIRED, body=f"select dataset, clf, round(diff, 6) as diff, k::bigint as k, round(t, 6) as t, round(p, 6) as p, round(diff - {T4} * se, 6) as lo, round(diff + {T4} * se, 6) as hi from p")
def h4_paired_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_paired(spark, d), "diff", "t", "p", "lo", "hi")


@query(
    "predictions",
    more=FOLDS
    + ", "
    + PAIRED
    + """, o as (select *, round(p, 9) as r, row_number() over (order by round(p, 9), concat(dataset, clf)) as pos from p),
h as (select *, (count(*) over () - pos + 1) * r as s from o)""",
    body="select dataset, clf, round(diff, 6) as diff, round(p, 6) as p, round(least(1, max(s) over (order by pos)), 6) as p_holm from h",
)
def h5_against_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Every dataset against the baseline per classifier, corrected over all tests of the metric."""
    tests = _paired(spark, d).withColumns({"p": F.round("p", 9), "metric": F.lit("acc")})
    return rounded(rules.holm(tests, "metric").select("dataset", "clf", "diff", "p", "p_holm"), "diff", "p", "p_holm")


@query("predictions", more=FOLDS + ", " + RANKS, body="select dataset, round(rank, 6) as rank, n::bigint as n from ranks")
def h7_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(comparison.average_ranks(_long(spark, d), "dataset", ["clf", "repeat", "fold"], "acc"), "rank")


@query(
    "predictions",
    more=FOLDS + ", " + RANKS + ", s as (select count(*) as k, max(n) as n, sum(rank * rank) as q from ranks), c as (select *, 12e0 * n / (k * (k + 1)) * (q - k * (k + 1) * (k + 1) / 4e0) as chi2 from s)",
    body="""select k::bigint as k, n::bigint as n, round(chi2, 6) as chi2, round(exp(-chi2 / 2), 6) as p, round(f, 6) as f, round(pow(1 + 2 * f / (2e0 * (n - 1)), -(n - 1)), 6) as p_f,
  round(2.343 * sqrt(k * (k + 1) / (6e0 * n)), 6) as cd from (select *, (n - 1) * chi2 / (n * (k - 1) - chi2) as f from c)""",
)
def h8_friedman(spark: SparkSession, d: str) -> DataFrame:
    ranks = comparison.average_ranks(_long(spark, d), "dataset", ["clf", "repeat", "fold"], "acc")
    return rounded(comparison.friedman(ranks), "chi2", "p", "f", "p_f", "cd")


SIX = """six as (select dataset || clf as config, repeat, fold, acc from long_), b6 as (select repeat, fold from six group by 1, 2 having count(*) = (select count(distinct config) from six)),
r6 as (select config, rank() over (partition by repeat, fold order by acc desc) + (count(*) over (partition by repeat, fold, acc) - 1) / 2e0 as r from six join b6 using (repeat, fold)),
k6 as (select config, avg(r) as rank, count(*) as n from r6 group by 1), o6 as (select *, row_number() over (order by rank, config) as pos, count(*) over () as k from k6),
q6(k, q) as (values (2, 1.960), (3, 2.343), (4, 2.569), (5, 2.728), (6, 2.850))"""


@query(
    "predictions",
    more=FOLDS + ", " + SIX + """, e6 as (select a.config as first, a.pos as a, max(b.pos) as z from o6 a join q6 on q6.k = a.k join o6 b on b.pos >= a.pos and b.rank - a.rank < q6.q * sqrt(a.k * (a.k + 1) / (6e0 * a.n)) group by 1, 2)""",
    body="""select e.first, o.config as last, (e.z - e.a + 1)::bigint as members from e6 e join o6 o on o.pos = e.z
where e.z > e.a and not exists (select 1 from e6 f where f.a < e.a and f.z >= e.z)""",
)
def h9_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of dataset and classifier that ranks over repeats and folds don't part, on the blocks that have them all."""
    long = _long(spark, d).select(F.concat("dataset", "clf").alias("config"), "repeat", "fold", "acc")
    whole = long.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("_n")).join(long.agg(F.count_distinct("config").alias("_n")), "_n").drop("_n")
    ranks = comparison.average_ranks(long.join(whole, ["repeat", "fold"]), "config", ["repeat", "fold"], "acc")
    found = comparison.friedman(ranks).first()  # one row, none without a block
    return comparison.cliques(ranks, "config", found["cd"] if found and found["k"] > 1 else 1.0)


NULLS = """o as (select o_orderkey as id, o_orderstatus as config, (o_orderpriority in ('1-URGENT', '2-HIGH'))::int as y, (o_totalprice > 150000)::int as pred from orders),
s as (select *, unnest(range(0, 20)) as seed from o),
a as (select seed, config, pred, row_number() over (partition by seed, config order by md5(concat(seed, '|', id)), id) as n from s),
b as (select seed, config, y, row_number() over (partition by seed, config order by md5(concat(seed + 1000, '|', id)), id) as n from s),
nulls as (select config, seed, round(avg((y = pred)::int), 9) as v from a join b using (seed, config, n) group by 1, 2),
obs as (select config, round(avg((y = pred)::int), 9) as o from o group by 1)"""


@query(more=NULLS, body="select config, round((1 + count_if(v >= o)) / (1e0 + count(*)), 6) as p, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, round(quantile_cont(v, 0.95), 6) as p95 from nulls join obs using (config) group by 1")
def h10_permutation_p(spark: SparkSession, d: str) -> DataFrame:
    """The accuracy of a rule against its accuracies under 20 permutations of the labels, per configuration."""
    orders = views.table(spark, d, "orders")
    y, pred = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_totalprice") > 150000
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("config"), y.alias("y"), pred.alias("pred"))
    hit = F.round(F.avg((F.col("y") == F.col("pred")).cast("int")), 9)
    null = blocks.permuted_hits(rows, "config", range(20)).select("config", "seed", F.round(F.try_divide("hits", "n"), 9).alias("null_value"))
    return rounded(comparison.permutation_p(null, rows.groupBy("config").agg(hit.alias("observed")), ["config"]), "p", "mean", "sd", "p95")


@query(
    "predictions",
    more=FOLDS + ", j as (select clf, a.acc as a, b.acc as b from long_ a join long_ b using (clf, repeat, fold) where a.dataset = 'A' and b.dataset = 'N'), r as (select clf, rank() over (partition by clf order by a) + (count(*) over (partition by clf, a) - 1) / 2e0 as ra, rank() over (partition by clf order by b) + (count(*) over (partition by clf, b) - 1) / 2e0 as rb from j)",
    body="select clf, round(corr(ra, rb), 6) as rho, count(*)::bigint as n from r group by 1",
)
def h11_spearman(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    side = lambda v, n: long.filter(F.col("dataset") == v).select("clf", "repeat", "fold", F.col("acc").alias(n))
    return rounded(comparison.spearman(side("A", "a").join(side("N", "b"), ["clf", "repeat", "fold"]), ["clf"], "a", "b"), "rho")


EVENTS = "v as (select user_id, event_type, round(avg(value), 6) as value from events where value is not null group by 1, 2)"


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").filter("value is not null").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"))


@query(
    more=EVENTS + ", kinds as (select min(event_type) as a, max(event_type) as b from v), j as (select x.value - y.value as d from v x join v y using (user_id), kinds where x.event_type = a and y.event_type = b and x.value <> y.value), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2e0 as r, count(*) over (partition by abs(d)) as t from j)",
    body="select coalesce(sum(r) filter (d > 0), 0) as w_plus, count(*)::bigint as n, round((coalesce(sum(r) filter (d > 0), 0) - count(*) * (count(*) + 1) / 4e0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24e0 - sum(t * t - 1) / 48e0), 6) as z from r",
)
def h12_signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The first event type against the last, paired by user."""
    v = _by_user(spark, d)
    wide = v.groupBy("user_id").agg(F.min_by("value", "event_type").alias("a"), F.max_by("value", "event_type").alias("b"), F.min("event_type").alias("ka"), F.max("event_type").alias("kb"))
    ends = v.agg(F.min("event_type").alias("_a"), F.max("event_type").alias("_b"))
    pairs = wide.crossJoin(F.broadcast(ends)).filter("ka = _a and kb = _b and ka <> kb").withColumn("all", F.lit(1))
    return rounded(comparison.signed_ranks(pairs, ["all"], "a", "b").select("w_plus", "n", "z"), "z")


def _paired_p(k: str) -> str:
    """Two-sided p of a corrected paired t over k folds by Simpson's rule over 400 steps of Student's density."""
    return f"""1 - 2 * exp(lgamma({k} / 2e0) - lgamma(({k} - 1) / 2e0)) / sqrt(({k} - 1) * pi()) * t / 1200
  * list_sum(list_transform(range(0, 401), lambda i: (case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(t * i / 400e0, 2) / ({k} - 1), -{k} / 2e0)))"""


@query(
    "predictions",
    more=FOLDS
    + f""", j as (select a.dataset, clf, a.acc - b.acc as d from long_ a join (select * exclude (dataset) from long_ where dataset = 'A') b using (clf, repeat, fold) where dataset <> 'A'),
t0 as (select dataset, clf, avg(d) as m, count(*) as k, sqrt(var_samp(d) * (1e0 / count(*) + 0.25)) as se from j group by 1, 2),
t1 as (select *, case when se > 0 then abs(m) / se end as t from t0),
t2 as (select *, case when t is not null then {_paired_p("k")} when m = 0 then 1 else 0 end as p from t1),
t3 as (select *, row_number() over (partition by dataset order by p, clf) as r, count(*) over (partition by dataset) as n from t2),
t4 as (select *, least(1, max((n - r + 1) * p) over (partition by dataset order by r)) as p_holm from t3),
s as (select dataset, count_if(p_holm < 0.05 and m > 0) as up, count_if(p_holm < 0.05 and m < 0) as down from t4 group by 1)""",
    body="select dataset, count(*)::bigint as n, count_if(d > 0)::bigint as wins, round(avg(d), 6) as mean_delta, round(min(d), 6) as worst, round(avg(abs(d)), 6) as mean_abs, any_value(up)::bigint as up, any_value(down)::bigint as down from j join s using (dataset) group by 1",
)
def h15_wins(spark: SparkSession, d: str) -> DataFrame:
    """Wins against a baseline and, over classifiers, how many paired tests are significant either way after Holm's correction."""
    long = shared.durable(_long(spark, d))
    return rounded(comparison.wins(long, "dataset", "A", ["clf", "repeat", "fold"], "acc", ["clf"], 0.25), "mean_delta", "worst", "mean_abs")


#: Student's 0.975 quantiles by degrees of freedom.
TQ = "tq(df, q) as (values " + ", ".join(f"({n}, {dist.t_quantile(0.975, n)!r}e0)" for n in range(1, 41)) + ")"


@query(
    "predictions",
    more=FOLDS
    + ", "
    + TQ
    + """, j as (select a.dataset, a.repeat, a.acc - b.acc as d from long_ a join (select dataset, clf, fold, acc from long_ where repeat = (select min(repeat) from long_)) b using (dataset, clf, fold) where a.repeat <> (select min(repeat) from long_)),
e as (select dataset, repeat, avg(d) as m, count(*) as k, sqrt(var_samp(d) * (1e0 / count(*) + 0.25)) as se from j group by 1, 2)""",
    body="select dataset, repeat, round(m, 6) as mean_delta, k::bigint as k, round(m - q * se, 6) as lo, round(m + q * se, 6) as hi, round(min(m) over (partition by dataset), 6) as worst, round(avg(abs(m)) over (partition by dataset), 6) as mean_abs from e left join tq on df = k - 1",
)
def h16_robustness(spark: SparkSession, d: str) -> DataFrame:
    """Years stand for conditions: change against the first, per dataset, with its corrected interval."""
    long = _long(spark, d)
    first = F.broadcast(long.agg(F.min("repeat").alias("_first")))
    base = long.join(first, F.col("repeat") == F.col("_first"), "left_semi").select("dataset", "clf", "fold", F.col("acc").alias("_b"))
    both = long.join(first, F.col("repeat") == F.col("_first"), "left_anti").join(base, ["dataset", "clf", "fold"]).withColumn("_d", F.col("acc") - F.col("_b"))
    return _finite(comparison.robustness(both, ["dataset"], "repeat", "_d", 0.25), "mean_delta", "lo", "hi", "worst", "mean_abs")


def _finite(df: DataFrame, *names: str) -> DataFrame:
    """Rounded, with null for NaN."""
    return df.withColumns({n: F.when(~F.isnan(n), F.round(n, 6)) for n in names})


SEVEN = ["bal_acc", "acc", "sens", "spec", "prec", "npv", "f1"]


@query(
    "predictions",
    more=TQ
    + """, c as (select dataset, clf, repeat, fold, count_if(not y and not pred) as tn, count_if(not y and pred) as fp, count_if(y and not pred) as fn, count_if(y and pred) as tp from predictions group by all),
m as (select dataset, clf, tp / nullif(tp + fn, 0) as sens, tn / nullif(tn + fp, 0) as spec, (tp + tn) / (tn + fp + fn + tp) as acc, tp / nullif(tp + fp, 0) as prec, tn / nullif(tn + fn, 0) as npv, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as bal_acc from c),
l as (select dataset, clf, unnest(['sens', 'spec', 'acc', 'prec', 'npv', 'f1', 'bal_acc']) as metric, unnest([sens, spec, acc, prec, npv, f1, bal_acc]) as v from m),
e as (select dataset, clf, metric, avg(v) as m, stddev_samp(v) as sd, count(v) as k, count(*) as n, sqrt(var_samp(v) * (1e0 / nullif(count(v), 0) + 0.25)) as se from l group by 1, 2, 3)""",
    body="select dataset, clf, metric, round(m, 6) as mean, round(sd, 6) as sd, round(m - q * se, 6) as lo, round(m + q * se, 6) as hi, k::bigint as k, n::bigint as n_folds from e left join tq on df = k - 1",
)
def h14_summary(spark: SparkSession, d: str) -> DataFrame:
    """Seven metrics of every configuration over repeats and folds: mean, sample deviation, corrected interval, folds."""
    folds = metrics.fold_metrics(views.predictions(spark, d), ["dataset", "clf", "repeat", "fold"])
    return _finite(comparison.summary(folds, ["dataset", "clf"], SEVEN, 0.25), "mean", "sd", "lo", "hi")


@query(
    "predictions",
    more=FOLDS
    + """, r as (select a.dataset, a.clf, a.repeat, a.fold, round(a.acc / b.acc, 9) as ratio from long_ a join long_ b on b.dataset = 'A' and a.dataset <> 'A' and a.clf = b.clf and a.repeat = b.repeat and a.fold = b.fold where b.acc > 0),
i as (select dataset, clf, ratio, row_number() over (partition by dataset, clf order by repeat * 100 + fold) - 1 as i, count(*) over (partition by dataset, clf) as n from r),
t as (select dataset, clf, n, s, unnest(range(0, n)) as t from (select distinct dataset, clf, n, unnest(range(0, 2000)) as s from i)),
w as (select *, ('0x' || substr(md5(concat('0|', s, '|', t)), 1, 8))::bigint % n as i from t),
b as (select w.dataset, w.clf, s, quantile_cont(ratio, 0.5) as m from w join i on i.dataset = w.dataset and i.clf = w.clf and i.i = w.i group by 1, 2, 3)""",
    body="select dataset, clf, n::bigint as n, median, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi from b join (select dataset, clf, count(*) as n, round(quantile_cont(ratio, 0.5), 6) as median from r group by 1, 2) using (dataset, clf) group by 1, 2, 3, 4",
)
def h13_median_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The median ratio of accuracies to the baseline over repeats and folds, with a bootstrap interval (2000 resamples)."""
    long = _long(spark, d)
    base = long.filter("dataset = 'A' and acc > 0").select("clf", "repeat", "fold", F.col("acc").alias("_b"))
    ratios = long.filter("dataset <> 'A'").join(base, ["clf", "repeat", "fold"]).select("dataset", "clf", (F.col("repeat") * 100 + F.col("fold")).alias("item"), F.round(F.col("acc") / F.col("_b"), 9).alias("ratio"))
    return rounded(comparison.bootstrap_median(ratios, ["dataset", "clf"], "item", "ratio", resamples=2000), "median", "lo", "hi")


@query(more=EVENTS, body="select user_id, event_type, round(value / nullif(max(value) filter (event_type in ('click', 'view')) over (partition by user_id), 0), 6) as gain from v")
def h17_gain(spark: SparkSession, d: str) -> DataFrame:
    out = comparison.gain(_by_user(spark, d), ["user_id"], "event_type", ["click", "view"], "value")
    return rounded(out.select("user_id", "event_type", "gain"), "gain")


@query(more="p as (select l_orderkey as id, round(avg(l_discount * 10), 9) as proba, round_even(avg((l_tax > 0.04)::int), 0) as hard from lineitem group by 1)", body="select id, cast(hard as int) as hard, (proba >= 0.5)::int as soft from p")
def c12_votes(spark: SparkSession, d: str) -> DataFrame:
    line = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_tax") > 0.04).alias("pred"), (F.col("l_discount") * 10).alias("proba"))
    return comparison.votes(line, ["id"]).select("id", "hard", "soft")


@query("subjects", more="r as (select *, unnest(range(0, 3)) as repeat from subjects)", body="select id, label, cast(repeat as int) as repeat, cast((row_number() over (partition by repeat, label order by md5(concat(2026 + repeat, '|', id)), id) - 1) % 5 as int) as fold from r")
def c2_repeated_folds(spark: SparkSession, d: str) -> DataFrame:
    return rules.repeated_folds(views.subjects(spark, d), "label", 3).select("id", "label", "repeat", "fold")


@query("scored", more="g as (select group_id, count(*) as n, (2 * count_if(y) >= count(*))::int as major from scored group by 1), r as (select *, unnest(range(0, 2)) as repeat from g)", body="select group_id, n::bigint as n, cast(repeat as int) as repeat, cast((row_number() over (partition by repeat, major order by md5(concat(2026 + repeat, '|', group_id)), group_id) - 1) % 5 as int) as fold from r")
def c3_group_folds(spark: SparkSession, d: str) -> DataFrame:
    return rules.group_folds(views.scored(spark, d), "group_id", "y", 2).select("group_id", "n", "repeat", "fold")


@query("radii", body="select cohort, round(pupil_r / iris_r, 6) as rho, round((iris_r - pupil_r) / iris_r, 6) as tau, round(abs(dx) / iris_r, 6) as eps, count(*)::bigint as n from radii group by all")
def g1_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The scale-free vectors that occur, with their counts."""
    g = rules.geometry(views.radii(spark, d))
    return g.groupBy("cohort", *[F.round(c, 6).alias(c) for c in ("rho", "tau", "eps")]).agg(F.count(F.lit(1)).alias("n"))


@query("pixels", more="u as (select image_id, row, col, col - 3e0 as u, row - 3.5e0 as v from pixels), q as (select *, u * 0.5e0 + 3 as b, u * u + v * v - 1 as c from u), s as (select *, case when c < 0 then -1e0 else (b - sqrt(b * b + 8.75e0 * c)) / -8.75e0 end as s from q), t as (select *, atan2(v, u - s * 0.5e0) as t from s)", body="select image_id, row, col, round(s, 6) as s, round(case when s >= 0 then case when t < 0 then t + 2 * pi() else t end end, 6) as theta from t")
def g5_ring_coordinates(spark: SparkSession, d: str) -> DataFrame:
    px = views.pixels(spark, d).select("image_id", "row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    out = comparison.ring_coordinates(px, (3.0, 3.5, 1.0), (3.5, 3.5, 4.0))
    return rounded(out.select("image_id", "row", "col", "s", "theta"), "s", "theta")


@query(
    more="""e as (select user_id as ray, row_number() over (partition by user_id order by ts, event_id) as pos, value from events where value is not null),
d as (select ray, pos, (lead(value) over w - lag(value) over w) / 2 as d from e window w as (partition by ray order by pos)),
n as (select *, lag(d) over w as b, lead(d) over w as a, max(d) over (partition by ray) as top from d where d is not null window w as (partition by ray order by pos))""",
    body="select ray, min(pos) filter (d >= coalesce(b, d) and d >= coalesce(a, d) and d >= 0.3e0 * top) as edge, min(pos) filter (d = top) as limbus from n group by 1",
)
def g6_ring_edges(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rays = views.table(spark, d, "events").filter("value is not null").select(F.col("user_id").alias("ray"), at.alias("at"), "value")
    return comparison.ring_edges(rays)


@query(
    more="""p as (select l_suppkey as k, l_quantity::bigint as x, round(100 * l_tax)::bigint + l_linenumber as y from lineitem),
s as (select k, count(*)::double as n, sum(x)::double as sx, sum(y)::double as sy, sum(x * x)::double as sxx, sum(y * y)::double as syy, sum(x * y)::double as sxy, sum(x * x + y * y)::double as sz, sum(x * (x * x + y * y))::double as sxz, sum(y * (x * x + y * y))::double as syz from p group by 1),
m as (select *, n * sxx - sx * sx as a, n * sxy - sx * sy as b, n * syy - sy * sy as d, n * sxz - sx * sz as e, n * syz - sy * sz as f from s),
c as (select *, (e * d - f * b) / (2 * (a * d - b * b)) as cx, (f * a - e * b) / (2 * (a * d - b * b)) as cy from m where a * d - b * b <> 0)""",
    body="select s.k as supplier, round(cx, 6) as cx, round(cy, 6) as cy, round(sqrt((c.sz - 2 * cx * c.sx - 2 * cy * c.sy) / c.n + cx * cx + cy * cy), 6) as radius from s left join c on c.k = s.k",
)
def g7_circle_fit(spark: SparkSession, d: str) -> DataFrame:
    line = views.table(spark, d, "lineitem")
    points = line.select(F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("long").alias("x"), (F.round(100 * F.col("l_tax")).cast("long") + F.col("l_linenumber")).alias("y"))
    return rounded(comparison.circle_fit(points, ["supplier"]), "cx", "cy", "radius")


@query(
    more="""p0 as (select l_suppkey as k, l_quantity as x, (round(100 * l_tax)::bigint + l_linenumber)::double as y from lineitem),
p as (select *, row_number() over (partition by k order by x, y) - 1 as i from p0), n as (select k, count(*) as n from p group by 1),
d0 as (select k, n, s, ('0x' || substr(md5(concat('0|', s, '|0')), 1, 8))::bigint % n as a, ('0x' || substr(md5(concat('0|', s, '|1')), 1, 8))::bigint % (n - 1) as b0, ('0x' || substr(md5(concat('0|', s, '|2')), 1, 8))::bigint % (n - 2) as c0 from (select *, unnest(range(0, 25)) as s from n where n >= 3)),
d1 as (select *, b0 + (b0 >= a)::int as b from d0), d2 as (select *, c0 + (c0 >= least(a, b))::int as c1 from d1), d as (select k, s, a, b, c1 + (c1 >= greatest(a, b))::int as c from d2),
t as (select k, s, unnest([a, b, c]) as i from d),
fit as (select k, s, 3e0 as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(y * y) as syy, sum(x * y) as sxy, sum(x * x + y * y) as sz, sum(x * (x * x + y * y)) as sxz, sum(y * (x * x + y * y)) as syz from t join p using (k, i) group by 1, 2),
sol as (select *, n * sxx - sx * sx as aa, n * sxy - sx * sy as bb, n * syy - sy * sy as dd, n * sxz - sx * sz as ee, n * syz - sy * sz as ff from fit),
cir0 as (select k, s, (ee * dd - ff * bb) / (2 * (aa * dd - bb * bb)) as cx, (ff * aa - ee * bb) / (2 * (aa * dd - bb * bb)) as cy, sz, sx, sy, n from sol where aa * dd - bb * bb <> 0),
cir as (select k, s, cx, cy, sqrt((sz - 2 * cx * sx - 2 * cy * sy) / n + cx * cx + cy * cy) as r from cir0),
v as (select k, s, count(*) as votes from p join cir using (k) where r > 0 and abs(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - r) < 2 group by 1, 2),
best as (select k, arg_max(s, votes * 1000 - s) as s, max(votes) as votes from v group by 1),
used as (select p.k, x, y from p join best using (k) join cir using (k, s) where votes >= 3 and abs(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - r) < 2),
f2 as (select k, count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(y * y) as syy, sum(x * y) as sxy, sum(x * x + y * y) as sz, sum(x * (x * x + y * y)) as sxz, sum(y * (x * x + y * y)) as syz from used group by 1),
s2 as (select *, n * sxx - sx * sx as aa, n * sxy - sx * sy as bb, n * syy - sy * sy as dd, n * sxz - sx * sz as ee, n * syz - sy * sz as ff from f2),
c2 as (select k, n, sz, sx, sy, (ee * dd - ff * bb) / (2 * (aa * dd - bb * bb)) as cx, (ff * aa - ee * bb) / (2 * (aa * dd - bb * bb)) as cy from s2)""",
    body="select k as supplier, round(cx, 6) as cx, round(cy, 6) as cy, round(sqrt((sz - 2 * cx * sx - 2 * cy * sy) / n + cx * cx + cy * cy), 6) as radius, n::bigint as inliers from c2",
)
def g8_consensus_circle(spark: SparkSession, d: str) -> DataFrame:
    """The circle that most points of a supplier agree on to within 2, of 25 hashed triples."""
    line = views.table(spark, d, "lineitem")
    points = line.select(F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("double").alias("x"), (F.round(100 * F.col("l_tax")).cast("long") + F.col("l_linenumber")).cast("double").alias("y"))
    return rounded(comparison.consensus_circle(points, ["supplier"], triples=25), "cx", "cy", "radius")


@query(more="e as (select l_returnflag as cohort, l_discount as m, l_tax as t, l_discount - l_tax as e from lineitem)", body="select cohort, round(avg(abs(e)), 6) as mae, round(quantile_cont(abs(e), 0.5), 6) as median, round(quantile_cont(abs(e), 0.95), 6) as p95, round(max(abs(e)), 6) as worst, round(avg(e), 6) as bias, count_if(abs(e) > 0.03)::bigint as over, round(corr(m, t), 6) as r from e group by 1")
def g9_error_report(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cohort"), "l_discount", "l_tax")
    return rounded(comparison.error_report(rows, ["cohort"], "l_discount", "l_tax", 0.03), "mae", "median", "p95", "worst", "bias", "r")
