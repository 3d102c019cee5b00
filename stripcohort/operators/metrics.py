"""Metrics of scored rows: confusion cells, rates, AUC, curves, summaries, and the tables made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import prefix


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tn, fp, fn, tp per key, of boolean y and pred."""
    cell = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    return rows.groupBy(*keys).agg(cell(False, False).alias("tn"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(True, True).alias("tp"))


def rates(cells: DataFrame) -> DataFrame:
    """acc, sens, spec, prec, npv, f1 and bal_acc of the cells; null where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    named = {"acc": _ratio(tp + tn, tn + fp + fn + tp), "sens": sens, "spec": spec, "prec": _ratio(tp, tp + fp), "npv": _ratio(tn, tn + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "bal_acc": (sens + spec) / 2}
    return cells.withColumns(named)


RATES = ["acc", "sens", "spec", "prec", "npv", "f1", "bal_acc"]


def fold_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rates(confusion(rows, keys))


def _points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pos and neg of every distinct score of a key."""
    return rows.filter(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))


def auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve per key, ties half; null with one class only. A key of any size is ranked in pieces."""
    at = prefix.running(_points(rows, keys), keys, "score", {"upto": ("sum", "neg")})
    wins = at.withColumn("win", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return wins.groupBy(*keys).agg(_ratio(F.sum("win"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """fpr, tpr per key and threshold (predicted true at scores of at least it), and the counts they come from."""
    at = _points(rows, keys).withColumn("_fall", -F.col("score"))
    upto = prefix.running(at, keys, "_fall", {"tp": ("sum", "pos"), "fp": ("sum", "neg")}).drop("_fall")
    whole = at.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    out = prefix.joined(upto, whole, keys)
    return out.select(*keys, "score", _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"), "tp", "fp", "pos", "n_pos")


def roc_on_grid(rows: DataFrame, keys: list[str], steps: int = 200) -> DataFrame:
    """tpr at fpr = 0, 1/steps, ..., 1, linear between the curve's points; of points at one fpr the highest counts.

    Between two grid points only the first and the last of the curve's can bear on the grid, so a key has no more than
    2 * steps + 2 points when they are put in order.
    """
    best = roc(rows, keys).groupBy(*keys, "fpr").agg(F.max("tpr").alias("tpr"))
    start = rows.select(*keys).distinct().select(*keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    step_of = lambda c: F.ceil(F.round(F.col(c) * steps, 9)).cast("int")
    point = F.struct("fpr", "tpr")
    ends = best.union(start).groupBy(*keys, step_of("fpr").alias("_bin")).agg(F.min_by(point, F.struct("fpr", -F.col("tpr"))).alias("_a"), F.max_by(point, point).alias("_z"))
    curve = ends.select(*keys, F.inline(F.array("_a", "_z"))).groupBy(*keys, "fpr").agg(F.max("tpr").alias("tpr"))
    after = W.partitionBy(*keys).orderBy("fpr")
    pieces = curve.withColumns({"f1": F.lead("fpr").over(after), "t1": F.lead("tpr").over(after)})
    last = F.when(F.col("f1").isNull(), F.lit(steps)).otherwise(step_of("f1") - 1)
    grid = pieces.filter(F.col("f1").isNull() | (step_of("fpr") <= step_of("f1") - 1)).withColumn("step", F.explode(F.sequence(step_of("fpr"), last)))
    x = F.col("step") / steps
    value = F.when(F.col("f1").isNull(), F.col("tpr")).otherwise(F.col("tpr") + (x - F.col("fpr")) * (F.col("t1") - F.col("tpr")) / (F.col("f1") - F.col("fpr")))
    return grid.select(*keys, "step", value.alias("tpr"))


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of precision times the step of recall over falling scores."""
    points = roc(rows, keys)
    return points.groupBy(*keys).agg(F.sum(_ratio(F.col("pos"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def across_folds(folds: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """mean_ and sd_ (population) of each metric."""
    return folds.groupBy(*keys).agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def best_by(rows: DataFrame, keys: list[str], metric: str, order: str) -> DataFrame:
    """Each key's row with the largest metric; of equals the first by order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), order))).filter("_r = 1").drop("_r")


def class_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1, support per class, and their macro and weighted means; 0 where undefined."""
    cells = confusion(rows, keys)
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def of(name: str, tp: str, fp: str, fn: str) -> DataFrame:
        t, p, n = F.col(tp), F.col(fp), F.col(fn)
        return cells.select(*keys, F.lit(name).alias("class"), zero(_ratio(t, t + p)).alias("precision"), zero(_ratio(t, t + n)).alias("recall"), zero(_ratio(2 * t, 2 * t + p + n)).alias("f1"), (t + n).cast("long").alias("support"))

    each = of("0", "tn", "fn", "fp").union(of("1", "tp", "fp", "fn"))
    names = ["precision", "recall", "f1"]
    macro = each.groupBy(*keys).agg(F.lit("macro").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = each.groupBy(*keys).agg(F.lit("weighted").alias("class"), *[zero(_ratio(F.sum(F.col(n) * F.col("support")), F.sum("support"))).alias(n) for n in names], F.sum("support").alias("support"))
    return reduce(DataFrame.union, [each, macro, weighted])


def number_table(rows: DataFrame, keys: list[str], shares: list[str], counts: list[str], digits: int = 4) -> DataFrame:
    """key (family_keys), value and shown of every column of shares and counts: counts are shown whole, shares with a decimal comma."""
    entry = lambda n, shown: F.struct(F.concat_ws("_", F.lit(n), *keys).alias("key"), F.round(F.col(n).cast("double"), 6).alias("value"), shown.alias("shown"))
    comma = lambda n: F.translate(F.format_string(f"%.{digits}f", F.col(n)), ".", ",")
    return rows.select(F.inline(F.array(*[entry(n, comma(n)) for n in shares], *[entry(n, F.col(n).cast("long").cast("string")) for n in counts])))
