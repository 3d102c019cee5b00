"""Many small models fitted at once: every key (configuration, repeat, fold, ...) is a model, and a step of all of them is one job.

Logistic regression takes Newton steps: tasks sum gradients and Hessians of all models over their own rows, as matrix
products, and a grouped sum adds up the tasks'. A row that trains many models is held once, with the names of its models.
Boosted stumps take one grouped histogram per round. No fit is a job of its own. A model's state is its coefficients; rows
stay where Spark dealt them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripcohort.operators import rules
from stripcohort.sources.shared import durable, forget


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _spread(rows: DataFrame) -> DataFrame:
    """A table over as many files as the session has partitions: rows are few for the work that each takes in every step."""
    return durable(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def training_rows(rows: DataFrame, keys: list[str], fold: str, k: int) -> DataFrame:
    """Each row once for every model whose training part holds it: those of the other folds 0 .. k - 1, which take the place of its own."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
    return rows.select(*keys, *[c for c in rows.columns if c not in (*keys, fold)], F.explode(others).alias(fold)).withColumn(fold, F.col(fold).cast("int"))


def members(keys: list[str], fold: str, k: int) -> Column:
    """The models that a row trains, as an array of structs (keys, fold): those that training_rows() gives it a row for."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
    return F.transform(others, lambda f: F.struct(*keys, f.alias(fold)))


def _scaled(x: str, mean: str, spread: str) -> Column:
    """The intercept's 1, then the standardised features."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), spread, lambda a, s: F.when(s > 0, a / s).otherwise(0.0))
    return F.concat(F.array(F.lit(1.0)), z)


def _sums(rows: DataFrame, known: set[int], part: Callable, top: bool = False) -> dict[int, np.ndarray]:
    """model -> the sum (or, with top, the largest) of part(model, x, y) over the rows of each known model: x a matrix, y 0 or 1.

    rows: models (array<long>), x, y. A task gives an array per model, or one more whenever it holds 64 MB of them.
    """
    both = np.maximum if top else np.add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], names=["m", "s"])
            found.clear()
            return made

        for batch in batches:
            models, x = batch.column("models"), batch.column("x")
            y, named, values, sizes = batch.column("y").to_numpy(), models.flatten().to_numpy(), x.flatten().to_numpy(), x.value_lengths().to_numpy()
            starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(y)), models.value_lengths().to_numpy())
            order = np.argsort(named, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(named[order])) + 1) if len(order) else []:
                m, of = int(named[at[0]]), row[at]
                if m in known:
                    got = part(m, values[starts[of][:, None] + np.arange(sizes[of[0]])], y[of])
                    found[m] = both(found[m], got) if m in found else got
            if sum(v.nbytes for v in found.values()) > 1 << 26:
                yield out()
        if found:
            yield out()

    each = rows.select("models", "x", "y").mapInArrow(run, "m long, s array<double>").select("m", F.posexplode("s").alias("i", "v"))
    added = each.groupBy("m", "i").agg((F.max if top else F.sum)("v").alias("v"))
    return {r["m"]: np.array(r["s"]) for r in added.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).getField("v").alias("s")).collect()}


def logistic(train: DataFrame, keys: list[str], c: float = 1.0, steps: int = 50, tolerance: float = 1e-9, of: str | None = None) -> DataFrame:
    """keys, mean, spread, w: L2 logistic regressions (strength c, the intercept w[0] free) of standardised features.

    train: keys, y (boolean), x (array of numbers), as many features for all rows of a key. With a column `of` (array of structs
    of the keys) a row trains all models named there, and is held and sent to tasks once. A model whose rows lack a class,
    or have nulls in y or x, isn't fitted from them: the rows with nulls fall away, and a key of one class has no model. What
    the tasks sum up per model comes to the driver, rows never.
    """
    clean = train.filter(F.col("y").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    named = clean.select((F.array(F.struct(*keys)) if of is None else F.col(of)).alias("of"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"))
    # a model goes by the hash of its key
    rows = _spread(named.withColumn("models", F.transform("of", lambda k: F.xxhash64(k))))
    counts = rows.select("y", F.inline(F.arrays_zip("of", "models"))).groupBy("of", "models").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n"))
    both = [r for r in counts.filter("ones > 0 and ones < n").collect() if all(r["of"][k] is not None for k in keys)]
    key, many = {r["models"]: r["of"] for r in both}, {r["models"]: r["n"] for r in both}
    if len(key) < len(both):
        raise ValueError("two models have keys of one hash")
    known = set(key)
    schema = T.StructType([*[T.StructField(k, rows.schema["of"].dataType.elementType[k].dataType) for k in keys], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("mean", "spread", "w")]])
    if not known:
        return train.sparkSession.createDataFrame([], schema)
    mean = {m: s / many[m] for m, s in _sums(rows, known, lambda m, x, y: x.sum(axis=0)).items()}
    ends = _sums(rows, known, lambda m, x, y: np.concatenate([x.max(axis=0), -x.min(axis=0)]), top=True)
    squares = _sums(rows, known, lambda m, x, y: ((x - mean[m]) ** 2).sum(axis=0))
    # 0 for a constant feature
    spread = {m: np.where(ends[m][: len(s)] == -ends[m][len(s) :], 0.0, np.sqrt(s / many[m])) for m, s in squares.items()}
    inverse = {m: np.divide(1.0, s, out=np.zeros_like(s), where=s > 0) for m, s in spread.items()}
    w = {m: np.zeros(len(s) + 1) for m, s in spread.items()}

    def step(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The Hessian's rows, then the gradient, without penalties."""
        z = np.hstack([np.ones((len(x), 1)), (x - mean[m]) * inverse[m]])
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-z @ w[m]))
        weight = np.maximum(p * (1 - p), 1e-12)
        return np.concatenate([(z.T @ (z * weight[:, None])).ravel(), z.T @ (p - y)])

    for _ in range(steps):
        most = 0.0
        for m, sums in _sums(rows, known, step).items():
            n = len(w[m])
            ridge = np.array([0.0, *[1 / c] * (n - 1)])
            move = np.linalg.solve(sums[: n * n].reshape(n, n) + np.diag(ridge), sums[n * n :] + ridge * w[m])
            far = np.abs(move).max()
            w[m] = w[m] - move * min(1.0, 10 / max(far, 1e-300))  # a step is bounded, so flat regions don't throw it far
            most = max(most, far)
        if most <= tolerance:
            break
    forget(rows)
    return train.sparkSession.createDataFrame([(*key[m], mean[m].tolist(), spread[m].tolist(), w[m].tolist()) for m in w], schema)


def scores(models: DataFrame, rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """keys, keep, score (probability of class 1) and pred of rows (keys, x) under their key's model; rows without a model fall away."""
    at = rows.join(models, keys)
    p = 1 / (1 + F.exp(-_dot(_scaled("x", "mean", "spread"), "w")))
    return at.select(*keys, *keep, p.alias("score")).withColumn("pred", F.col("score") > 0.5)


def cross_validated(rows: DataFrame, keys: list[str], fold: str = "fold", k: int = 5, c: float = 1.0) -> DataFrame:
    """keys, fold, id, y, score, pred: logistic models of every key and fold, all fitted at once, each scoring its own fold.

    rows: keys, id, y, x, fold.
    """
    rows = durable(rows.select(*keys, "id", "y", F.col("x").cast("array<double>").alias("x"), fold))
    models = logistic(rows.withColumn("_of", members(keys, fold, k)), [*keys, fold], c, of="_of")
    return scores(models, rows, [*keys, fold], ["id", "y"])


def stacked(rows: DataFrame, blocks: list[str], k: int = 5, inner: int = 5, seed: int = 42) -> DataFrame:
    """model, id, fold, y, score, pred of rows (id, y, an array per block, fold): every block alone, and `fusion`, a model of the blocks'
    out-of-fold scores, over the same folds.

    Inner folds are dealt within each outer training part. All blocks' models, inner and whole, are one batch; all
    fusions another.
    """
    outer = durable(rows)
    train = durable(training_rows(outer.select("id", "y", "fold"), [], "fold", k))
    of = train.withColumn("_stratum", F.concat_ws("|", "fold", "y"))
    dealt = durable(rules.numbered(of, "_stratum", rules.seeded(seed + 1, "id"), "id", "_at").select("id", "y", "fold", (F.col("_at") % inner).cast("int").alias("inner")))
    # each row and block once, with its inner fold in every outer training part
    lies = dealt.groupBy("id").agg(F.collect_list(F.struct("fold", "inner")).alias("_in"))
    listed = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).cast("array<double>").alias("x")) for b in blocks])
    long = durable(outer.withColumnRenamed("fold", "_own").join(lies, "id", "left").select("id", "y", "_own", "_in", F.inline(listed)))
    by = ["block", "fold", "inner"]
    # inner -1: the whole outer training part
    others = lambda d: F.filter(F.sequence(F.lit(-1), F.lit(inner - 1)), lambda i: i != d["inner"])
    parts = F.flatten(F.transform("_in", lambda d: F.transform(others(d), lambda i: F.struct(F.col("block"), d["fold"].alias("fold"), i.alias("inner")))))
    models = logistic(long.withColumn("_of", parts), by, of="_of")
    level = scores(models, long.select("id", "y", "block", "x", F.inline("_in")), by, ["id", "y"])
    held = long.select("id", "y", "block", "x", F.col("_own").alias("fold"), F.lit(-1).alias("inner"))
    alone = durable(scores(models, held, by, ["id", "y"]))

    def side(df: DataFrame) -> DataFrame:
        got = df.groupBy("fold", "id").agg(F.max("y").alias("y"), *[F.max(F.when(F.col("block") == b, F.col("score"))).alias(f"_{n}") for n, b in enumerate(blocks)])
        return got.select("fold", "id", "y", F.array(*[f"_{n}" for n in range(len(blocks))]).alias("x"))

    fused = scores(logistic(side(level), ["fold"]), side(alone), ["fold"], ["id", "y"])
    return alone.select(F.col("block").alias("model"), "id", "fold", "y", "score", "pred").unionByName(fused.select(F.lit("fusion").alias("model"), "id", "fold", "y", "score", "pred"))


def boosted(train: DataFrame, keys: list[str], rounds: int = 50, bins: int = 256) -> dict[tuple, list[tuple[int, float, int, float]]]:
    """Boosted stumps of every key: a list of (feature, threshold, side, weight), side 1 if values above the threshold are class 1.

    train: keys, y, x. Thresholds lie between the values of a feature, or at its quantiles if it has more than `bins`
    values. A round is one job: row weights follow from the stumps so far, histograms of weight by key, feature and bin
    are summed, and running sums over a feature's bins give each key's least error (of equals the lowest feature, then
    threshold, then side 1). A key stops when a stump makes no error (it then stands alone with weight 1, or ends the
    list) or none is better than chance. A few numbers per key come to the driver, never rows.
    """
    rows = train.filter(F.col("y").isNotNull() & F.col("x").isNotNull()).select(F.struct(*keys).alias("key"), F.col("y").cast("int").alias("y"), F.col("x").cast("array<double>").alias("x"))
    rows = _spread(rows)
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    few = each.agg(F.count_distinct("v").alias("n"), F.percentile_approx("v", [j / bins for j in range(1, bins)], 10_000).alias("q"))
    plain = rows.select(F.posexplode("x").alias("i", "v")).join(few.filter(F.col("n") <= bins).select("i"), "i").groupBy("i").agg(F.sort_array(F.collect_set("v")).alias("e"))
    edges = few.join(plain, "i", "left").select("i", F.coalesce("e", F.array_distinct("q")).alias("e"))
    ends = [r["e"] for r in edges.orderBy("i").collect()]  # at most `bins` numbers a feature
    cuts = [[(a + b) / 2 for a, b in zip(e, e[1:], strict=False)] if len(e) < bins - 1 else e for e in ends]
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{c!r}D" for c in e) + ")" if e else "cast(array() as array<double>)" for e in cuts) + ")")
    spark = train.sparkSession
    binned = _spread(rows.select("key", "y", F.zip_with("x", table, lambda v, e: F.size(F.filter(e, lambda t: t < v))).alias("b")))
    found: dict[tuple, list[tuple[int, int, int, float]]] = {tuple(r["key"]): [] for r in binned.select("key").distinct().collect()}
    open_ = set(found)
    for _ in range(rounds):
        if not open_:
            break
        stumps = spark.createDataFrame([(k, [(int(i), int(b), int(s), float(w)) for i, b, s, w in found[k]]) for k in open_], f"key {rows.schema['key'].dataType.simpleString()}, t array<struct<i: int, b: int, s: int, w: double>>")
        missed = F.aggregate("t", F.lit(0.0), lambda a, s: a + F.when(((F.get(F.col("b"), s["i"]) > s["b"]) == (s["s"] == 1)) == (F.col("y") == 1), 0.0).otherwise(s["w"]))
        weighed = binned.join(F.broadcast(stumps), "key").select("key", "y", "b", F.exp(missed).alias("w"))
        cells = weighed.select("key", "y", "w", F.posexplode("b").alias("i", "bin")).groupBy("key", "i", "bin").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("w1"), F.sum("w").alias("w"))
        upto, whole = W.partitionBy("key", "i").orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("key", "i")
        run = cells.select("key", "i", "bin", F.sum("w1").over(upto).alias("l1"), F.sum("w").over(upto).alias("l"), F.sum("w1").over(whole).alias("a1"), F.sum("w").over(whole).alias("a"))
        # side 1: at or below the cut is class 0, so errors are class 1 below and class 0 above
        error = F.round((F.col("l1") + (F.col("a") - F.col("l")) - (F.col("a1") - F.col("l1"))) / F.col("a"), 12)
        both = run.filter("l < a * (1 - 1e-15)").select("key", F.inline(F.array(F.struct(error.alias("e"), "i", "bin", F.lit(1).alias("s")), F.struct((1 - error).alias("e"), "i", "bin", F.lit(0).alias("s")))))
        best = both.groupBy("key").agg(F.min(F.struct("e", "i", "bin", (-F.col("s")).alias("s"))).alias("m")).collect()  # a row per key
        seen = set()
        for r in best:
            key, m = tuple(r["key"]), r["m"]
            seen.add(key)
            if m["e"] <= 1e-12:
                found[key].append((m["i"], m["bin"], -m["s"], 1.0))
                open_.discard(key)
            elif m["e"] >= 0.5 - 1e-12:
                open_.discard(key)
            else:
                found[key].append((m["i"], m["bin"], -m["s"], math.log((1 - m["e"]) / m["e"])))
        open_ &= seen
    return {k: [(i, cuts[i][b], s, w) for i, b, s, w in v] for k, v in found.items()}


def boosted_scores(models: dict[tuple, list[tuple[int, float, int, float]]], rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """keys, keep, score (the stumps' weighted vote from -1 to 1) and pred of rows (keys, x) under their key's stumps; keys without stumps fall away."""
    kind = rows.select(F.struct(*keys).alias("k")).schema["k"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(k, [(int(i), float(c), int(s), float(w)) for i, c, s, w in t]) for k, t in models.items() if t], f"_key {kind}, _t array<struct<i: int, c: double, s: int, w: double>>")
    at = rows.join(F.broadcast(table), F.struct(*keys) == F.col("_key"))
    vote = F.aggregate("_t", F.lit(0.0), lambda a, s: a + F.when((F.get(F.col("x"), s["i"]) > s["c"]) == (s["s"] == 1), s["w"]).otherwise(-s["w"]))
    whole = F.aggregate("_t", F.lit(0.0), lambda a, s: a + s["w"])
    return at.select(*keys, *keep, (vote / whole).alias("score")).withColumn("pred", F.col("score") > 0)
