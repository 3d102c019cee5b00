"""Learners, folds and fusion on planted signals; statistics on the edges that the given tables never reach."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from stripcohort.operators import blocks, comparison, dist, learners, metrics, prefix, regions, rules, similar
from stripcohort.sources import shared, store


@pytest.fixture(scope="module")
def planted(spark):
    """id, y, texture (noise) and geometry (a ratio that differs by class)."""
    rng = random.Random(3)
    rows = []
    for i in range(160):
        y = i % 2 == 0
        rho = rng.gauss(0.42 if y else 0.34, 0.04)
        rows.append((i, y, [rng.gauss(0, 1) for _ in range(10)], [rho, 1 - rho, abs(rng.gauss(0, 0.1))]))
    return spark.createDataFrame(rows, "id long, y boolean, texture array<double>, geometry array<double>")


def test_fusion_recovers_a_planted_signal(planted):
    found = learners.compared_fusion(planted, ["texture", "geometry"], k=2, inner=2)
    auc = {r["model"]: r["auc"] for r in metrics.auc(found, ["model"]).collect()}
    assert auc["texture"] < 0.65 and auc["geometry"] > 0.85 and auc["fusion"] > auc["texture"] + 0.2
    assert found.groupBy("model").agg(F.count_distinct("id").alias("n")).filter("n <> 160").count() == 0


def test_every_learner_scores_each_row_once(planted):
    rows = rules.stratified_folds(planted.withColumnRenamed("geometry", "features").drop("texture"), "y", 2)
    some = {"logistic": learners.logistic(), "forest": learners.forest(10, 5), "perceptron": learners.perceptron((5,), 30)}
    found = learners.cross_validated(rows, some, k=2)
    assert {(r["clf"], r["count"]) for r in found.groupBy("clf").count().collect()} == {(n, 160) for n in some}
    assert all(r["acc"] > 0.7 for r in metrics.fold_metrics(found, ["clf"]).collect())
    # a training part of one class has no model
    one = rows.withColumn("fold", F.when(F.col("y"), 0).otherwise(1))
    assert learners.cross_validated(one, {"logistic": learners.logistic()}, k=2).count() == 0


def test_models_fitted_clean_score_conditions(planted):
    rows = rules.stratified_folds(planted.withColumnRenamed("geometry", "features").drop("texture"), "y", 2)
    same = rows.select("id", "features", F.lit("same").alias("condition"))
    turned = rows.select("id", F.transform("features", lambda x, i: F.when(i == 0, 0.76 - x).when(i == 1, 1.24 - x).otherwise(x)).alias("features"), F.lit("turned").alias("condition"))
    found = learners.cross_validated(rows, {"logistic": learners.logistic()}, k=2, tests=same.union(turned))
    acc = {r["condition"]: r["acc"] for r in metrics.fold_metrics(found, ["condition"]).collect()}
    assert acc["same"] == acc["clean"] > 0.8 > 0.5 > acc["turned"]


def test_logistic_has_the_strength_of_a_sum_of_losses(spark):
    # one feature of deviation 1, four rows: at the optimum w = c * sum of (y - p) * x
    rows = learners.vectors(spark.createDataFrame([(float(x), y) for x, y in ((-1.2, False), (-0.4, True), (0.6, False), (1.0, True))], "x double, y boolean").withColumn("features", F.array("x")))
    model = learners.fitted(rows, {"m": learners.logistic(2.0)})["m"]
    w, b = model.stages[-1].coefficients[0], model.stages[-1].intercept
    scaled = [(r["scaled"][0], r["label"]) for r in model.transform(rows).collect()]
    assert sum(s * s for s, _ in scaled) == pytest.approx(4)  # population deviation
    assert w == pytest.approx(2.0 * sum((y - 1 / (1 + math.exp(-(w * s + b)))) * s for s, y in scaled), abs=1e-3)


def test_pieces_equal_one_pass(spark, monkeypatch):
    from stripcohort.operators import prefix as pieces

    monkeypatch.setattr(pieces, "WHOLE", 0)  # keys of any length are cut
    rng = random.Random(2)
    rows = [(k, rng.choice([round(rng.random(), 3), 0.5]), rng.random() < 0.4) for k in ("a", "b", None) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, score double, y boolean")
    got = {r["k"]: r["auc"] for r in metrics.auc(df, ["k"]).collect()}
    for k in ("a", "b", None):
        own = [(s, y) for q, s, y in rows if q == k]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        assert got[k] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    ends = {r["k"]: r["m"] for r in prefix.quantiles(df, ["k"], "score", {"m": 0.37}).collect()}
    for k in ("a", "b", None):
        own = sorted(s for q, s, _ in rows if q == k)
        at = 0.37 * (len(own) - 1)
        assert ends[k] == pytest.approx(own[int(at)] + (at - int(at)) * (own[int(at) + 1] - own[int(at)]))


def test_corrections_known_values_and_ties(spark):
    p = [0.01, 0.04, 0.03]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)] + [("g", 9, None)], "family string, id int, p double")
    assert [r["p_holm"] for r in rules.holm(df, "family").orderBy("id").collect()] == [pytest.approx(x) for x in (0.03, 0.06, 0.06)] + [None]
    rng = random.Random(8)
    p = [round(rng.random() ** 3, 2) for _ in range(500)]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "family string, id int, p double")
    order = sorted(range(500), key=lambda i: (p[i], i))
    want, top = {}, 0.0
    for rank, i in enumerate(order):
        top = max(top, (500 - rank) * p[i])
        want[i] = min(1, top)
    assert {r["id"]: r["p_holm"] for r in rules.holm(df, "family").collect()} == {i: pytest.approx(x) for i, x in want.items()}
    want, low = {}, math.inf
    for rank, i in reversed(list(enumerate(order))):
        low = min(low, p[i] * 500 / (rank + 1))
        want[i] = min(1, low)
    assert {r["id"]: r["q"] for r in rules.benjamini_hochberg(df, "family").collect()} == {i: pytest.approx(x) for i, x in want.items()}


def test_geometry_without_radius_is_invalid(spark):
    cases = [(0.40, 0, 1.0, "valid"), (0.18, 0, 0.75, "borderline"), (0.12, 0, 0.40, "invalid"), (0.72, 0, 0.75, "borderline"), (0.78, 0, 0.45, "invalid"), (0.40, 0.40, 0.70, "borderline"), (0.88, 0, 0.10, "invalid")]
    rows = [(100 * rho, 100.0, 100.0 * eps) for rho, eps, _, _ in cases] + [(0.0, 0.0, 0.0), (10.0, 0.0, 1.0), (100.0, 80.0, 0.0), (None, 80.0, 0.0)]
    out = rules.quality_label(rules.geometry(spark.createDataFrame(rows, "pupil_r double, iris_r double, dx double").coalesce(1))).collect()
    assert [(pytest.approx(r["score"]), r["quality"]) for r in out[:7]] == [(s, q) for _, _, s, q in cases]
    assert [(r["score"], r["quality"], r["reasons"]) for r in out[7:]] == [(0.0, "invalid", ["radii"])] * 4
    assert out[5]["reasons"] == ["offset"] and out[0]["reasons"] == []


def test_blocks_that_agree_have_no_finite_f(spark):
    rows = [(b, f"c{c:02}", -float(c)) for b in range(5) for c in range(12)]
    ranks = comparison.average_ranks(spark.createDataFrame(rows, "block int, config string, acc double"), "config", ["block"], "acc")
    r = comparison.friedman(ranks).first()
    assert r["f"] == math.inf and r["p_f"] == 0 and r["k"] == 12
    assert r["cd"] == pytest.approx(3.2680 * math.sqrt(12 * 13 / 30), abs=2e-3)  # the table's value for twelve
    assert dist.range_quantile(0.95, 10) / math.sqrt(2) == pytest.approx(comparison.NEMENYI_Q[-1], abs=1e-3)
    assert dist.f_sf(4.94, 7, 98) == pytest.approx(7.6e-5, rel=0.1) and dist.f_sf(1.0, 5, 5) == pytest.approx(0.5)


def test_runs_of_ranks_within_reach(spark):
    ranks = spark.createDataFrame([("a", 1.0), ("b", 1.4), ("c", 1.9), ("d", 3.0), ("e", 3.5), ("f", 9.0)], "config string, rank double")
    got = {(r["first"], r["last"], r["members"]) for r in comparison.cliques(ranks, "config", 1.0).collect()}
    assert got == {("a", "c", 3), ("d", "e", 2)}
    assert comparison.cliques(ranks, "config", 1.2).filter("first = 'c'").first()["last"] == "d"
    assert comparison.cliques(ranks.limit(1), "config", 1.0).count() == 0


def test_one_fold_has_no_test(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("b", 0, 0.7)], "config string, fold int, acc double")
    r = comparison.paired(df, "config", "a", [], ["fold"], "acc", 0.25).first()
    assert r["diff"] == pytest.approx(0.2) and r["k"] == 1 and all(r[c] is None or math.isnan(r[c]) for c in ("t", "p", "lo", "hi"))
    rows = spark.createDataFrame([(1, "d", 0, 2.0), (2, "d", 0, 3.0)], "id int, dim string, fold int, x double")
    assert {r["z"] for r in blocks.standardised(rows, "fold", "dim", "x").collect()} == {None}


def test_bootstrap_interval_holds_the_median(spark):
    rng = random.Random(5)
    rows = [("k", i, 1.9 + rng.gauss(0, 0.3)) for i in range(24)] + [("one", 0, 2.0), ("one", 1, None)]
    got = {r["k"]: r for r in comparison.bootstrap_median(spark.createDataFrame(rows, "k string, item int, ratio double"), ["k"], "item", "ratio", 500).collect()}
    assert got["k"]["n"] == 24 and got["k"]["lo"] < got["k"]["median"] < got["k"]["hi"] < got["k"]["lo"] + 0.6
    assert (got["one"]["n"], got["one"]["lo"], got["one"]["hi"]) == (1, 2.0, 2.0)


def test_consensus_circle_passes_over_outliers(spark):
    rng = random.Random(4)
    ring = [("r", 30 + 12 * math.cos(t / 5) + rng.gauss(0, 0.1), 20 + 12 * math.sin(t / 5) + rng.gauss(0, 0.1)) for t in range(31)]
    rows = ring + [("r", rng.uniform(-50, 90), rng.uniform(-50, 90)) for _ in range(20)] + [("two", 0.0, 0.0), ("two", 1.0, 1.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0)]
    got = {r["k"]: r for r in comparison.consensus_circle(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], 200).collect()}
    assert (got["r"]["cx"], got["r"]["cy"], got["r"]["radius"]) == (pytest.approx(30, abs=0.3), pytest.approx(20, abs=0.3), pytest.approx(12, abs=0.3))
    assert 31 <= got["r"]["inliers"] <= 36
    assert got["two"]["radius"] is None and got["line"]["radius"] is None


def test_regions_that_cannot_be_fitted(spark):
    rng = random.Random(6)
    rows = [("tells", i, i % 5, i % 2 == 0, 0, (i % 2) + rng.gauss(0, 0.1)) for i in range(60)] + [("flat", i, i % 5, i % 2 == 0, 0, 1.0) for i in range(60)] + [("one class", i, i % 5, True, 0, float(i)) for i in range(10)]
    got = {r["region"]: r for r in regions.validated(spark.createDataFrame(rows, "region string, image_id int, fold int, y boolean, dim int, x double"), ["region"]).collect()}
    assert got["tells"]["acc"] == 1.0 and got["one class"]["acc"] == 0.5 and got["one class"]["n"] == 0 and got["flat"]["sens"] == 0.0


def test_equal_vectors_are_one_strip(spark):
    rows = [(i, [1.0, 2.0, 4.0, 3.0]) for i in range(300)] + [(1000, [1.0, 2.0, 4.1, 3.0]), (1001, [4.0, 1.0, 0.0, 2.0])]
    got = [(r["a"], r["b"]) for r in similar.near_pairs(spark.createDataFrame(rows, "id long, v array<double>")).collect()]
    assert got == [(0, 1000)]


def test_strips_that_correlate_below_the_threshold_are_no_candidates(spark):
    import numpy as np

    r = np.random.default_rng(12)
    v = r.standard_normal(48) + r.standard_normal((500, 48))  # correlations about 0.5
    v[400:] = v[:100] + 0.1 * r.standard_normal((100, 48))
    u = v - v.mean(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.97)) if i < j}
    assert len(near) >= 100
    rows = [(i, "w", [float(x) for x in v[i]]) for i in range(500)]
    assert {(x["a"], x["b"]) for x in similar.near_pairs(spark.createDataFrame(rows, "id long, w string, v array<double>"), within="w").collect()} == near
    unit = spark.createDataFrame([(i, 0, [float(x) for x in u[i]]) for i in range(500)], "id long, w long, v array<double>")
    met = {(x["a"], x["b"]) for x in similar.candidates(unit, 0.97).collect()}
    assert near <= met and len(met) < 3 * len(near)
    # of 256 signs, a pair at the threshold differs in 20 on average
    most = similar.most_apart(20 / 256, 256, 1e-6)
    tail = lambda n: sum(math.comb(256, i) * (20 / 256) ** i * (236 / 256) ** (256 - i) for i in range(n + 1, 257))
    assert tail(most) <= 1e-6 < tail(most - 1)


def test_vectors_are_centred_in_one_pass_and_constant_ones_take_no_part(spark, monkeypatch):
    rows = [(i, [c] * 3) for i, c in enumerate((0.1, 0.2, 0.4, 0.7, 1.1))]  # three times 0.1, 0.2 or 0.4, divided by 3, is more
    rows += [(10, [1.0, 2.0, 4.0]), (11, [3.0, 5.0, 9.0]), (12, [1.0, None, 4.0]), (13, [4.0, 2.0, 1.0]), (14, None), (15, [])]
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return shared.durable(df)

    monkeypatch.setattr(similar, "durable", kept)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = similar.near_pairs(df.select("id", F.transform("v", lambda x: x * 1).alias("v"))).collect()
    assert [(r["a"], r["b"]) for r in got] == [(10, 11)] and got[0]["r"] == pytest.approx(1)
    # a mean inside a lambda would be taken for each component
    assert "aggregate(" not in plans[0]


def test_features_are_reused_by_content_and_parameters(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 7) for i in range(50)], "id int, v int")
    calls = []

    def make():
        calls.append(1)
        return rows.groupBy("v").count()

    for df, parameters in ((rows, {"a": 1}), (rows.repartition(5), {"a": 1}), (rows, {"a": 2}), (rows.union(rows.limit(1)), {"a": 1})):
        assert store.reused(str(tmp_path), df, parameters, make).count() == 7
    assert len(calls) == 3


def test_own_folder_only_in_local_mode(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


def test_p_that_differ_in_their_last_bits_when_made_anew_keep_their_corrections(spark):
    """Means over several executors may be summed in another order each time that they are asked for."""
    anew = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.createDataFrame([(i, "f", i / 40) for i in range(1, 21)], "id int, family string, v double").withColumn("p", anew("v"))
    assert [r["q"] for r in rules.benjamini_hochberg(df, "family").orderBy("id").collect()] == [pytest.approx(0.5, abs=1e-6)] * 20
    assert None not in [r["p_holm"] for r in rules.holm(df, "family").collect()]
    ranked = prefix.mean_ranks(df, ["family"], "p", "rank").orderBy("id").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 21))


def test_predictions_are_dealt_anew_for_every_permutation(spark):
    r = random.Random(8)
    rows = [(i, r.choice("ab"), r.random() < 0.4, r.random() < 0.5 if i % 50 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, config string, y boolean, pred boolean")
    got = {(x["config"], x["seed"]): (x["n"], x["hits"]) for x in blocks.permuted_hits(df, "config", range(3, 6)).collect()}
    hashed = lambda seed, i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i)
    for c in "ab":
        for seed in range(3, 6):
            of = [x for x in rows if x[1] == c]
            pred = [x[3] for x in sorted(of, key=lambda x: hashed(seed, x[0]))]
            y = [x[2] for x in sorted(of, key=lambda x: hashed(seed + 1000, x[0]))]
            assert got[c, seed] == (sum(p is not None for p in pred), sum(p == t for p, t in zip(pred, y, strict=True) if p is not None))
    assert len(got) == 6
