"""Batched logistic models and boosted stumps against plain loops."""

import math

import numpy as np

from stripcohort.operators import small_models


def plain_logistic(x, y, c=1.0):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), 0)
    z = np.hstack([np.ones((len(z), 1)), z])
    w, ridge = np.zeros(z.shape[1]), np.diag([0, *[1 / c] * x.shape[1]])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return w


def data(n=160, seed=1):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    x = r.standard_normal((n, 4)) + y[:, None] * np.array([0.9, 0.0, -0.5, 0.0])
    x[:, 3] = 2.0  # constant
    return x, y


def frame(spark, sets):
    rows = [(c, i, bool(y[i]), [float(v) for v in x[i]], i % 3) for c, (x, y) in sets.items() for i in range(len(y))]
    return spark.createDataFrame(rows, "config string, id long, y boolean, x array<double>, fold int")


def test_batched_newton_equals_a_fit_each(spark):
    sets = {"a": data(), "b": data(90, 2), "wide": (np.hstack([data(90, 3)[0]] * 2), data(90, 3)[1])}
    rows = frame(spark, sets)
    train = small_models.training_rows(rows, ["config"], "fold", 3)
    got = {(r["config"], r["fold"]): r["w"] for r in small_models.logistic(train, ["config", "fold"]).collect()}
    assert len(got) == 9
    for c, (x, y) in sets.items():
        for f in range(3):
            on = np.arange(len(y)) % 3 != f
            assert np.allclose(got[c, f], plain_logistic(x[on], y[on]), atol=1e-6)
    # scores of the held-out fold
    found = small_models.cross_validated(rows, ["config"], k=3).filter("config = 'a'").collect()
    x, y = sets["a"]
    assert len(found) == len(y)
    for r in found[:20]:
        on = np.arange(len(y)) % 3 != r["fold"]
        w, z = plain_logistic(x[on], y[on]), (x[r["id"]] - x[on].mean(axis=0)) / np.where(x[on].std(axis=0) > 0, x[on].std(axis=0), np.inf)
        assert abs(r["score"] - 1 / (1 + math.exp(-(w[0] + z @ w[1:])))) < 1e-6


def test_a_row_that_trains_many_models_is_held_once(spark):
    x, y = data(120, 7)
    rows = frame(spark, {"a": (x, y)})
    plain = small_models.logistic(small_models.training_rows(rows, ["config"], "fold", 3), ["config", "fold"])
    once = small_models.logistic(rows.withColumn("of", small_models.members(["config"], "fold", 3)), ["config", "fold"], of="of")
    assert plain.schema == once.schema
    got, want = ({(r["config"], r["fold"]): r for r in df.collect()} for df in (once, plain))
    assert set(got) == set(want) == {("a", f) for f in range(3)}
    for k in got:
        on = np.arange(len(y)) % 3 != k[1]
        assert all(np.allclose(got[k][n], want[k][n], atol=1e-9) for n in ("mean", "spread", "w"))
        assert np.allclose(got[k]["mean"], x[on].mean(axis=0)) and np.allclose(got[k]["spread"], x[on].std(axis=0)) and got[k]["spread"][3] == 0
        assert np.allclose(got[k]["w"], plain_logistic(x[on], y[on]), atol=1e-6)


def test_rows_with_nulls_and_keys_of_one_class(spark):
    rows = [("one", True, [1.0]), ("one", True, [2.0]), ("two", True, [1.0]), ("two", False, [0.0]), ("two", None, [5.0]), ("two", True, None), ("two", False, [None])]
    train = spark.createDataFrame(rows, "config string, y boolean, x array<double>")
    assert [r["config"] for r in small_models.logistic(train, ["config"]).collect()] == ["two"]
    assert small_models.logistic(train.limit(0), ["config"]).collect() == []


def plain_stumps(x, y, rounds):
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for i in range(x.shape[1]):
            values = sorted(set(x[:, i]))
            for a, b in zip(values, values[1:]):
                for s in (1, 0):
                    wrong = ((x[:, i] > (a + b) / 2) == (s == 1)) != (y == 1)
                    e = round(w[wrong].sum() / w.sum(), 12)
                    if best is None or (e, i, a, -s) < best[0]:
                        best = (e, i, a, -s), (i, (a + b) / 2, s), wrong
        if best is None:
            return out
        e = best[0][0]
        if e <= 1e-12:
            return [*out, (*best[1], 1.0)]
        if e >= 0.5:
            return out
        out.append((*best[1], math.log((1 - e) / e)))
        w = w * np.exp(out[-1][3] * best[2])
    return out


def test_boosted_stumps_equal_plain_loops(spark):
    x, y = data(80, 5)
    x = np.round(x, 1)
    clear = np.arange(20.0).reshape(-1, 1)
    sets = {"a": (x, y), "clear": (clear, (clear[:, 0] > 7).astype(int)), "flat": (np.ones((6, 1)), np.array([0, 1, 0, 1, 0, 1]))}
    rows = frame(spark, {k: (np.hstack([v[0], np.zeros((len(v[0]), 4 - v[0].shape[1]))]), v[1]) for k, v in sets.items()})
    got = small_models.boosted(rows, ["config"], rounds=8)
    for k, (x, y) in sets.items():
        want = plain_stumps(x, y, 8)
        mine = got[k,]
        assert [(i, s) for i, _, s, _ in mine] == [(i, s) for i, _, s, _ in want] and np.allclose([w for *_, w in mine], [w for *_, w in want])
        if k == "a":
            # thresholds lie between values of all keys, so they part a key's rows alike
            assert all(((x[:, i] > c) == (x[:, i] > d)).all() for (i, c, _, _), (_, d, _, _) in zip(mine, want))
    scored = small_models.boosted_scores(got, rows, ["config"], ["id", "y"])
    assert scored.filter("config = 'clear' and pred <> y").count() == 0 and scored.filter("config = 'flat'").count() == 0


def test_fusion_follows_the_block_with_the_signal(spark):
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 160)
    rows = [(i, bool(y[i]), [float(v) for v in r.standard_normal(3)], [float(y[i] + r.standard_normal() * 0.4)], i % 4) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, y boolean, texture array<double>, geometry array<double>, fold int")
    found = small_models.stacked(df, ["texture", "geometry"], k=4, inner=3).collect()
    acc = {m: np.mean([r["pred"] == r["y"] for r in found if r["model"] == m]) for m in ("texture", "geometry", "fusion")}
    assert all(sum(r["model"] == m for r in found) == 160 for m in acc)
    assert acc["fusion"] > 0.8 and acc["texture"] < 0.65
