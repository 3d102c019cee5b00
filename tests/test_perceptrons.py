"""Perceptrons of all folds in one batch against a plain loop, and the jobs and partitions that fits take."""

import math

import numpy as np
import pytest

from stripcohort.operators import learners, perceptrons


def planted(n=240, seed=4):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no line parts them
    x[:, 3] = 2.0  # constant
    return x, y


def frame(spark, x, y, k=3):
    return spark.createDataFrame([(i, bool(y[i]), [float(v) for v in x[i]], i % k) for i in range(len(y))], "id long, y boolean, x array<double>, fold int")


def plain(x, y, hidden, steps):
    """w and the standardised features' mean and deviation, by the same descent on whole arrays."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), 0)
    sizes, r = [x.shape[1], *hidden, 2], np.random.default_rng(42)
    w = np.concatenate([r.uniform(-2.4, 2.4, a * b + b) / a for a, b in zip(sizes, sizes[1:])])
    fit = perceptrons.descent(w, steps)
    at = next(fit)
    try:
        while True:
            got = perceptrons.loss_and_gradient(at, sizes, z, y) / len(y)
            at = fit.send((got[0], got[1:]))
    except StopIteration as end:
        return end.value, mean, sd, sizes


def test_perceptrons_in_a_batch_equal_a_fit_each(spark):
    x, y = planted()
    rows = frame(spark, x, y)
    odd = spark.createDataFrame([(900, None, [9.0] * 4, 0), (901, True, None, 0), (902, True, [None, 1.0, 1.0, 1.0], 1)], rows.schema)
    found = {r["id"]: r for r in perceptrons.cross_validated(rows.union(odd), k=3, hidden=(6, 4), steps=8).collect()}
    assert set(found) == {*range(len(y)), 900}  # one without features has no score
    for f in range(3):
        on = np.arange(len(y)) % 3 != f
        w, mean, sd, sizes = plain(x[on], y[on], (6, 4), 8)
        z = np.where(sd > 0, (x[~on] - mean) / np.where(sd > 0, sd, 1), 0)
        want = perceptrons._forward(w, sizes, z)[-1][:, 1]
        assert np.allclose([found[i]["score"] for i in np.flatnonzero(~on)], want, atol=1e-6)
    assert all(r["fold"] == i % 3 and r["pred"] == (r["score"] > 0.5) for i, r in found.items() if i < 900)


def test_perceptrons_learn_what_no_line_parts(spark):
    x, y = planted(600)
    found = perceptrons.cross_validated(frame(spark, x, y), k=3, hidden=(12, 6)).collect()
    assert len(found) == 600 and np.mean([r["pred"] == r["y"] for r in found]) > 0.85
    # a training part of one class has no model
    one = frame(spark, x, np.arange(600) % 3 == 0)
    assert {r["fold"] for r in perceptrons.cross_validated(one, k=3, hidden=(2,), steps=1).collect()} == {1, 2}


def test_gradient_and_descent():
    r = np.random.default_rng(2)
    z, y, sizes = r.standard_normal((30, 3)), r.integers(0, 2, 30), [3, 4, 2]
    w = r.standard_normal(3 * 4 + 4 + 4 * 2 + 2)
    got = perceptrons.loss_and_gradient(w, sizes, z, y)
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        slope = (perceptrons.loss_and_gradient(w + e, sizes, z, y)[0] - perceptrons.loss_and_gradient(w - e, sizes, z, y)[0]) / 2e-6
        assert got[1 + i] == pytest.approx(slope, abs=1e-5)
    # Rosenbrock's valley is long and flat
    fit = perceptrons.descent(np.array([-1.2, 1.0]), 200, 1e-12)
    at = next(fit)
    try:
        while True:
            a, b = at
            at = fit.send(((1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])))
    except StopIteration as end:
        assert np.allclose(end.value, [1, 1], atol=1e-4)


def test_an_evaluation_of_all_folds_is_one_job(spark):
    x, y = planted()
    context = spark.sparkContext
    jobs = {}
    for k in (2, 6):
        context.setJobGroup(f"folds {k}", "")
        perceptrons.cross_validated(frame(spark, x, y, k), k=k, hidden=(3,), steps=1)
        jobs[k] = len(context.statusTracker().getJobIdsForGroup(f"folds {k}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[6] <= jobs[2] + 20  # not three times as many


def test_partitions_of_a_fit_do_not_grow_with_the_rows(spark):
    kept = learners.held(spark.range(50_000), per_part=100)
    assert kept.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    kept.unpersist()
    few = learners.held(spark.range(2_000))
    assert few.rdd.getNumPartitions() == 1
    few.unpersist()


def test_scores_are_probabilities_of_huge_features(spark):
    x, y = planted(60)
    found = perceptrons.cross_validated(frame(spark, x * 1e150, y), k=3, hidden=(3,), steps=2).collect()
    assert len(found) == 60 and all(math.isfinite(r["score"]) and 0 <= r["score"] <= 1 for r in found)
