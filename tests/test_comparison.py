"""Distribution helpers, ranks and geometry against known values."""

import math

import pytest

from stripcohort.operators import comparison, dist


def test_distributions():
    assert dist.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, abs=1e-9)
    assert dist.t_quantile(0.975, 49) == pytest.approx(2.0095752371292397, abs=1e-9)
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074039, abs=1e-10)
    assert dist.t_two_sided(0.0, 3) == pytest.approx(1.0)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_sf(14.067140449340169, 7) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert dist.normal_cdf(1.959963984540054) == pytest.approx(0.975)


def test_paired_without_variance(spark):
    rows = [("a", f, 0.5) for f in range(5)] + [("b", f, 0.75) for f in range(5)] + [("c", f, 0.5) for f in range(5)]
    out = comparison.paired(spark.createDataFrame(rows, "rep string, fold int, acc double"), "rep", "a", [], ["fold"], "acc", 0.25)
    got = {r["rep"]: (r["t"], r["p"]) for r in out.collect()}
    assert got == {"b": (math.inf, 0.0), "c": (0.0, 1.0)}


def test_first_configuration_ranks_first(spark):
    rows = [(b, c, v) for b in range(4) for c, v in (("x", 0.9), ("y", 0.5), ("z", 0.5))]
    ranks = comparison.average_ranks(spark.createDataFrame(rows, "block int, config string, acc double"), "config", ["block"], "acc")
    assert {r["config"]: r["rank"] for r in ranks.collect()} == {"x": 1.0, "y": 2.5, "z": 2.5}


def test_single_value_has_no_interval(spark):
    row = comparison.interval(spark.createDataFrame([("a", 0.5), ("a", None)], "name string, v double"), ["name"], "v").first()
    assert row["mean"] == 0.5 and row["k"] == 1 and (row["lo"] is None or math.isnan(row["lo"]))


def test_circle_and_ring(spark):
    points = [("a", 3 + 5 * math.cos(t), -2 + 5 * math.sin(t)) for t in (0.1, 1.0, 2.5, 4.0, 5.5)] + [("line", float(i), float(i)) for i in range(4)]
    got = {r["k"]: (r["cx"], r["cy"], r["radius"]) for r in comparison.circle_fit(spark.createDataFrame(points, "k string, x double, y double"), ["k"]).collect()}
    assert got["a"] == pytest.approx((3, -2, 5)) and got["line"] == (None, None, None)
    pupil, iris = (300.0, 250.0, 70.0), (360.0, 265.0, 200.0)
    want = [(i / 20, j * 0.6) for i in range(1, 20) for j in range(10)]
    at = [(s, t, 300 + s * 60 + (70 + s * 130) * math.cos(t), 250 + s * 15 + (70 + s * 130) * math.sin(t)) for s, t in want]
    df = spark.createDataFrame([(s, t, x, y) for s, t, x, y in at], "s0 double, t0 double, x double, y double")
    for r in comparison.ring_coordinates(df, pupil, iris).collect():
        assert (r["s"], r["theta"]) == pytest.approx((r["s0"], r["t0"]), abs=1e-9)
    assert comparison.ring_coordinates(spark.createDataFrame([(300.0, 250.0)], "x double, y double"), pupil, iris).first()["s"] == -1
