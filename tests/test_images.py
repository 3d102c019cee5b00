"""Filters on images of other shapes than the queries', the digest of contents, and the audit of strips that layouts share."""

import math
import random

import numpy as np

from stripcohort.operators import audit, comparison, features, neighbourhoods
from stripcohort.sources import store


def frame(spark, images):
    rows = [(k, r, c, int(v[r, c])) for k, v in images.items() for r in range(v.shape[0]) for c in range(v.shape[1])]
    return spark.createDataFrame(rows, "image_id long, row int, col int, value int")


def back(df, shape, column="value"):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], np.full(shape, np.nan))[r["row"], r["col"]] = r[column]
    return out


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w))


def plain_equalised(v, clip=2.0, tiles=8):
    h, w = v.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(v, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")
    most, luts = max(1, int(clip * th * tw / 256)), {}
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + excess // 256
            rest = excess % 256
            if rest:
                step, k = max(256 // rest, 1), 0
                while rest and k < 256:
                    n[k] += 1
                    k, rest = k + step, rest - 1
            luts[i, j] = np.rint(np.cumsum(n) * (255 / (th * tw)))
    out = np.zeros_like(v)
    for r in range(h):
        for c in range(w):
            y, x = r / th - 0.5, c / tw - 0.5
            i, j = math.floor(y), math.floor(x)
            at = lambda a, b: luts[min(max(a, 0), tiles - 1), min(max(b, 0), tiles - 1)][v[r, c]]
            a, b = y - i, x - j
            out[r, c] = np.rint(round((at(i, j) * (1 - b) + at(i, j + 1) * b) * (1 - a) + (at(i + 1, j) * (1 - b) + at(i + 1, j + 1) * b) * a, 9))
    return out


def test_local_equalisation_of_images_that_tiles_do_not_divide(spark):
    images = {1: noise(19, 30), 2: noise(19, 30, 5) // 4 + 90, 3: np.full((19, 30), 7)}
    got = back(neighbourhoods.local_equalised(frame(spark, images), 19, 30), (19, 30))
    for k, v in images.items():
        assert (got[k] == plain_equalised(v)).all()


def test_oriented_kernels_and_gradients_equal_plain_sums(spark):
    images = {1: noise(24, 31), 2: np.full((24, 31), 9)}
    kernels = neighbourhoods.gabor_kernels(size=7, orientations=3)
    got = back(neighbourhoods.oriented(frame(spark, images), 24, 31, kernels), (24, 31))
    for k, v in images.items():
        wide = np.pad(v.astype(float), 3, mode="reflect")
        want = np.max([np.abs(sum(s[2 + j] * wide[3 + s[0] : 3 + s[0] + 24, 3 + s[1] : 3 + s[1] + 31] for s in kernels)) for j in range(3)], axis=0)
        assert np.allclose(got[k], want, atol=1e-8)
    assert got[2].max() < 1e-8  # kernels have no mean


def test_banks_of_kernels_make_no_row_per_weight(spark):
    image = frame(spark, {1: noise(24, 31)})
    for made in (neighbourhoods.oriented(image, 24, 31), neighbourhoods.vesselness(image, 24, 31), neighbourhoods.hats(image, 24)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "_up" not in plan and plan.count("MapInArrow") == 1
    # images of two widths in one table
    both = {1: noise(17, 22), 2: noise(17, 9, 3)}
    rows = frame(spark, {1: both[1]}).unionByName(frame(spark, {2: both[2]}))
    got = {(r["image_id"], r["row"], r["col"]): (r["closed"], r["opened"]) for r in neighbourhoods.hats(rows, 17, (3,)).collect()}
    assert len(got) == 17 * 31
    for k, v in both.items():
        alone = {(k, r["row"], r["col"]): (r["closed"], r["opened"]) for r in neighbourhoods.hats(frame(spark, {k: v}), 17, (3,)).collect()}
        assert alone.items() <= got.items() and all(c >= v[i, j] >= o for (_, i, j), (c, o) in alone.items())


def test_vesselness_finds_bright_lines_only(spark):
    v = np.full((40, 40), 60)
    v[:, 20] = 200
    flat = np.full((40, 40), 127)
    got = back(neighbourhoods.vesselness(frame(spark, {1: v, 2: flat}), 40, 40), (40, 40))
    assert got[1][:, 20].mean() > 3 * got[1][:, 5].mean() and got[1].argmax(axis=1).tolist() == [20] * 40
    assert got[2].max() < 1e-12


def test_hats_equal_plain_morphology(spark):
    v = noise(17, 22)

    def extreme(a, size, pick):
        out = np.zeros_like(a)
        for r in range(a.shape[0]):
            for c in range(a.shape[1]):
                out[r, c] = pick(a[r + d, max(0, c - x) : c + x + 1].__getattribute__("max" if pick is max else "min")() for d, x in neighbourhoods.ellipse(size) if 0 <= r + d < a.shape[0])
        return out

    for mode in ("both", "black", "top"):
        got = back(neighbourhoods.fine_structures(frame(spark, {1: v}), 17, (5, 11), mode), v.shape)[1]
        want = 0
        for size in (5, 11):
            closed, opened = extreme(extreme(v, size, max), size, min), extreme(extreme(v, size, min), size, max)
            want = want + {"both": closed - opened, "black": closed - v, "top": v - opened}[mode]
        assert (got == want).all()


def test_unrolled_ring_of_circles_without_a_common_centre(spark):
    v = np.add.outer(np.arange(60) * 2, np.arange(60))  # value = 2 y + x, which bilinear sampling keeps
    circles = spark.createDataFrame([(1, 30.0, 25.0, 7.0, 36.0, 26.5, 20.0), (9, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0)], "image_id long, inner_x double, inner_y double, inner_r double, outer_x double, outer_y double, outer_r double")
    for up in (False, True):
        got = back(neighbourhoods.unrolled(frame(spark, {1: v, 2: v}), circles, 60, 60, 11, 36, up), (11, 36))
        assert set(got) == {1}
        for s in range(11):
            for t in range(36):
                a, p = 2 * math.pi * t / 36, s / 10
                x = (1 - p) * (30 + 7 * math.cos(a)) + p * (36 + 20 * math.cos(a))
                y = (1 - p) * (25 + (-1 if up else 1) * 7 * math.sin(a)) + p * (26.5 + (-1 if up else 1) * 20 * math.sin(a))
                assert abs(got[1][s, t] - math.floor(2 * y + x + 1e-7)) < 1e-9


def test_energies_equal_those_of_filtered_images(spark):
    v = noise(12, 15)
    got = {(r["orientation"], r["frequency"]): r["energy"] for r in neighbourhoods.wave_energies(frame(spark, {1: v}), 12, 15).collect()}
    kernels = neighbourhoods.wave_kernels()
    for n, k in enumerate(kernels):
        out = sum(w * np.roll(v / 255.0, (-r, -c), (0, 1)) for (r, c), w in k.items())
        assert abs(got[n // 5, [0.1, 0.2, 0.3, 0.4, 0.5][n % 5]] - (out**2).mean()) < 1e-9


def test_small_and_empty_images(spark):
    one = frame(spark, {1: np.array([[5]])})
    assert back(neighbourhoods.smoothed(one, 1, 1), (1, 1))[1][0, 0] == 5
    assert back(neighbourhoods.local_equalised(one, 1, 1), (1, 1))[1][0, 0] == 255
    none = one.limit(0)
    for f in (neighbourhoods.smoothed, neighbourhoods.local_equalised, neighbourhoods.vesselness, neighbourhoods.oriented, neighbourhoods.binary_patterns, neighbourhoods.reduced):
        assert f(none, 8, 8).collect() == []


def test_digest_tells_contents_apart(spark):
    digest = lambda rows, schema="a int, b int": store.content_digest(spark.createDataFrame(rows, schema))
    assert digest([(None, 5), (1, 2)]) != digest([(5, None), (1, 2)])
    assert digest([(1, 2), (3, 4)]) == digest([(3, 4), (1, 2)])
    assert digest([(1, 2)]) != digest([(1, 2), (1, 2)])
    assert digest([(1, 2)]) != digest([(1, 2)], "a int, b long")
    assert digest([([None, 1],)], "a array<int>") != digest([([1, None],)], "a array<int>") != digest([([1],)], "a array<int>")


def test_features_of_moved_nulls_are_computed_anew(spark, tmp_path):
    for rows in ([(None, 5)], [(5, None)]):
        df = spark.createDataFrame(rows, "a int, b int")
        assert [tuple(r) for r in store.reused(str(tmp_path), df, {"v": 1}, lambda: df).collect()] == rows


def test_near_pairs_of_a_strip_that_another_layout_shares(spark):
    r = random.Random(2)
    x = [r.randint(20, 199) for _ in range(64)]
    y = [v + (k % 9 == 0) for k, v in enumerate(x)]
    z = [r.randint(20, 199) for _ in range(64)]
    strips = {("p", 10): x, ("p", 11): y, ("p", 12): z, ("q", 10): x, ("q", 4): z, ("q", 11): x}
    rows = [(layout, 0, i, k // 8, k % 8, v) for (layout, i), s in strips.items() for k, v in enumerate(s)]
    out = {r["layout"]: r for r in audit.cohort_audit(spark.createDataFrame(rows, "layout string, label int, image_id long, row int, col int, value int"), 8).collect()}
    assert (out["p"]["near_pairs"], out["p"]["groups"], out["p"]["removed"]) == (1, 2, 0)
    assert (out["q"]["near_pairs"], out["q"]["groups"], out["q"]["removed"]) == (0, 2, 1)


def test_wins_count_significant_tests(spark):
    rows = [(c, f, k, 0.7 + 0.01 * (k % 3) + (0.2 if c == "up" else -0.2 if c == "down" else 0.0) + 0.001 * (k % 2) * (c != "base")) for c in ("base", "up", "down") for f in ("x", "y") for k in range(10)]
    df = spark.createDataFrame(rows, "config string, clf string, fold int, acc double")
    got = {r["config"]: (r["wins"], r["up"], r["down"]) for r in comparison.wins(df, "config", "base", ["clf", "fold"], "acc", ["clf"]).collect()}
    assert got == {"up": (20, 2, 0), "down": (0, 0, 2)}


def test_cooccurrence_holds_images_not_cells(spark):
    shapes = {1: (3, 5), 2: (6, 2)}
    image = spark.createDataFrame([(k, r, c, int(v)) for k, (h, w) in shapes.items() for (r, c), v in np.ndenumerate(noise(h, w, k) // 80 * 80)], "image_id long, row int, col int, value int")
    out = features.cooccurrence(image)
    # one aggregation, which gathers an image: none by cells, whose number is that of pairs
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    got = {(r["image_id"], r["distance"], r["angle"]): (r["contrast"], r["homogeneity"], r["asm"]) for r in out.collect()}
    want = {}
    for k, (h, w) in shapes.items():
        v = noise(h, w, k) // 80 * 80 // 4
        for distance, angle, dr, dc in features.OFFSETS:
            m = np.zeros((64, 64))
            for r in range(h - dr):
                for c in range(max(0, -dc), min(w, w - dc)):
                    m[v[r, c], v[r + dr, c + dc]] += 1
            if m.sum():
                m = (m + m.T) / (2 * m.sum())
                gap = np.subtract.outer(np.arange(64), np.arange(64)) ** 2
                want[k, distance, angle] = ((m * gap).sum(), (m / (1 + gap)).sum(), (m * m).sum())
    assert set(got) == set(want) and all(np.allclose(got[x], want[x]) for x in want)


def test_mask_overlap_shuffles_pixels_before_they_are_perturbed(spark):
    from stripcohort.jobs import imaging

    plan = imaging.m11_mask_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    dealt = [line for line in plan.toString().split("\n") if "Exchange hashpartitioning" in line]
    assert dealt and all("hashpartitioning(image_id" in line and "kind" not in line for line in dealt)
