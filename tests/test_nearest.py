"""Nearest items, patch distances and member pairs against brute force, with rows of all kinds."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions import vectors as V
from tessel.operators import diagnostics, knn, pairs

MODELS = "image_id long, model string, vec array<double>"


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "image_id long")


def test_null_vectors_ties_and_unknown_query_items(spark):
    rows = [(1, "clip", [1.0, 0.0]), (2, "clip", [0.0, 1.0]), (3, "clip", [0.0, 1.0]), (4, "clip", None), (5, "clip", [1.0, 0.0])]
    m = spark.createDataFrame(rows, MODELS)
    got = [(r.image_id, round(r.distance, 9), r.group_id) for r in knn.nearest(m, ids(spark, 1, 1, 4, 99), {"clip": 1.0}).collect()]
    assert got == [(5, 0.0, None), (2, 1.0, None), (3, 1.0, None)]
    with pytest.raises(ValueError):
        knn.nearest(m, ids(spark, 4, 99), {"clip": 1.0})
    with pytest.raises(ValueError):
        knn.nearest(m, ids(spark, 1), {"clip": 1.0}, aggregation="max")
    with pytest.raises(ValueError):
        knn.nearest(spark.createDataFrame([], MODELS), ids(spark, 1), {"clip": 1.0})


@pytest.mark.parametrize("how", ["centroid", "min"])
def test_patch_distances_equal_brute_force(spark, monkeypatch, how):
    monkeypatch.setattr(knn, "PATCH_PRODUCTS", 40)  # one item at a time
    x = np.random.default_rng(1).normal(size=(9, 4, 3))
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    patches = spark.createDataFrame([(i, x[i].tolist()) for i in range(9)], "image_id long, patches array<array<double>>")
    got = {r.image_id: r.d for r in knn.patch_query_distances(patches, [2, 5, 77], how).collect()}

    def distance(i, j):
        s = x[i] @ x[j].T
        return 0.0 if i == j else max(0.0, 1 - (s.max(0).sum() + s.max(1).sum()) / 8)

    for i in range(9):
        own = [distance(i, q) for q in (2, 5)]
        assert got[i] == pytest.approx(np.mean(own) if how == "centroid" else min(own))
    assert not knn.patch_query_distances(patches, [77], how).collect()


@pytest.mark.parametrize("block", [3, 100])
def test_member_pairs_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    vec = {i: rng.normal(size=3).tolist() for i in range(8)} | {3: [0.0, 0.0, 0.0]}
    held = [("b", 0, [0, 1, 2]), ("a", 1, [3, 4, 5]), ("c", 2, [6, 0, 7])]  # item 0 is in two groups
    rows = [(g, gp, at, i, vec[i], vec[i][:2]) for g, gp, own in held for at, i in enumerate(own)]
    m = spark.createDataFrame(rows, "group_id string, group_pos long, member_pos long, image_id long, vec array<double>, color array<double>")

    def distance(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return max(0.0, 1 - (np.dot(a, b) / size if size > 1e-20 else 0.0))

    cols = ["ga", "gb", "ma", "mb", "ia", "ib"]
    for within in (False, True):
        use = [(p, q) for p in rows for q in rows if (p[0] == q[0] and p[3] < q[3] if within else p[1] < q[1])]
        want = sorted((p[0], q[0], p[2], q[2], p[3], q[3], round(distance(p[4], q[4]), 9), round(distance(p[5], q[5]), 9)) for p, q in use)
        pairs = diagnostics.member_pairs(m, within, block)
        got = sorted((*(r[c] for c in cols), round(r.sd, 9), round(r.cd, 9)) for r in pairs.collect())
        assert got == want
    turned = diagnostics.both_ways(diagnostics.member_pairs(m, block=block))
    assert turned.count() == 2 * turned.where("gpa < gpb").count() == 2 * turned.where("gpa > gpb").count()
    assert not diagnostics.member_pairs(m.where(F.lit(False))).collect()
    assert {r.group_id: r.threshold for r in diagnostics.inner_median(m.where("member_pos = 0")).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_rounding_keeps_the_sign_of_zero(spark):
    x = [-8.9e-8, 4.3e-7, -0.5e-6, -0.0, 0.0, -1.5, 0.1234565, None]
    rows = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r.x for r in rows.select(V.rounded(F.col("x"), 6).alias("x")).collect()]
    want = [-0.0, 0.0, -1e-6, 0.0, 0.0, -1.5, 0.123457]
    assert got[-1] is None and got[:-1] == want
    assert [np.signbit(v) for v in got[:-1]] == [True, False, True, True, False, True, False]


@pytest.mark.parametrize("block", [4, 24, 200])
def test_reduced_diagnostics_equal_brute_force(spark, monkeypatch, block):
    """Groups of all sizes, with copies of vectors across and within groups; none of the pairs may be written."""
    monkeypatch.setattr(diagnostics, "CELLS", 20)
    monkeypatch.setattr(diagnostics, "member_pairs", None)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 3)).tolist()
    rows = [(g, gp, at, 100 * gp + at, base[int(rng.integers(20))]) for gp, (g, n) in enumerate([("d", 11), ("a", 5), ("c", 1), ("b", 8), ("e", 2)]) for at in range(n)]
    m = spark.createDataFrame([(*r, r[4][:2]) for r in rows], "group_id string, group_pos long, member_pos long, image_id long, vec array<double>, color array<double>")
    x = np.array([r[4] for r in rows])
    part = lambda v: np.maximum(0.0, 1 - np.einsum("ij,kj->ik", v, v) / (np.sqrt((v * v).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]))
    sd, cd = part(x), part(x[:, :2])
    n, of = len(rows), {}
    for i in range(n):
        of.setdefault(rows[i][0], []).append(i)
    order = list(of)
    at = lambda v, share: sorted(v)[min(len(v) - 1, int(len(v) * share))]
    cross = {(g, h): [sd[i, j] for i in of[g] for j in of[h]] for k, g in enumerate(order) for h in order[k + 1 :]}
    inner = {g: [sd[i, j] for i in of[g] for j in of[g] if i < j] for g in order}
    got = {(r.ga, r.gb): (r.lo, r.hi, r.n) for r in diagnostics.ranks(m, {"lo": 0.1, "hi": 0.75}, block=block, buckets=4, small=3).collect()}
    assert got == {k: (at(v, 0.1), at(v, 0.75), len(v)) for k, v in cross.items()}
    got = {r.ga: r.mid for r in diagnostics.ranks(m, {"mid": 0.5}, within=True, block=block, buckets=4, small=3).collect()}
    assert got == {g: at(v, 0.5) for g, v in inner.items() if v}
    t = {g: at(v, 0.5) if v else 0.0 for g, v in inner.items()}
    got = {(r.group_a, r.group_b): (r.threshold, r.overlap) for r in diagnostics.overlap(m, block).collect()}
    assert got == {(g, h): (t[g], np.mean([sd[i, j] < t[g] for i in of[g] for j in of[h]])) for g in order for h in order if g != h}
    near = [min((sd[i, j], rows[j][1], rows[j][2], rows[j][0]) for j in range(n) if rows[j][0] != rows[i][0])[3] for i in range(n)]
    got = {(r.group_a, r.group_b): r.fraction for r in diagnostics.nearest_fraction(m, block).collect()}
    assert got == {(g, h): k / len(of[g]) for g in order for h in order if (k := sum(near[i] == h for i in of[g]))}
    got = {(r.group_a, r.group_b, r.image_id): (r.color_d, r.semantic_d) for r in diagnostics.multiplicative(m, block).collect()}
    best = lambda i, h: min((cd[i, j] * sd[i, j], rows[j][2], cd[i, j], sd[i, j]) for j in of[h])[2:]
    assert got == {(rows[i][0], h, rows[i][3]): best(i, h) for i in range(n) for h in order if h != rows[i][0]}
    got = {(r.group_a, r.group_b, r.threshold): (r.fraction_ab, r.fraction_ba) for r in diagnostics.color_gate(m, [0.1, 0.5], block).collect()}
    share = lambda g, h, x: np.mean([min(cd[i, j] for j in of[h]) < x for i in of[g]])
    assert got == {(g, h, x): (share(g, h, x), share(h, g, x)) for g in order for h in order if g < h for x in (0.1, 0.5)}


def test_patch_scores_hold_no_product_of_all_patches(monkeypatch):
    """The dot products of all patches at once were patches squared times as many numbers as the scores."""
    monkeypatch.setattr(pairs, "PORTION", 12)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(9, 4, 3)), rng.normal(size=(7, 5, 3))
    dots = np.einsum("npd,mqd->npmq", a, b)
    assert np.allclose(pairs.patch_score_matrix(a, b), (dots.max(axis=3).sum(axis=1) + dots.max(axis=1).sum(axis=2)) / 9)
    monkeypatch.undo()
    x = rng.normal(size=(400, 8, 8))
    tracemalloc.start()
    pairs.patch_score_matrix(x, x)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
