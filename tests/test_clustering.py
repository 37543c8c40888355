"""Linkages against a plain form of Ward's rule, and cuts on hand-made trees."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.operators import cuts, linkage, reciprocal
from tessel.plans import catalog


def plain_ward(d, groups):
    """All pairs are searched at every step; the nearest merge."""
    n = len(d)
    d = {(i, j): d[i][j] for i in range(n) for j in range(n) if i < j}
    size, out = dict.fromkeys(range(n), 1), []

    def merge(a, b, gap, phase):
        for i in list(size):
            if i not in (a, b):
                ia, ib = tuple(sorted((i, a))), tuple(sorted((i, b)))
                s = size[i] + size[a] + size[b]
                d[ib] = max(0.0, ((size[i] + size[a]) * d[ia] ** 2 + (size[i] + size[b]) * d[ib] ** 2 - size[i] * gap**2) / s) ** 0.5
        size[b] += size.pop(a)
        out.append((phase, a, b, gap, size[b]))

    for g in groups:
        for a in sorted(g)[:-1]:
            merge(a, max(g), d[a, max(g)], 0)
    for x in groups:
        for y in groups:
            if max(x) < max(y):
                d[max(x), max(y)] = 1e18
    while len(size) > 1:
        gap, a, b = min((d[i, j], i, j) for i in size for j in size if i < j)
        merge(a, b, gap, 1)
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 14), st.integers(0, 10**6))
def test_ward_equals_the_plain_rule(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    groups = [[0, n - 1], [1, 2, 3]] if n >= 8 else []
    for k, g in enumerate(groups):  # members are near each other: a distance that is stopped at 0 isn't Ward's, and chains may take another order then
        x[g] = np.eye(5)[k] + 0.1 * x[g]
    d = linkage.cosine_matrix(x)
    got, want = linkage.ward(d, groups), plain_ward(d, groups)
    assert [s[:3] + s[4:] for s in got if s[0] == 0] == [s[:3] + s[4:] for s in want if s[0] == 0]
    finite = [round(s[3], 9) for s in want if s[3] < 1e10]
    assert np.allclose(sorted(s[3] for s in got if s[3] < 1e10), sorted(finite))
    steps = frame([(s[0], s[1], s[2], s[3], s[4]) for s in got])
    for k in range(1, n + 1):
        a = cuts.cut_count(n, steps, k, len(groups))
        assert len(set(a)) == max(k, len(groups)) or k > n - sum(len(g) - 1 for g in groups)
        assert all(len({a[i] for i in g}) == 1 for g in groups) and len({a[g[0]] for g in groups}) == len(groups)


def frame(steps):
    return pd.DataFrame([(i, p, a, b, np.float32(d), n) for i, (p, a, b, d, n) in enumerate(steps)], columns=["step", "phase", "a", "b", "distance", "new_size"])


def chain(*merges):
    """(a, b, distance) to main steps."""
    return frame([(1, a, b, d, 0) for a, b, d in merges])


def test_cuts_by_distance_stop_at_the_first_step_that_reaches_it():
    s = chain((0, 1, 0.2), (2, 3, 0.5), (1, 3, 0.9))
    assert cuts.cut_distance(4, s, 0.5) == [0, 0, 1, 2]
    assert cuts.cut_distance(4, s, 9) == [0, 0, 0, 0]
    assert cuts.cut_distance(4, s, 0) == [0, 1, 2, 3]


def test_adaptive_cut_keeps_clusters_that_persist():
    s = chain((0, 1, 0.1), (1, 2, 0.12), (3, 4, 0.1), (4, 5, 0.12), (2, 5, 2.0))
    assert cuts.cut_adaptive(6, s, 3, 0) == [0, 0, 0, 1, 1, 1]


def plain_adaptive(n, merges, least):
    """The rule on sets of items: clusters as rows, looked up by the set that holds them."""
    sets, holder = {i: frozenset([i]) for i in range(n)}, {}
    rows = []  # birth, death, size, parent, children
    first = [-1] * n
    top = {i: i for i in range(n)}

    def under(child, parent, d):
        rows[child][1], rows[child][3] = d, parent
        rows[parent][4].append(child)

    for a, b, d in merges:
        if d >= 1e10:
            break
        x, y = sets[a], sets[b]
        z = x | y
        cx, cy = holder.get(x), holder.get(y)
        if len(x) >= least and len(y) >= least or (len(z) >= least and cy is None):
            rows.append([d, float("inf"), len(z), -1, []])
            new = len(rows) - 1
            for c in (cx, cy):
                if c is not None:
                    under(c, new, d)
            if not (len(x) >= least and len(y) >= least):
                first = [new if i in z and first[i] == -1 else first[i] for i in range(n)]
            holder[z] = new
        elif cy is not None:
            holder[z] = cy
        for i in z:
            sets[i] = z
    first = [holder.get(sets[i], -1) if f == -1 else f for i, f in enumerate(first)]
    if not rows:
        return None

    def best(c):
        birth, death, size, _, kids = rows[c]
        own = size * max(0.0, (1 / birth if birth > 0 else 0) - (1 / death if 0 < death < float("inf") else 0))
        down = [best(k) for k in kids]
        total = sum(v for v, _ in down)
        return (own, {c}) if own > total or not kids else (total, set().union(*(s for _, s in down)))

    chosen = set().union(*(best(c)[1] for c in range(len(rows)) if rows[c][3] == -1))
    labels = []
    for c in first:
        while c >= 0 and c not in chosen:
            c = rows[c][3]
        labels.append(c)
    sets = {i: [i] for i in range(n)}
    for a, b, d in merges:
        if d >= 1e10:
            break
        x, y = sets[a], sets[b]
        la, lb = (next((labels[i] for i in s if labels[i] >= 0), -1) for s in (x, y))
        for i in x + y:
            if labels[i] < 0:
                labels[i] = max(la, lb) if min(la, lb) < 0 else labels[i]
        for i in (z := y + x):
            sets[i] = z
    return [("c", labels[i]) if labels[i] >= 0 else ("o", min(sets[i])) for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 30), st.integers(1, 6), st.integers(0, 10**6))
def test_adaptive_cut_equals_the_plain_rule(n, least, seed):
    rng = np.random.default_rng(seed)
    open_, merges, d = list(range(n)), [], 0.0
    for _ in range(n - 1):
        a, b = rng.choice(len(open_), 2, replace=False)
        d += float(rng.choice([0, 0.125, 0.5, 2]))
        merges.append((open_[a], open_[b], d if rng.random() < 0.95 else 1e18))
        open_.pop(a)
    s = chain(*merges) if merges else frame([])
    want = plain_adaptive(n, [(a, b, float(np.float32(d))) for a, b, d in merges], least)
    got = cuts.cut_adaptive(n, s, least, 0)
    if want is None:
        assert got == cuts.cut_count(n, s, max(50, n // 30), 0)
    else:
        assert [want.index(w) for w in want] == [got.index(g) for g in got]


def test_a_small_side_is_treated_by_which_side_keeps_its_number():
    keeps = chain((0, 1, 0.1), (1, 2, 0.1), (3, 2, 0.5))  # the small one (3) goes: the cluster lives on
    assert cuts._persistent(cuts._Tree.of(4, keeps), 3).tolist() == [1, 1, 1, 1]
    goes = chain((0, 1, 0.1), (1, 2, 0.1), (2, 3, 0.5))  # the large one goes: a new cluster over it, in which it is worth more
    assert cuts._persistent(cuts._Tree.of(4, goes), 3).tolist() == [1, 1, 1, -1]


def test_without_persistent_clusters_the_count_decides():
    s = chain(*((i, i + 1, 0.1 * (i + 1)) for i in range(59)))
    assert len(set(cuts.cut_adaptive(60, s, 1000, 0))) == 50


def test_orphans_take_the_label_they_meet_first():
    s = chain((0, 1, 0.1), (2, 3, 0.1), (4, 1, 0.4), (5, 3, 0.5), (1, 3, 1.0), (6, 3, 1e18))
    assert cuts._with_orphans(cuts._Tree.of(7, s), [0, 0, 1, 1, -1, -1, -1]) == [0, 0, 1, 1, 0, 1, 2]


def test_given_distances_of_too_many_items_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MOST", 3)
    items = spark.createDataFrame([("r", i, None) for i in range(5)], "run_id string, idx int, group_pos long")
    pairs = spark.createDataFrame([("r", i, j, 1.0) for i in range(5) for j in range(i + 1, 5)], "run_id string, i long, j long, d double")
    with pytest.raises(Exception, match="at most 3"):
        linkage.linkages_of_pairs(items, pairs).collect()


def test_zero_vectors_are_at_distance_one():
    assert linkage.cosine_matrix(np.array([[0.0, 0.0], [1.0, 0.0]]))[0, 1] == 1


def test_chains_of_splits_stand_in_one_section(spark):
    from tessel.operators import groups

    rows = [("a", 0, None, "g"), ("b", 1, "a", None), ("d", 2, None, None), ("c", 3, "b", None), ("e", 4, "f", None), ("f", 5, None, "g2"), ("h", 6, "d", None)]
    got = groups.confirmed_first(spark.createDataFrame(rows, "cluster_id string, pos long, split_from string, confirmed_group string")).orderBy("pos").collect()
    assert [r.cluster_id for r in got] == ["a", "b", "c", "f", "d", "e", "h"]


def test_a_job_guards_its_execution(spark):
    from tessel.api import Busy, Workspace

    w = Workspace(spark, None, None, None)
    told = []
    w.listeners.append(told.append)

    def make():
        assert w.running()
        w._owner = -1  # as another thread sees it
        with pytest.raises(Busy):
            w.run(lambda: spark.range(1))
        w._owner = __import__("threading").get_ident()
        return spark.range(3)

    assert len(w.run(make)) == 3 and not w.running() and told == ["run: started", "run: done"]


def _runs(spark, runs):
    rows = [(name, i, v.tolist(), g.get(i)) for name, x, g in runs for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "run_id string, idx int, vec array<double>, group_pos long")


def _equal(small, large):
    """The same steps where distances tell them apart: merges at 0 and those that are kept apart may come in another order."""
    both = [[(r.run_id, r.phase, r.a, r.b, r.new_size, round(r.distance, 5)) for r in df.orderBy("run_id", "step").collect() if r.phase == 0 or 0 < r.distance < 1e10] for df in (small, large)]
    assert both[0] == both[1]


@pytest.mark.parametrize("block", [4096, 16])
def test_rounds_of_reciprocal_neighbours_give_the_same_steps(spark, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(90, 6))
    x[1] = 0
    groups = {i: int(i % 4) for i in range(0, 40, 5)}
    for i, g in groups.items():  # members are near each other, so no distance is stopped at 0
        x[i] = np.eye(6)[g] + 0.1 * x[i]
    runs = [("grouped", x, groups), ("plain", rng.normal(size=(50, 6)), {3: 1}), ("one", x[:1], {})]
    df = _runs(spark, runs)
    small, large = linkage.linkages(df), linkage.linkages(df, most=20, block=block)
    _equal(small, large)
    for name, x_, _ in runs:
        s = large.where(f"run_id = '{name}'").toPandas().sort_values("step")
        assert s.step.tolist() == list(range(len(x_) - 1)) and len(set(s.a)) == len(s) and s.distance[s.phase == 1].is_monotonic_increasing


def test_large_clusters_are_spread_over_blocks(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(1, 5)) + rng.normal(size=(60, 5)) * 0.01, rng.normal(size=(40, 5))])
    df = _runs(spark, [("hot", x, {})])
    _equal(linkage.linkages(df), linkage.linkages(df, most=4, block=16))


def test_rounds_over_patches(spark):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(45, 3, 4))
    p /= np.linalg.norm(p, axis=2, keepdims=True)
    df = spark.createDataFrame([("p", i, v.tolist(), 1 if i in (2, 9) else None) for i, v in enumerate(p)], "run_id string, idx int, patches array<array<double>>, group_pos long")
    _equal(linkage.linkages(df), linkage.linkages(df, most=10, block=16))
    from tessel.operators import pairs

    d = pairs.patch_pairs(df.select(F.col("idx").cast("long").alias("image_id"), "patches"))
    given = linkage.linkages_of_pairs(df.select("run_id", "idx", "group_pos"), d.select(F.lit("p").alias("run_id"), "i", "j", "d"))
    _equal(given, linkage.linkages(df))


def test_more_groups_than_fit_a_task_are_kept_apart(spark):
    x = np.random.default_rng(8).normal(size=(24, 5))
    s = linkage.linkages(_runs(spark, [("g", x, {i: i // 2 for i in range(24)})]), most=8).toPandas().sort_values("step")
    assert (s.phase == 0).sum() == 12 and (s.distance >= 1e10).sum() == 11 and s.new_size.iloc[-1] == 24 and len(set(s.a)) == 23


@pytest.mark.parametrize("by_moments", [True, False])
def test_sums_of_clusters_equal_brute_force(monkeypatch, by_moments):
    """Of items by their distances or by moments, and with given groups, whose distances stop at 0 member by member."""
    monkeypatch.setattr(reciprocal, "CELLS", 50)
    monkeypatch.setattr(reciprocal._Clusters, "by_moments", lambda *_: by_moments)
    rng = np.random.default_rng(0)

    def side(n, k, groups):
        own, rank = np.sort(rng.integers(0, k, n)), np.full(n, -1)
        for c in groups:
            at = np.flatnonzero(own == c)[::2]
            rank[at] = rng.permutation(len(at))
        rows = pd.DataFrame({"own": own, "idx": range(n), "n": 1, "w": 0.0, "g": -1, "rank": rank, "gap": rng.random(n), "large": False})
        return rows.assign(vec=list(rng.normal(size=(n, 4))))

    def units(t):
        plain = [(t.own[i], [i]) for i in np.flatnonzero(t["rank"] < 0)]
        return plain + [(c, list(g.sort_values("rank").index)) for c, g in t[t["rank"] >= 0].groupby("own")]

    def brute(a, b):
        x, y = reciprocal._features(a.vec, False), reciprocal._features(b.vec, False)
        d, out = np.maximum(0, 1 - x @ y.T) ** 2, np.zeros((a.own.nunique(), b.own.nunique()))
        for c, i in units(a):
            for e, j in units(b):
                if len(i) > 1 and len(j) > 1:
                    continue
                far, t, rows = (d[i[0], j], b, j) if len(j) > 1 else (d[i, j[0]], a, i)
                now = far[0]
                for k in range(1, len(far)):
                    now = reciprocal._with_member(now, far[k], t.gap[rows[k]], k)
                out[np.searchsorted(a.own.unique(), c), np.searchsorted(b.own.unique(), e)] += now * (1 + len(far)) / 2
        return out

    a, b = side(60, 9, [1, 3]), side(40, 25, [2])
    one, other = reciprocal._Clusters(a, "vec"), reciprocal._Clusters(b, "vec")
    got = np.concatenate([one.sums(other, k, min(len(one.own), k + 4)) for k in range(0, len(one.own), 4)])
    assert np.allclose(got, brute(a, b), atol=1e-10)


def test_a_linkage_of_patches_takes_no_given_distances(spark, sf_dir, monkeypatch):
    """They stop at the items that fit a task, of which the pairs would come to one."""
    monkeypatch.setattr(linkage, "linkages_of_pairs", None)
    got = catalog.QUERIES["ward_linkage_of_patches"](spark, sf_dir)
    assert got.columns == ["run_id", "step", "phase", "a", "b", "distance", "new_size"] and got.count() == 499
