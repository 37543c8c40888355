"""Exact ranks by buckets, and sums over vectors, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import moments
from tessel.operators.selection import at_shares

SHARES = {"low": 0.0, "p10": 0.1, "p25": 0.25, "mid": 0.5, "p75": 0.75, "high": 1.0}


@pytest.mark.parametrize("falling", [False, True])
def test_ranks_equal_those_of_the_sorted_list(spark, falling):
    rng = np.random.default_rng(2)
    groups = {
        "even": rng.random(5000),
        "ties": rng.integers(0, 3, 4000).astype(float),
        "same": np.full(3000, 0.1),
        "far": np.concatenate([rng.random(3000) * 1e-9, [1e9, -1e9]]),
        "zeros": np.array([0.0, -0.0, 0.0, 1.0]),
        "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]),
        "inverse": 1 / np.arange(1, 2000),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("even", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r for r in at_shares(df, ["g"], "x", SHARES, falling, small=100, buckets=16).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        order = np.sort(v)[::-1] if falling else np.sort(v)
        assert got[g].n == len(v)
        for name, share in SHARES.items():
            assert got[g][name] == order[min(len(v) - 1, int(len(v) * share))]
    assert at_shares(df.limit(0), ["g"], "x", SHARES).count() == 0


def test_moments_and_means(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    key = [None if i % 50 == 0 else i % 7 if i % 3 else 0 for i in range(500)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(key, x)] + [(1, None)], "k int, vec array<double>").repartition(9)
    n, s, m = moments.second_moments(df)
    assert n == 500 and np.allclose(s, x.sum(axis=0)) and np.allclose(m, x.T @ x)
    got = {r.k: (np.array(r["mean"]), r.n) for r in moments.means(df, "k").collect()}
    for k in {k for k in key if k is not None}:
        own = x[[i for i, q in enumerate(key) if q == k]]
        assert got[k][1] == len(own) and np.allclose(got[k][0], own.mean(axis=0))
    assert moments.second_moments(df.limit(0))[0] == 0 and moments.means(df.limit(0), "k").count() == 0


def test_products_in_blocks(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-3, 4, (40, 5)).astype(float), rng.integers(-3, 4, (30, 5)).astype(float)
    da, db = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>") for x in (a, b))
    want = a @ b.T
    for block in (7, 1000):
        got = {(r.a_id, r.b_id): r.x for r in moments.products(da, db, block=block).collect()}
        assert got == {(i, j): want[i, j] for i in range(40) for j in range(30)}
        some = moments.products(da, db, keep=3, block=block)
        best = some.groupBy("a_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("x")).alias("x"), "b_id"))), 1, 3).alias("s"))
        for r in best.collect():
            assert [(-t.x, t.b_id) for t in r.s] == [(want[r.a_id, j], j) for j in sorted(range(30), key=lambda j: (-want[r.a_id, j], j))[:3]]
