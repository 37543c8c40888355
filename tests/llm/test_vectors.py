"""Embedding near-dedup and exact top-k against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessel.llm.topk import top_inner_products
from tessel.llm.vector_dedup import link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, side string"


def vectors(n=400, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(n):
        v = base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 30 % 3), "x"))
    rows += [(n, None, 1, "x"), (n + 1, [0.0] * 16, 1, "x"), (n + 2, rows[0][1], None, "x"), (n + 3, [float("nan")] + [1.0] * 15, 1, "x"), (n + 4, [None] + [1.0] * 15, 1, "x"), (n + 5, [1.0, 2.0], 1, "x"), (n + 6, [2.0, 4.0], 1, "x"), (n + 7, [], 1, "x"), rows[5], (None, rows[0][1], 0, "x")]
    return rows


def brute_links(rows, t=0.98):
    kept = {}
    for i, v, lab, _ in rows:
        if i is not None and i not in kept:
            ok = v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
            kept[i] = (np.array(v, float), lab) if ok else None
    ids = sorted(kept)
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and kept[a] and kept[b] and kept[a][1] == kept[b][1] and len(kept[a][0]) == len(kept[b][0]):
                x, y = kept[a][0], kept[b][0]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    near[a].add(b)
                    near[b].add(a)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += near[j]
    return {i: (len(near[i]), comp[i], comp[i] == i) for i in ids}


def test_links_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_links(rows)
    for opts in ({}, {"cell_rows": 40, "chunk_rows": 16}, {"cell_rows": 10}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(df, **opts).collect()}
        assert got.pop(None) == (0, None, False)
        assert got == want


def test_links_of_one_large_group_of_copies(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=8)
    rows = [(i, [float(x) for x in (v if i % 3 else v + rng.normal(size=8) * 0.01)], 1, "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(df, chunk_rows=32).collect()}
    assert got == brute_links(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert link_vectors(df).count() == 0
    assert top_inner_products(df, F.col("vec_id") % 20 == 0).count() == 0


def test_topk_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    ints = {}
    for i, v, _, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = [int(np.floor(64 * x)) for x in v]
    want = []
    for q in ints:
        if q % 20 == 0:
            got = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    for opts in ({}, {"q_rows": 3, "c_rows": 50}):
        got = [tuple(r) for r in top_inner_products(df, F.col("vec_id") % 20 == 0, **opts).collect()]
        assert sorted(got) == sorted(want)


def test_topk_with_fewer_candidates_than_k_and_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], 1, "") for i in (40, 3, 1, 2)], SCHEMA)
    got = [(r["rank"], r.vec_id, r.score) for r in top_inner_products(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 4096), (2, 2, 4096), (3, 3, 4096)]


def test_topk_of_large_components(spark):
    df = spark.createDataFrame([(20, [2.0**27, 1.0], 1, ""), (1, [2.0**21, 1.0], 1, ""), (2, [0.5, 3.0], 1, ""), (3, [-(2.0**20), 0.0], 1, "")], SCHEMA)
    got = [(r.vec_id, r.score) for r in top_inner_products(df, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert got == [(1, 2**60 + 4096), (2, 2**38 + 3 * 4096), (3, -(2**59))]


def test_columns_of_any_names_beside_the_vectors(spark):
    rows = vectors(60)
    plain = spark.createDataFrame(rows, SCHEMA)
    extra = plain
    for c in ("rank", "score", "q", "rep", "query_id", "kept", "n_links", "component_id", "id", "vec", "node", "cell", "pivot", "block", "key"):
        extra = extra.withColumn(c, F.lit("x"))
    kinds = (link_vectors, lambda df: top_inner_products(df, F.col("vec_id") % 20 == 0))
    for op in kinds:
        a, b = (sorted(map(str, op(df).collect())) for df in (plain, extra))
        assert a == b and a
