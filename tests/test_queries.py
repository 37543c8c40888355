"""Every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessel.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    return float(x) + 0.0 if isinstance(x, (float, np.floating)) else x


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_named_once():
    assert len(catalog.QUERIES) == sum(len(p.QUERIES) for p in catalog.PARTS)
