"""Sums over vectors by array operations: first and second moments of a table, means by key, products of two tables of vectors.

Every task sums what it has; sums of bounded size are added up in two steps. Nothing is exploded to components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of either side of a product that meet in a task.
BLOCK = 4096


def second_moments(items: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, Σx, Σxxᵀ) of a column of vectors of one dimension d; d² numbers come to the driver, whatever the table. Null vectors don't count."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[vec]).astype(np.float64)
            s, m = (x.sum(axis=0), x.T @ x) if s is None else (s + x.sum(axis=0), m + x.T @ x)
            n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "m": [m.ravel()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, 0.0, 0.0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                n, s, m = n + r.n, s + r.s, m + r.m
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "m": [m]})

    sums = items.select(vec).where(F.col(vec).isNotNull()).mapInPandas(part, "n long, s array<double>, m array<double>")
    fan = min(64, items.sparkSession.sparkContext.defaultParallelism)
    row = sums.repartition(fan).mapInPandas(add, sums.schema).coalesce(1).mapInPandas(add, sums.schema).first()
    if row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    return row.n, np.array(row.s), np.array(row.m).reshape(len(row.s), -1)


def means(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, mean, n): the mean vector of each key. Rows of a key are summed batch by batch before they meet, so a hot key is a few rows."""
    kind = rows.schema[key].dataType.simpleString()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            code, keys = pd.factorize(pdf[key])
            order = np.argsort(code, kind="stable")
            x = np.stack(pdf[vec]).astype(np.float64)[order]
            starts = np.searchsorted(code[order], np.arange(len(keys)))
            yield pd.DataFrame({"k": np.asarray(keys), "n": np.bincount(code, minlength=len(keys)), "s": list(np.add.reduceat(x, starts, axis=0))})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.n.sum())
        return pd.DataFrame({"k": [pdf.k.iloc[0]], "mean": [np.sum(np.stack(pdf.s), axis=0) / n], "n": [n]})

    sums = rows.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(key, vec).mapInPandas(part, f"k {kind}, n long, s array<double>")
    return sums.groupBy("k").applyInPandas(add, f"k {kind}, mean array<double>, n long").withColumnRenamed("k", key)


def products(a: DataFrame, b: DataFrame, keep: int | None = None, block: int = BLOCK, rows: tuple[int, int] | None = None) -> DataFrame:
    """(a_id, b_id, x): inner products of all vectors of a (id, vec) and b (id, vec), or of each of a the ``keep`` largest within a block of b (ties to
    smaller ids), among which its largest are. Both sides are dealt in blocks of about ``block``, so neither is broadcast. ``rows``: their sizes, if known."""
    na, nb = (-(-n // block) or 1 for n in (rows or (a.count(), b.count())))
    kinds = [df.schema["id"].dataType.simpleString() for df in (a, b)]

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        rows = df.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(names[0]))
        return rows.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select("ka", "kb", "id", "vec")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame(columns=["a_id", "b_id", "x"])
        y = y.sort_values("id")
        p = np.stack(x.vec).astype(np.float64) @ np.stack(y.vec).astype(np.float64).T
        ids, others = x.id.to_numpy(), y.id.to_numpy()
        if keep is None or keep >= len(others):
            return pd.DataFrame({"a_id": np.repeat(ids, len(others)), "b_id": np.tile(others, len(ids)), "x": p.ravel()})
        top = np.argsort(-p, axis=1, kind="stable")[:, :keep]
        return pd.DataFrame({"a_id": np.repeat(ids, keep), "b_id": others[top].ravel(), "x": np.take_along_axis(p, top, axis=1).ravel()})

    left, right = dealt(a, na, nb, ("ka", "kb")), dealt(b, nb, na, ("kb", "ka"))
    return left.groupBy("ka", "kb").cogroup(right.groupBy("ka", "kb")).applyInPandas(run, f"a_id {kinds[0]}, b_id {kinds[1]}, x double")
