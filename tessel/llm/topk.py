"""Exact top-k by inner product, exhaustive and term at a time (op 6).

Vectors become sparse integer rows. A query's row scatters each of its weighted terms over that term's postings into a
dense array of scores, a partition selection keeps the k best of a block, and blocks merge by a window. Work is dealt in
blocks of bounded size: ``q_rows`` queries meet ``c_rows`` candidates in a task; neither side is broadcast or collected.

Vectors that are null or hold null or non-finite components take no part, nor do null ids. An id that is repeated counts
once, with its smallest row. Shorter vectors lack the further terms. Components and scores are 64-bit integers; a scaled
component or a score of two rows that doesn't fit one is an error. Ties go to the smaller id. Fewer candidates than k: all of them. Empty: empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, salted


def integer_rows(df: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of the usable vectors as 64-bit integers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    whole = np.floor(scale * x)
                    if (np.abs(whole) >= 2.0**63).any():
                        raise OverflowError(f"vector {i}: a scaled component doesn't fit a long")
                    rows.append(whole.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "terms"])

    got = df.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(convert, "vec_id long, terms binary")
    return got.groupBy("vec_id").agg(F.min("terms").alias("terms"))


def _matrix(rows: pd.Series) -> np.ndarray:
    parts = [np.frombuffer(r, "<i8") for r in rows]
    out = np.zeros((len(parts), max(map(len, parts), default=0)), np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


class Postings:
    """The candidates' weights by term: a full column where most candidates have the term, else its postings."""

    def __init__(self, candidates: np.ndarray, kind: type):
        self.n, self.kind = len(candidates), kind
        self.terms: list[tuple[np.ndarray | None, np.ndarray]] = []
        for t in range(candidates.shape[1]):
            column = candidates[:, t].astype(kind)
            post = np.flatnonzero(column)
            self.terms.append((None, column) if 4 * len(post) > self.n else (post, column[post]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """One dense array takes every term's weighted postings, a term at a time; it stays in the cache."""
        out, part = np.zeros(self.n, self.kind), np.empty(self.n, self.kind)
        for t in np.flatnonzero(query[: len(self.terms)]):
            weight, (post, values) = self.kind(query[t]), self.terms[t]
            if post is None:
                np.multiply(values, weight, out=part)
                out += part
            elif len(post):
                out[post] += values * weight
        return out


def _best(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    candidates = candidates.sort_values("vec_id")
    cid, cm = candidates.vec_id.to_numpy(np.int64), _matrix(candidates.terms)
    qid, qm = queries.vec_id.to_numpy(np.int64), _matrix(queries.terms)
    terms = min(qm.shape[1], cm.shape[1])
    most = [np.abs(m[:, :terms]).max(axis=0, initial=0).tolist() for m in (qm, cm)]
    top = sum(a * b for a, b in zip(*most, strict=True))  # of no score's terms is the sum larger
    index = Postings(cm, np.int32 if max(top, *map(int, (np.abs(qm).max(initial=0), np.abs(cm).max(initial=0)))) < 2**31 else np.int64)
    own = np.searchsorted(cid, qid)
    out: list[tuple[np.ndarray, ...]] = []
    for q, row, at in zip(qid, qm, own, strict=True):
        scores, want = index.scores(row), k
        mine = at < len(cid) and cid[at] == q
        if top >= 2**63:  # sums may not fit a long, so they are made of Python's integers
            exact = cm[:, :terms].astype(object) @ row[:terms].astype(object)
            if mine:
                exact[at] = 0
            if max(map(abs, exact), default=0) >= 2**63:
                raise OverflowError(f"query {q}: a score doesn't fit a long")
            scores = exact.astype(np.int64)
        if mine:
            want += 1  # its own row is among the best or not; it goes afterwards
        keep = np.arange(len(cid))
        if len(cid) > want:
            least = np.partition(scores, len(cid) - want)[len(cid) - want]
            above = np.flatnonzero(scores > least)
            keep = np.concatenate([above, np.flatnonzero(scores == least)[: want - len(above)]])  # ties: smaller ids first
        if mine:
            keep = keep[keep != at]
        out.append((np.full(len(keep), q), cid[keep], scores[keep].astype(np.int64)))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def top_inner_products(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding", q_rows: int = 1024, c_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows. ``is_query`` is a condition on ``vec_id``."""
    store = Scratch(df.sparkSession, "topk")
    rows = store.save(integer_rows(df, scale, id_col, vec_col), "rows").withColumn("q", F.coalesce(is_query, F.lit(False)))
    n, nq = rows.agg(F.count("*"), F.count_if("q")).first()
    cb, qb = max(1, -(-n // c_rows)), max(1, -(-nq // q_rows))
    candidates = rows.select("vec_id", "terms", F.lit(False).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), salted(F.col("vec_id"), cb).alias("cb"))
    queries = rows.where("q").select("vec_id", "terms", "q", salted(F.col("vec_id"), qb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return _best(pdf[pdf.q], pdf[~pdf.q], k)

    got = candidates.unionByName(queries).groupBy("qb", "cb").applyInPandas(block, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = store.save(got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
    store.keep_only("best")
    return best
