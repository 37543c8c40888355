"""Near-duplicate vectors: an exact metric range join (op 3).

Unit vectors of one label are dealt to the cells of their nearest pivot. Cosine >= t means a distance of at most
r = sqrt(2 - 2t), so by the triangle inequality a vector whose partners may live in another cell is no more than 2r
farther from that cell's pivot than from its own, and (both being points of a Euclidean space) no more than r from the
plane between the two pivots; it is copied to such cells of smaller number only, so each pair meets in one cell. Cells
join independently, and a large cell is cut into chunks whose pairs are joined in separate tasks of bounded size.

Equal unit vectors are merged beforehand and counted, and a task returns counts and a spanning forest of the links it
found, not the pairs, so a group of copies of any size costs rows in proportion to its members.

The pivots are a sample that grows with the root of the number of vectors, one for ``cell_rows`` vectors while that is
fewer, and at most ``max_pivots``: the only thing collected and broadcast. They decide speed, not results.

Vectors that are null, zero, or hold null or non-finite components, vectors without a label, and null ids link with
nothing. Vectors of different lengths never link. Rows that repeat an id are one vector, the smallest. Empty: empty."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components


def _units(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, unit): unit is null for vectors that can't link."""
    label = df.schema[label_col].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, units = [], []
            for v, lab in zip(b.column(1), b.column(2), strict=True):
                unit = None
                if v.is_valid and lab.is_valid and not v.values.null_count and len(v.values):
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        x = x / top
                        unit = (x / np.sqrt(x @ x)).astype("<f8").tobytes()
                dims.append(len(v.values) if unit else 0)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "label", "dim", "unit"])

    return df.select(F.col(id_col).cast("long"), F.col(vec_col), F.col(label_col)).mapInArrow(convert, f"vec_id long, label {label}, dim int, unit binary")


def _rows(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)


def _join_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts of links and a spanning forest, of the pairs between two chunks of a cell (or within one)."""
    pdf = pdf.sort_values(["side", "rep", "home"])
    x, rep, home, mult = _rows(pdf.unit), pdf.rep.to_numpy(), pdf.home.to_numpy(), pdf["mult"].to_numpy()
    left = np.flatnonzero(pdf.side.to_numpy() == 0)
    right = np.flatnonzero(pdf.side.to_numpy() == 1)
    within = not len(right) and bool((pdf.a == pdf.b).all())
    count, root, forest = np.zeros(len(x), np.int64), np.arange(len(x)), []
    if within:
        right = left
    for s in range(0, len(left) if len(right) else 0, 256):
        rows = left[s : s + 256]
        cos = x[rows] @ x[right].T
        link = cos >= threshold
        for i, j in np.argwhere(np.abs(cos - threshold) < 1e-12):  # as near as that, the sum of the products decides
            link[i, j] = float(np.dot(x[rows[i]], x[right[j]])) >= threshold
        link &= home[rows][:, None] | home[right][None, :]
        if within:
            link &= rows[:, None] < right[None, :]
        count[rows] += link @ mult[right]
        count[right] += mult[rows] @ link
        for i, hits in zip(rows, link, strict=True):
            if hits.any():
                mine = np.unique(np.append(root[right[hits]], root[i]))
                if len(mine) > 1:
                    forest += [(rep[mine[0]], rep[m]) for m in mine[1:]]
                    root[np.isin(root, mine)] = mine[0]
    some = count > 0
    return pd.DataFrame({"a": np.concatenate([rep[some], [p for p, _ in forest]]), "b": np.concatenate([np.full(int(some.sum()), -1), [q for _, q in forest]]), "links": np.concatenate([count[some], np.zeros(len(forest))])}).astype({"a": "int64", "b": "int64", "links": "int64"})


def _cells(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's own cell, and (row, cell) of the cells of smaller number where partners of a vector may live."""
    d2 = np.maximum(2 - 2 * (x @ p.T), 0)
    own = d2.argmin(axis=1)
    mine = d2[np.arange(len(x)), own]
    near = d2 <= ((np.sqrt(mine) + 2 * radius) ** 2)[:, None]
    near &= np.arange(len(p))[None, :] < own[:, None]
    row, cell = np.nonzero(near)
    apart = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", p[own[row]], p[cell]), 0))
    keep = ((d2[row, cell] - mine[row]) / np.maximum(2 * apart, 1e-12) <= radius) | (apart < 1e-6)
    return own, row[keep], cell[keep]


def link_vectors(df: DataFrame, threshold: float = 0.98, max_pivots: int = 65_536, cell_rows: int = 2000, chunk_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = df.sparkSession
    store = Scratch(spark, "vectors")
    units = store.save(_units(df, id_col, vec_col, label_col), "units")
    one = units.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("unit", "label", "dim")).alias("v")).select("vec_id", "v.*")
    reps = store.save(one.where("unit IS NOT NULL").groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "reps")
    n = reps.count()
    want = min(max_pivots, n // cell_rows, 512 + 4 * math.isqrt(n))
    pivots: dict[tuple, np.ndarray] = {}
    for r in reps.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(want).collect() if want else []:
        pivots.setdefault((r.label, r.dim), []).append(np.frombuffer(r.unit, "<f8"))
    held = spark.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (label, dim), g in pdf.groupby(["label", "dim"]):
                p = held.value.get((label, dim))
                if p is None:
                    yield g.assign(cell=0, home=True)
                    continue
                for at in range(0, len(g), max(1, (1 << 22) // len(p))):
                    part = g.iloc[at : at + max(1, (1 << 22) // len(p))]
                    own, row, cell = _cells(_rows(part.unit), p, radius)
                    yield part.assign(cell=own, home=True)
                    yield part.iloc[row].assign(cell=cell, home=False)

    label = reps.schema["label"].dataType.simpleString()
    cells = store.save(reps.mapInPandas(deal, f"label {label}, dim int, unit binary, rep long, mult long, cell int, home boolean"), "cells")
    size = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    dealt = cells.join(size, ["label", "dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("label", "dim", "cell", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "rep", "mult", "unit", "home")
    found = store.save(dealt.groupBy("label", "dim", "cell", "a", "b").applyInPandas(lambda pdf: _join_block(pdf, threshold), "a long, b long, links long"), "found")
    comp = components(found.where("b >= 0").select("a", "b"), store, "comp")
    links = found.where("b < 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    per_rep = reps.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    per_rep = per_rep.select("label", "dim", "unit", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = one.join(per_rep, ["label", "dim", "unit"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    nameless = units.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    out = store.save(out, "result")
    store.keep_only("result")
    return out
