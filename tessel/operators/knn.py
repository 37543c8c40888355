"""Nearest items to a set of query items over several models.

The query is cut to MOST_QUERY items first, so what it is compared by is a small matrix a model; items meet it in one pass, a
matrix product for each Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tessel.functions import vectors as V
from tessel.operators.pairs import patch_score_matrix, stack_patches

#: Models in their order, the most results, the most query items that are compared.
MODELS = ["clip", "dino", "dinov3", "pecore_l", "pecore_g", "color"]
MOST_RESULTS, MOST_QUERY = 500, 64
PATCH_WEIGHT = 1.0
#: Products of patches that are held at once.
PATCH_PRODUCTS = 1 << 22


def active_models(weights: dict[str, float | None], known: list[str], fallback: str) -> dict[str, float]:
    """The known models of positive weight; none: the fallback with weight 1."""
    return {m: float(w) for m, w in weights.items() if m in known and (w or 0) > 0} or {fallback: 1.0}


def downsampled(query: DataFrame, most: int = MOST_QUERY, key: str = "image_id") -> DataFrame:
    """Of n distinct ids in order the ones at floor(i * n / most); all if there are no more than that."""
    ids = query.select(key).distinct()
    n = ids.agg(F.count("*").alias("__n"))
    rank = F.row_number().over(Window.orderBy(key)) - 1
    rows = ids.withColumn("__r", rank).join(F.broadcast(n))
    step = F.ceil(F.col("__r") * most / F.col("__n"))
    return rows.where((F.col("__n") <= most) | ((step < most) & (F.floor(step * F.col("__n") / most) == F.col("__r")))).select(key)


def _norms(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1))
    return np.where(n > 0, n, V.LEAST_NORM)


def query_vectors(rows: list[Row], aggregation: str, needs_norm: frozenset[str] = frozenset()) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each model the vectors that items are compared to and their norms: the mean of the query items' (unit) vectors at norm 1, or all of them."""
    if aggregation not in ("centroid", "min"):
        raise ValueError(f"unknown aggregation {aggregation}")
    own: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.image_id):
        own.setdefault(r.model, []).append(r.vec)
    out = {}
    for model, vectors in own.items():
        q = np.array(vectors, np.float64)
        n = _norms(q) if model in needs_norm else np.ones(len(q))
        if aggregation == "centroid":
            q = (q / n[:, None]).mean(axis=0, keepdims=True)
            q, n = q / _norms(q)[:, None], np.ones(1)
        out[model] = q, n
    return out


def model_distances(models: DataFrame, wanted: dict[str, tuple[np.ndarray, np.ndarray]], needs_norm: frozenset[str] = frozenset()) -> DataFrame:
    """(image_id, model, d): distance to the query's centroid, or to the nearest query item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, (q, qn) in wanted.items():
                own = b.filter(pc.equal(b.column(1), model))
                if not own.num_rows:
                    continue
                x = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, -1)
                n = _norms(x) if model in needs_norm else np.ones(len(x))
                dots = np.einsum("ij,kj->ik", x, q)  # equal vectors get equal sums, wherever they stand in a batch
                d = np.maximum(0.0, 1 - dots / (n[:, None] * qn[None, :])).min(axis=1)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(d)], ["image_id", "model", "d"])

    kind = models.schema["image_id"].dataType.simpleString()
    rows = models.where(F.col("model").isin(*wanted)).select("image_id", "model", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"image_id {kind}, model string, d double")


def patch_query_distances(patches: DataFrame, ids: list, aggregation: str) -> DataFrame:
    """(image_id, d): one less the patch match score, the mean over the query items ``ids`` (at most MOST_QUERY) that have patches or the least; an item is at 0 from itself."""
    rows = sorted(patches.where(F.col("image_id").isin(*ids)).select("image_id", "patches").collect(), key=lambda r: r.image_id)
    kind = patches.schema["image_id"].dataType.simpleString()
    q, q_ids = (stack_patches(pd.Series([r.patches for r in rows])) if rows else None), np.array([r.image_id for r in rows])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if q is None or pdf.empty:
                continue
            step = max(1, PATCH_PRODUCTS // (len(pdf.patches.iloc[0]) * q.shape[0] * q.shape[1]))
            for s in range(0, len(pdf), step):
                own = pdf.iloc[s : s + step]
                d = np.maximum(0.0, 1 - patch_score_matrix(stack_patches(own.patches), q))
                d[own.image_id.to_numpy()[:, None] == q_ids[None, :]] = 0.0
                yield pd.DataFrame({"image_id": own.image_id, "d": d.mean(axis=1) if aggregation == "centroid" else d.min(axis=1)})

    return patches.select("image_id", "patches").mapInPandas(run, f"image_id {kind}, d double")


def blended(distances: DataFrame, weights: dict[str, float], patches: DataFrame | None = None) -> DataFrame:
    """(image_id, distance): the models' distances (image_id, model, d) weighed linearly, those of patches (image_id, d) with weight 1."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    rows = distances.select("image_id", "d", w[F.col("model")].alias("w"))
    if patches is not None:
        rows = rows.unionByName(patches.withColumn("w", F.lit(PATCH_WEIGHT)))
    return rows.groupBy("image_id").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("distance"))


def group_of(members: DataFrame, key: str = "image_id") -> DataFrame:
    """(item, group_id, name): where an item is in several groups the last in group order counts."""
    return members.groupBy(key).agg(F.max_by(F.struct("group_id", "name"), "group_pos").alias("g")).select(key, "g.group_id", "g.name")


def nearest(
    models: DataFrame,
    query: DataFrame,
    weights: dict[str, float],
    aggregation: str = "centroid",
    top_n: int = 50,
    members: DataFrame | None = None,
    only: str = "any",
    restrict: DataFrame | None = None,
    exclude_query: bool = True,
    most_query: int = MOST_QUERY,
    patches: DataFrame | None = None,
    needs_norm: frozenset[str] = frozenset({"color"}),
    fallback: str = "clip",
    known_models: list[str] | None = None,
) -> DataFrame:
    """(image_id, distance, group_id, name): the nearest items, ties to the smaller id; filters apply before the cut.

    models: image_id, model, vec (null vectors don't count); patches: image_id, patches, if they are to count. What comes to the driver are the
    names of the models (found by a scan unless ``known_models`` are given) and the vectors of ``most_query`` items at most. Query items without vectors are ignored; if none has any, an error is raised."""
    models = models.where(F.col("vec").isNotNull())
    known = query.select("image_id").join(models.select("image_id"), "image_id", "left_semi")
    asked = models.join(downsampled(known, most_query), "image_id", "left_semi").select("image_id", "model", F.col("vec").cast("array<double>").alias("vec"))
    names = models.select("model").distinct().select(F.lit(None).cast(models.schema["image_id"].dataType).alias("image_id"), "model", F.lit(None).cast("array<double>").alias("vec"))
    got = (asked if known_models is not None else asked.unionByName(names)).collect()
    rows = [r for r in got if r.vec is not None]
    if not rows:
        raise ValueError("none of the query items has a vector")
    use = active_models(weights, known_models if known_models is not None else [r.model for r in got if r.vec is None], fallback)
    wanted = query_vectors([r for r in rows if r.model in use], aggregation, needs_norm)
    by_patch = None if patches is None else patch_query_distances(patches, sorted({r.image_id for r in rows}), aggregation)
    found = blended(model_distances(models, wanted, needs_norm), use, by_patch)
    if exclude_query:
        found = found.join(query.select("image_id").distinct(), "image_id", "left_anti")
    if restrict is not None:
        found = found.join(restrict.select("image_id"), "image_id", "left_semi")
    if members is not None:
        found = found.join(group_of(members), "image_id", "left")
    else:
        found = found.withColumns({"group_id": F.lit(None).cast("string"), "name": F.lit(None).cast("string")})
    if only == "in-group":
        found = found.where(F.col("group_id").isNotNull())
    elif only == "not-in-group":
        found = found.where(F.col("group_id").isNull())
    return found.orderBy("distance", "image_id").limit(max(1, min(top_n, MOST_RESULTS))).select("image_id", "distance", "group_id", "name")
