"""All pairs of vectors, of patch sets and of groups, in blocks.

Every pair of items is wanted, so the work is quadratic by nature; it is dealt as pairs of blocks of at most ``block``
items, each an independent task with one matrix product. Nothing is broadcast and no task holds more than two blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import vectors as V


#: Pairs of items whose patches are compared at once.
PORTION = 1 << 14


def block_pairs(rows: DataFrame, key: str, block: int, keep: list[str]) -> DataFrame:
    """Rows dealt to pairs of blocks (ba <= bb) by key; side 0 for the left block, 1 for the right, 0 where they are the same."""
    n = rows.agg(F.count("*")).first()[0]
    blocks = max(1, -(-n // block))
    mine = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("__m", mine).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.select(F.least("__m", "__o").alias("ba"), F.greatest("__m", "__o").alias("bb"), (F.col("__m") > F.col("__o")).cast("int").alias("side"), *keep)


def _upper(pdf: pd.DataFrame, key: str, distance) -> pd.DataFrame:
    """The pairs i < j of two blocks (or within one) and their distances."""
    left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
    within = bool((pdf.ba == pdf.bb).all())
    if within:
        right = left
    if not len(left) or not len(right):
        return pd.DataFrame({"i": [], "j": [], "d": []}).astype({"i": "int64", "j": "int64", "d": "float64"})
    d = distance(left, right)
    a, b = left[key].to_numpy(), right[key].to_numpy()
    x, y = np.nonzero(a[:, None] < b[None, :]) if within else np.indices(d.shape).reshape(2, -1)
    return pd.DataFrame({"i": np.minimum(a[x], b[y]), "j": np.maximum(a[x], b[y]), "d": d[x, y]})


def cosine_pairs(items: DataFrame, key: str = "image_id", vec: str = "vec", block: int = 1024) -> DataFrame:
    """(i, j, d) for i < j: cosine distance, 1 where a norm is nothing."""

    def distance(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        x, y = np.stack(a[vec]).astype(np.float64), np.stack(b[vec]).astype(np.float64)
        size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        dots = x @ y.T
        return np.maximum(0.0, 1 - np.where(size > V.LEAST_PRODUCT, dots / np.where(size > V.LEAST_PRODUCT, size, 1), 0.0))

    dealt = block_pairs(items.select(key, vec), key, block, [key, vec])
    return dealt.groupBy("ba", "bb").applyInPandas(lambda pdf: _upper(pdf, key, distance), "i long, j long, d double")


def combined(models: DataFrame, weights: dict[str, float], needs_norm: frozenset[str] = frozenset({"color"})) -> DataFrame:
    """(image_id, vec): the models' vectors scaled by their weights and joined in the order of the models' names; items that lack a model are left out."""
    active = {m: float(w) for m, w in weights.items() if w and w > 0}
    if not active:
        raise ValueError("no model has a positive weight")
    w = F.create_map(*(F.lit(x) for kv in active.items() for x in kv))
    vec = F.when(F.col("model").isin(*needs_norm), V.unit(F.col("vec"))).otherwise(F.col("vec")) if needs_norm else F.col("vec")
    rows = models.where(F.col("model").isin(*active)).withColumn("w", w[F.col("model")]).withColumn("vec", vec)
    rows = rows.select("image_id", "model", F.transform("vec", lambda x: x * F.col("w")).alias("vec"))
    got = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("model", "vec"))).alias("parts")).where(F.size("parts") == len(active))
    return got.select("image_id", F.flatten(F.transform("parts", lambda p: p["vec"])).alias("vec"))


def weighted_pairs(models: DataFrame, weights: dict[str, float], needs_norm: frozenset[str] = frozenset({"color"}), block: int = 1024) -> DataFrame:
    """Cosine distances of weighted concatenations: weights count squared."""
    return cosine_pairs(combined(models, weights, needs_norm), block=block)


def patch_score_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all items of a (n, p, d) against all of b: the mean of each patch's best match, in both directions.

    Beside the scores no more than a few numbers a patch are held for PORTION pairs of items at once."""
    n, p, d = a.shape
    m, q, _ = b.shape
    out = np.empty((n, m))
    left, right = np.ascontiguousarray(a.transpose(1, 0, 2)), np.ascontiguousarray(b.transpose(1, 2, 0))
    wide = max(1, min(m, PORTION // min(n, 64)))
    high = max(1, PORTION // wide)
    for i in range(0, n, high):
        for j in range(0, m, wide):
            x, y = left[:, i : i + high], right[:, :, j : j + wide]
            shape = (x.shape[1], y.shape[2])
            best, total, dots = np.full((q, *shape), -np.inf), np.zeros(shape), np.empty(shape)
            for one in x:
                row = np.full(shape, -np.inf)
                for k, other in enumerate(y):
                    np.matmul(one, other, out=dots)
                    np.maximum(row, dots, out=row)
                    np.maximum(best[k], dots, out=best[k])
                total += row
            out[i : i + high, j : j + wide] = (total + best.sum(axis=0)) / (p + q)
    return out


def stack_patches(patches: pd.Series) -> np.ndarray:
    return np.stack([np.stack(x) for x in patches]).astype(np.float64)


def patch_pairs(items: DataFrame, key: str = "image_id", block: int = 256) -> DataFrame:
    """(i, j, d) for i < j: one less the patch match score; ``patches`` is an array of unit vectors."""

    def distance(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        return np.maximum(0.0, 1 - patch_score_matrix(stack_patches(a.patches), stack_patches(b.patches)))

    dealt = block_pairs(items.select(key, "patches"), key, block, [key, "patches"])
    return dealt.groupBy("ba", "bb").applyInPandas(lambda pdf: _upper(pdf, key, distance), "i long, j long, d double")


GROUP_PAIRS = "group_a string, group_b string, a_pos long, b_pos long, size_a long, size_b long, patch_median double, patch_p75 double, patch_best double, closest_a long, closest_b long"


def group_similarity(members: DataFrame, patches: DataFrame, max_combined: int = 0, min_size: int = 2, block: int = 16) -> DataFrame:
    """Scores of every pair of groups, in group order: of all member pairs' patch scores in falling order the ones at n/2 and 3n/4, the best, and its pair (the first in member order).

    members: group_id, group_pos, image_id, member_pos. Groups of fewer than ``min_size`` members with patches are left out; pairs of more than ``max_combined`` members (0: no limit) aren't scored, and
    a group that is too large for any partner isn't read."""
    rows = members.join(patches.select("image_id", "patches"), "image_id")
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    if max_combined:
        sizes = sizes.where(F.col("size") <= max_combined - min_size)
    groups = members.select("group_id", "group_pos").distinct().join(sizes, "group_id")
    dealt = block_pairs(groups, "group_id", block, ["group_id", "group_pos", "size"])
    rows = dealt.join(rows.select("group_id", "image_id", "member_pos", "patches"), "group_id")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        within, out = bool((pdf.ba == pdf.bb).all()), []
        groups = {k: g.sort_values("member_pos") for k, g in pdf.groupby("group_id")}
        stacks = {k: stack_patches(g.patches) for k, g in groups.items()}
        first = {k: (int(g.group_pos.iloc[0]), int(g["size"].iloc[0]), int(g.side.iloc[0])) for k, g in groups.items()}
        order = sorted(groups, key=lambda k: first[k][0])
        for x, a in enumerate(order):
            for b in order[x + 1 :]:
                if (not within and first[a][2] == first[b][2]) or (max_combined and first[a][1] + first[b][1] > max_combined):
                    continue
                s = patch_score_matrix(stacks[a], stacks[b])
                falling = np.sort(s.ravel())[::-1]
                i, j = np.unravel_index(int(s.argmax()), s.shape)
                out.append((a, b, first[a][0], first[b][0], first[a][1], first[b][1], falling[len(falling) // 2], falling[3 * len(falling) // 4], falling[0], int(groups[a].image_id.iloc[i]), int(groups[b].image_id.iloc[j])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in GROUP_PAIRS.split(", ")])

    return rows.groupBy("ba", "bb").applyInPandas(score, GROUP_PAIRS)


def merge_suggestions(pairs: DataFrame, min_score: float = 0.65, per_group: int = 8, max_size: int = 0, groups: DataFrame | None = None) -> DataFrame:
    """Ranked suggestions of each group from group_similarity's rows: both directions of each pair, the ``per_group`` nearest, groups by their best.

    With ``groups`` (group_id) pairs of groups that are gone are skipped."""
    if groups is not None:
        ids = groups.select("group_id").distinct()
        pairs = pairs.join(ids.withColumnRenamed("group_id", "group_a"), "group_a", "left_semi").join(ids.withColumnRenamed("group_id", "group_b"), "group_b", "left_semi")
    from pyspark.sql import Window

    kept = pairs.where(F.col("patch_median") >= min_score)
    if max_size:
        kept = kept.where(F.col("size_a") + F.col("size_b") <= max_size)
    d = (1 - F.col("patch_median")).alias("distance")
    one = kept.select(F.col("group_a").alias("ref_group"), F.col("a_pos").alias("ref_pos"), F.col("group_b").alias("similar_group"), F.col("b_pos").alias("similar_pos"), d)
    two = kept.select(F.col("group_b").alias("ref_group"), F.col("b_pos").alias("ref_pos"), F.col("group_a").alias("similar_group"), F.col("a_pos").alias("similar_pos"), d)
    w = Window.partitionBy("ref_group").orderBy("distance", "similar_pos")
    ranked = one.unionByName(two).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_group)
    best = F.min("distance").over(Window.partitionBy("ref_group"))
    return ranked.withColumn("best", best).select("ref_group", "ref_pos", "rank", "similar_group", "distance", "best")
