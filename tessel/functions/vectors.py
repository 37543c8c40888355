"""Vector arithmetic as column expressions over ARRAY<DOUBLE>; sums run from the first component to the last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least norm that is divided by, and the least product of norms.
LEAST_NORM, LEAST_PRODUCT = 1e-10, 1e-20


def doubles(vec: Column | str) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def rounded(x: Column, places: int) -> Column:
    """As SQL rounds: what rounds to 0 from below stays -0."""
    r = F.round(x, places)
    return F.when(r == 0, F.signum(x) * 0.0).otherwise(r)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(LEAST_NORM))
    return F.transform(a, lambda x: x / n)


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Never below 0; 1 where a norm is (next to) nothing. Norms kept in columns are not computed again."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.greatest(F.lit(0.0), 1 - F.when(size > LEAST_PRODUCT, dot(a, b) / size).otherwise(0.0))


def weighted_concat(parts: list[tuple[Column, float, bool]]) -> Column:
    """(vector, weight, normalise first) of each model, scaled and joined."""
    scaled = []
    for vec, weight, needs_norm in parts:
        v = unit(vec) if needs_norm else vec
        scaled.append(F.transform(v, lambda x, w=weight: x * F.lit(float(w))))
    return F.concat(*scaled)


def weighted_cosine(dots: Column, squares_a: Column, squares_b: Column) -> Column:
    """Distance of weighted concatenations from the models' sums of squared weight times dot and square norms."""
    size = F.sqrt(squares_a) * F.sqrt(squares_b)
    return F.greatest(F.lit(0.0), 1 - F.when(size > LEAST_PRODUCT, dots / size).otherwise(0.0))


def patch_distance(score: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - score)


def is_zero(vec: Column) -> Column:
    return F.forall(vec, lambda x: x == 0)
