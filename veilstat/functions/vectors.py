"""Vector arithmetic on ARRAY<DOUBLE> columns, inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def sq_distances(features: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """Array of squared distances to each centroid."""
    return F.array(*[sq_distance(features, vector(c)) for c in centroids])


def argmin(distances: Column) -> Column:
    """Place of the least value; the first among equals."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def assign(distances: Column, radius: float | None = None) -> Column:
    """Nearest centroid, or the number of centroids for a point farther than `radius`."""
    nearest = argmin(distances)
    if radius is None:
        return nearest
    return F.when(F.array_min(distances) > radius * radius, F.size(distances)).otherwise(nearest)


def _bounds(lower: float, upper: float, strict: bool = False) -> None:
    for v in (lower, upper):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise TypeError("bounds must be numbers")
    if lower > upper or strict and lower == upper:
        raise ValueError("lower bound above the upper one" if lower > upper else "bounds must differ")


def truncate(x: Column, lower: float = -1.0, upper: float = 1.0) -> Column:
    _bounds(lower, upper)
    return F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), x))


def fold(x: Column, lower: float = -1.0, upper: float = 1.0) -> Column:
    """Reflects into [lower, upper]."""
    _bounds(lower, upper, strict=True)
    w = float(upper - lower)
    v = F.pmod(x - float(lower), F.lit(2 * w))
    return F.lit(float(lower)) + F.when(v > w, 2 * w - v).otherwise(v)


def clip_move(old: Column, new: Column, radius: Column | float) -> Column:
    """`new`, or the point at `radius` from `old` in its direction if it is farther."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    norm = F.sqrt(sq_distance(new, old))
    return F.when(norm > r, F.zip_with(old, new, lambda o, n: o + F.try_divide(r * (n - o), norm))).otherwise(new)


def project(features: Column, basis: Sequence[Sequence[float]]) -> Column:
    """features times a (d, d') basis."""
    return F.array(*[dot(features, vector([row[j] for row in basis])) for j in range(len(basis[0]))])


def sign_label(projections: Column) -> Column:
    """Bit j is set if coordinate j is at least 0."""
    bits = F.transform(projections, lambda p, j: F.when(p >= 0, F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), j)).otherwise(0.0))
    return total(bits).cast("int")


def center(features: Column, means: Column) -> Column:
    return F.zip_with(features, means, lambda x, m: x - m)


def clipped_gradient_weight(features: Column, projections: Column, clip: float) -> Column:
    """Factor that clips the gradient -2 x (x W)^T to a Frobenius norm of `clip`; the norm is 2 |x| |xW|."""
    norm = 2 * F.sqrt(dot(features, features)) * F.sqrt(dot(projections, projections))
    return F.least(F.lit(1.0), F.lit(float(clip)) / (norm + 1e-8))
