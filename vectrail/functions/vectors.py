"""Distances, similarities and element-wise kernels over array columns. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """Widen before any arithmetic: differences of floats would keep their error."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: int = 3) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / size)


def sliced_l2(a: Column, b: Column, width: int) -> Column:
    """Sum of the Euclidean distances of consecutive slices: per-window moments (width 3) or histograms."""
    starts = F.sequence(F.lit(1), F.size(a) - width + 1, F.lit(width))
    return F.aggregate(F.transform(starts, lambda s: l2(F.slice(a, s, F.lit(width)), F.slice(b, s, F.lit(width)))), F.lit(0.0), lambda t, x: t + x)


def set_distance_flat(a: Column, q: Column) -> Column:
    """Mean over i of sqrt(sum over j of (a_j - q_i)^2) on flat vectors: asymmetric, and not 0 for equal ones.
    Kept for results of earlier releases; keypoint_distance is the intended form."""
    each = F.transform(q, lambda x: F.sqrt(total(F.transform(a, lambda y: (y - x) * (y - x)))))
    return total(each) / F.size(q)


def keypoint_distance(a: Column, q: Column) -> Column:
    """Mean over the query's keypoints of the distance to the nearest keypoint of the other image."""
    return total(F.transform(q, lambda x: F.array_min(F.transform(a, lambda y: l2(x, y))))) / F.size(q)


def inverse_similarity(d: Column) -> Column:
    """100 / distance, and 100 at distance zero."""
    return F.when(d == 0, F.lit(100.0)).otherwise(F.try_divide(F.lit(100.0), d))


def last_component_similarity(a: Column, b: Column) -> Column:
    """inverse_similarity of the last components alone (compatibility form)."""
    return inverse_similarity(F.abs(F.element_at(a, -1) - F.element_at(b, -1)))


def exponential_kernel(a: Column, b: Column, gamma: float) -> Column:
    """exp(-gamma * ||a - b||), the norm not squared."""
    return F.exp(-F.lit(gamma) * l2(a, b))


def vector_mean(v: Column) -> Column:
    return total(v) / F.size(v)


def binarise(v: Column) -> Column:
    """1 where an element is at least the vector's own mean."""
    return F.transform(v, lambda x: (x >= vector_mean(v)).cast("int"))


def agreement(a: Column, b: Column) -> Column:
    """Number of places at which two binarised vectors hold the same."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def rocchio(query: Column, relevant_mean: Column, keep: float = 0.55) -> Column:
    """The query moved towards the mean of the relevant vectors."""
    return F.zip_with(query, relevant_mean, lambda q, r: q * keep + r * (1.0 - keep))


#: name: (measure, whether small values are near)
MEASURES: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "euclidean": (l2, True),
    "manhattan": (l1, True),
    "minkowski3": (minkowski, True),
    "cosine": (cosine_similarity, False),
}


def measure(name: str) -> tuple[Callable[[Column, Column], Column], bool]:
    if name not in MEASURES:
        raise ValueError(f"unknown measure {name!r}; known: {', '.join(MEASURES)}")
    return MEASURES[name]
