"""Vector arithmetic on ARRAY<DOUBLE> columns, and the dispatch of distance metrics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x / length)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine_distance(a: Column, b: Column, normalised: bool = False) -> Column:
    """1 - cos, the cosine held in [-1, 1]; lengths get EPS added unless vectors are unit ones."""
    product = dot(a, b)
    if not normalised:
        product = product / ((norm(a) + EPS) * (norm(b) + EPS))
    return F.lit(1.0) - clip(product, -1.0, 1.0)


def metric(name: str):
    """The distance of two columns by name; ``euclidean`` is the squared length."""
    known = {"cosine": cosine_distance, "euclidean": squared_l2}
    if name not in known:
        raise ValueError(f"unknown metric {name!r}: one of {sorted(known)}")
    return known[name]


def mean_vector(v: Column | str) -> Column:
    """Aggregate: the mean of vectors, summed on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(v) if isinstance(v, str) else v)))
