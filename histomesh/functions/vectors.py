"""Column helpers for ARRAY<DOUBLE|FLOAT> vectors, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def vsum(values) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x)


def doubles(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    return vsum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(vsum(F.transform(doubles(a), lambda x: x * x)))


def l2_normalize(a, floor: float = 1e-9) -> Column:
    length = F.greatest(norm(a), F.lit(floor))
    return F.transform(doubles(a), lambda x: x / length)


def cosine(a, b, floor: float = 1e-9) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def euclid2(a, b) -> Column:
    return vsum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def canberra(a, b) -> Column:
    """Sum of |x-y| / (|x|+|y|), with 0/0 taken as 0."""
    term = lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)
    return vsum(F.zip_with(doubles(a), doubles(b), term))


def argmax(a) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(_col(a), F.array_max(_col(a))) - 1).cast("int")


def mean_vector(v, weight=None) -> Column:
    """Aggregate: (weighted) elementwise mean, as an array."""
    vec = array_to_vector(doubles(v))
    return vector_to_array(Summarizer.mean(vec, _col(weight)) if weight is not None else Summarizer.mean(vec))


def max_vector(v) -> Column:
    """Aggregate: elementwise maximum, as an array."""
    return vector_to_array(Summarizer.max(array_to_vector(doubles(v))))
