"""Vector arithmetic as expressions over ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Null if either is null; raises for different lengths, as the shorter one would be padded with nulls."""
    x, y = doubles(a), doubles(b)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.when(F.size(x) != F.size(y), F.raise_error("vectors of different length").cast("double")).otherwise(same)


def magnitude(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, t: s + t * t))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector has length 0."""
    n = magnitude(a) * magnitude(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))


def normalized(v: Column | str) -> Column:
    """The unit vector; the zero vector stays."""
    n = magnitude(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda p, q: p + q)


def blended(a: Column | str, b: Column | str, alpha: float | Column) -> Column:
    """alpha · a + (1 - alpha) · b."""
    w = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    return F.zip_with(doubles(a), doubles(b), lambda p, q: w * p + (1 - w) * q)


def resized(v: Column | str, size: int) -> Column:
    """Fewer dimensions: means of buckets; more: linear interpolation; then the unit vector."""
    x = doubles(v)
    n = F.size(x)
    down = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.aggregate(
            F.slice(x, F.floor(i * n / size).cast("int") + 1, F.greatest(F.lit(1), (F.floor((i + 1) * n / size) - F.floor(i * n / size)).cast("int"))),
            F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
            lambda a, t: F.struct((a["s"] + t).alias("s"), (a["n"] + 1).alias("n")),
            lambda a: a["s"] / a["n"],
        ),
    )
    place = lambda i: i * (n - 1) / F.lit(max(1, size - 1))
    up = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.element_at(x, F.floor(place(i)).cast("int") + 1) * (1 - (place(i) - F.floor(place(i))))
        + F.element_at(x, F.least(F.floor(place(i)).cast("int") + 2, n)) * (place(i) - F.floor(place(i))),
    )
    return normalized(F.when(n == size, x).when(n > size, down).otherwise(up))


def sparse_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two MAP<STRING, DOUBLE> over the union of their keys; a missing key is 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = F.map_values(F.map_zip_with(x, y, lambda k, p, q: F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0))))
    d = F.aggregate(both, F.lit(0.0), lambda s, t: s + t)
    n = magnitude(F.map_values(x)) * magnitude(F.map_values(y))
    return F.when(n == 0, F.lit(0.0)).otherwise(d / n)
