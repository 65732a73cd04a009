"""Similarity and distance of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors; 0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + euclidean(a, b))


def cosine_graph_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for a zero vector."""
    return 1 - cosine(a, b)


def cosine_drift(a: Column, b: Column) -> Column:
    """1 - cosine in [0, 1] over the shorter length; 0.5 for an empty vector, 1 for a zero one."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    d = F.least(F.greatest(1 - cosine(x, y), F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.5)).otherwise(d)


def consistency(metric: str, a: Column, b: Column) -> Column:
    """Cross-modal consistency; 0 where a vector is missing or empty."""
    by = {
        "cosine": F.greatest(cosine(a, b), F.lit(0.0)),
        "euclidean": euclidean_similarity(a, b),
        "dot_product": 1 / (1 + F.exp(-dot(a, b))),
    }
    empty = a.isNull() | b.isNull() | (F.size(a) <= 0) | (F.size(b) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(by[metric])


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two key arrays; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def byte_fingerprint(text: Column, parts: int = 4) -> Column:
    """Mean/255 of each of the first four byte chunks; the chunk length is a quarter of the bytes, 1 at least."""
    data = F.hex(F.encode(text, "UTF-8"))
    n = F.length(data) / 2
    step = F.greatest(F.floor(n / parts), F.lit(1)).cast("int")

    def chunk(i: Column) -> Column:
        codes = F.regexp_extract_all(F.substring(data, (i * step * 2 + 1).cast("int"), (step * 2).cast("int")), F.lit("(..)"))
        return F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.conv(c, 16, 10).cast("double"), lambda s: s / F.size(codes) / 255)

    return F.transform(F.sequence(F.lit(0), F.least(F.lit(parts), F.ceil(n / step).cast("int")) - 1), chunk)


def is_valid(v: Column, dimension: int) -> Column:
    """The right length, and every component finite."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))
