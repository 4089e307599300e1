"""Distances and vector forms as Column expressions, and their numpy block kernels.

Sums run in double precision.  A distance that isn't finite becomes the largest
float32 (1 for cosine).  `inner_product` is 1 minus the product, as every
distance is ranked in ascending order; `score` is 1 / (1 + distance).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric

FLOAT_MAX = 3.4028234663852886e38


def _column(v) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression used inside a lambda is evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_column(a), lambda x: x.cast("double") * x.cast("double"))))


def _finite(d: Column, otherwise: float = FLOAT_MAX) -> Column:
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(otherwise)).otherwise(d)


def l2_squared(a, b) -> Column:
    return _finite(_sum(F.zip_with(_column(a), _column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product(a, b) -> Column:
    return _finite(1 - dot(a, b))


def cosine_similarity(a, b) -> Column:
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def cosine_distance(a, b) -> Column:
    return _finite(1 - cosine_similarity(a, b), 1.0)


def distance(metric: Metric, a, b) -> Column:
    """MIPSL2 and an undefined metric are the squared Euclidean distance."""
    return {Metric.IP: inner_product, Metric.COSINE: cosine_distance}.get(metric, l2_squared)(a, b)


def score(d: Column) -> Column:
    return F.when(1 + d == 0, F.lit(float("inf"))).otherwise(1 / (1 + d))


def normalize(a) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = _column(a)
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))


def to_float(a) -> Column:
    """Any numeric vector as floats."""
    return F.transform(_column(a), lambda x: x.cast("float"))


def sparse_inner_product(a: Column, b: Column) -> Column:
    """1 minus the product over shared indices of struct<indices, values> columns."""
    pairs = lambda other: F.zip_with(a["indices"], a["values"], lambda i, x: x.cast("double") * F.coalesce(F.try_element_at(other, i).cast("double"), F.lit(0.0)))
    return 1 - let(F.map_from_arrays(b["indices"], b["values"]), lambda other: _sum(pairs(other)))


def pack_int4(a, low_first: bool = True) -> Column:
    """Bytes of two values each, the even position in the low nibble (or the high one)."""

    def packed(v):
        nibble = lambda i: F.coalesce(F.get(v, i), F.lit(0)).cast("int").bitwiseAND(15)

        def byte(i):
            even, odd = nibble(2 * i), nibble(2 * i + 1)
            return even.bitwiseOR(F.shiftleft(odd, 4)) if low_first else F.shiftleft(even, 4).bitwiseOR(odd)

        signed = lambda b: F.when(b > 127, b - 256).otherwise(b).cast("tinyint")
        places = F.sequence(F.lit(0), F.floor((F.size(v) + 1) / 2).cast("int") - 1)
        return F.when(F.size(v) == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(F.transform(places, byte), signed))

    return let(_column(a), packed)


def unpack_int4(packed, dimension: int, low_first: bool = True) -> Column:
    """Signed values of `pack_int4`."""

    def unpacked(p):
        def nibble(i):
            b = F.get(p, F.floor(i / 2).cast("int")).cast("int").bitwiseAND(255)
            return F.when((i % 2 == 0) == F.lit(low_first), b.bitwiseAND(15)).otherwise(F.shiftright(b, 4))

        return F.transform(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), nibble), lambda n: F.when(n > 7, n - 16).otherwise(n).cast("tinyint"))

    return let(_column(packed), unpacked)


def half_to_float(a) -> Column:
    """Values of IEEE half-precision bit patterns."""

    def value(h):
        h = h.cast("int")
        sign = F.when(h.bitwiseAND(0x8000) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        exponent, fraction = F.shiftright(h, 10).bitwiseAND(31), h.bitwiseAND(1023)
        special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        size = F.when(exponent == 31, special).when(exponent == 0, fraction * F.lit(2.0**-24)).otherwise((1 + fraction / F.lit(1024.0)) * F.pow(F.lit(2.0), exponent - 15))
        return (sign * size).cast("float")

    return F.transform(_column(a), value)


def block_distances(metric: Metric, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distances of each query (row) to each vector (column)."""
    if metric == Metric.IP:
        d = 1 - queries @ vectors.T
    elif metric == Metric.COSINE:
        n = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((vectors**2).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(n == 0, 1.0, 1 - (queries @ vectors.T) / n)
    else:
        d = np.empty((len(queries), len(vectors)))
        for i, q in enumerate(queries):  # by differences: the expanded form loses digits
            diff = vectors - q
            d[i] = np.einsum("ij,ij->i", diff, diff)
    return np.where(np.isfinite(d), d, 1.0 if metric == Metric.COSINE else FLOAT_MAX)
