"""Vector quantizers.  Training is an aggregate; coding is a Column expression where it can be, else an Arrow function."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FailedPrecondition, InvalidArgument
from ..types import Metric, Quantize
from .vector import FLOAT_MAX, let, pack_int4, unpack_int4

ROTATION_SEED = 42


def random_rotation(dimension: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """An orthogonal matrix; the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def rotate(vector: Column, matrix: np.ndarray, inverse: bool = False) -> Column:
    m = (matrix.T if inverse else matrix).astype(np.float64)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else m @ np.asarray(x, np.float64))

    return run(vector)


def _clean(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


@dataclass
class _Scaled:
    """Codes of v / scale, clamped to [-1, 1], times LEVELS and cut toward zero."""

    dimension: int
    rotation: bool = False
    scales: list[float] = field(default_factory=list)
    LEVELS = 1

    def train(self, df: DataFrame, vector: str):
        """Scales are the largest size in each dimension (of the vectors as they are, rotated or not); 1 if that is 0."""
        rows = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.max(F.abs("x")).alias("m")).collect()
        most = {r.i: float(r.m) if r.m else 1.0 for r in rows}
        self.scales = [most.get(i, 1.0) for i in range(self.dimension)] if most else []
        return self

    def _scales(self) -> list[float]:
        return self.scales or [1.0] * self.dimension

    @property
    def turned(self) -> bool:
        return bool(self.rotation and self.scales)

    def _codes(self, vector: Column) -> Column:
        if self.turned:
            return self._turned_codes(vector)
        scales = F.array(*[F.lit(s) for s in self._scales()])
        return F.transform(vector, lambda x, i: (F.greatest(F.least(_clean(x) / F.coalesce(F.get(scales, i), F.lit(1.0)), F.lit(1.0)), F.lit(-1.0)) * self.LEVELS).cast("tinyint"))

    def _values(self, codes: Column) -> Column:
        if self.turned:
            return self._turned_values(codes)
        scales = F.array(*[F.lit(s) for s in self._scales()])
        return F.transform(codes, lambda c, i: c.cast("double") / self.LEVELS * F.coalesce(F.get(scales, i), F.lit(1.0)))

    def _turned_codes(self, vector: Column, pack=lambda c: c) -> Column:
        m, scales, levels = random_rotation(self.dimension), np.array(self.scales), self.LEVELS

        @F.pandas_udf("array<tinyint>")
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None else pack(np.trunc(np.clip(np.nan_to_num(m @ np.asarray(x, np.float64), nan=0, posinf=0, neginf=0) / scales, -1, 1) * levels).astype(np.int8)))

        return run(vector)

    def _turned_values(self, codes: Column, unpack=lambda c: c) -> Column:
        m, scales, levels = random_rotation(self.dimension), np.array(self.scales), self.LEVELS

        @F.pandas_udf("array<double>")
        def run(c: pd.Series) -> pd.Series:
            return c.map(lambda x: None if x is None else m.T @ (np.asarray(unpack(x), np.float64) / levels * scales))

        return run(codes)

    def save(self) -> str:
        return json.dumps({"dimension": self.dimension, "rotation": self.rotation, "scales": self.scales})

    @classmethod
    def load(cls, state: str):
        return cls(**json.loads(state))


class Int8(_Scaled):
    LEVELS = 127
    type = Quantize.INT8

    def code_size(self) -> int:
        return self.dimension

    def encode(self, vector: Column) -> Column:
        return self._codes(vector)

    def decode(self, codes: Column) -> Column:
        return self._values(codes)


def _pack_bytes(codes: np.ndarray, low_first: bool) -> np.ndarray:
    n = np.append(codes, [0] * (len(codes) % 2)).astype(np.uint8) & 15
    return (n[::2] | n[1::2] << 4 if low_first else n[::2] << 4 | n[1::2]).view(np.int8)


def _unpack_bytes(packed, dimension: int, low_first: bool) -> np.ndarray:
    b = np.asarray(packed, np.int8).view(np.uint8)
    pair = (b & 15, b >> 4) if low_first else (b >> 4, b & 15)
    n = np.stack(pair, axis=1).ravel()[:dimension].astype(np.int16)
    return np.where(n > 7, n - 16, n)


class Int4(_Scaled):
    """Two codes a byte, the even dimension in the high nibble (`low_first` for the other order)."""

    LEVELS = 7
    type = Quantize.INT4

    def code_size(self) -> int:
        return (self.dimension + 1) // 2

    def encode(self, vector: Column, low_first: bool = False) -> Column:
        if self.turned:
            return self._turned_codes(vector, lambda c: _pack_bytes(c, low_first))
        return pack_int4(self._codes(vector), low_first)

    def decode(self, packed: Column, low_first: bool = False) -> Column:
        if self.turned:
            return self._turned_values(packed, lambda b: _unpack_bytes(b, self.dimension, low_first))
        return self._values(unpack_int4(packed, self.dimension, low_first))

    def rounded(self, vector: Column) -> Column:
        """decode(encode(vector)) without the bytes between."""
        return self._values(self._codes(vector))


@dataclass
class RaBitQ:
    """Sign bits, lowest first, and the norm.  Decoding doesn't undo the rotation."""

    dimension: int
    rotation: bool = False
    type = Quantize.RABITQ

    def code_size(self) -> int:
        return (self.dimension + 7) // 8 + 4

    def train(self, df: DataFrame | None = None, vector: str = "") -> RaBitQ:
        return self

    def encode(self, vector: Column) -> Column:
        """struct<bits array<int>, norm float>, a number from 0 to 255 for each eight dimensions."""
        v = rotate(vector, random_rotation(self.dimension)) if self.rotation else vector

        def bits(v):
            bit = lambda b, j: F.when(F.coalesce(F.get(v, 8 * b + j), F.lit(-1.0)) >= 0, 1 << j).otherwise(0)
            return F.transform(F.sequence(F.lit(0), F.lit((self.dimension + 7) // 8 - 1)), lambda b: sum((bit(b, j) for j in range(1, 8)), bit(b, 0)).cast("int"))

        norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
        return F.struct(let(v, bits).alias("bits"), norm.cast("float").alias("norm"))

    def decode(self, code: Column) -> Column:
        scale = F.when(code["norm"] > 0, code["norm"].cast("double") / float(np.sqrt(self.dimension))).otherwise(1.0)
        on = lambda i: F.floor(F.get(code["bits"], F.floor(i / 8).cast("int")) / F.pow(F.lit(2.0), i % 8)) % 2 == 1
        return F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda i: F.when(on(i), scale).otherwise(-scale))


def _half_bits(x: np.ndarray) -> np.ndarray:
    """Half-precision patterns with the fraction cut off, values out of range to infinity, NaN and infinity to 0."""
    x = np.where(np.isfinite(x), x, 0).astype(np.float32)
    near = x.astype(np.float16)  # rounds to nearest; step back where that went away from zero
    with np.errstate(over="ignore"):
        away = np.isfinite(near) & (np.abs(near.astype(np.float64)) > np.abs(x.astype(np.float64)))
        bits = near.view(np.uint16) - away.astype(np.uint16)
    return np.where(np.isinf(near) & (np.abs(x) < 65536), np.uint16(0x7BFF) | (bits & 0x8000), bits).astype(np.uint16)


@dataclass
class Fp16:
    dimension: int = 0
    type = Quantize.FP16

    def code_size(self) -> int:
        """Bytes of one value."""
        return 2

    def train(self, df: DataFrame | None = None, vector: str = "") -> Fp16:
        return self

    def encode(self, vector: Column) -> Column:
        """Little-endian bytes."""

        @F.pandas_udf("binary")
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None else _half_bits(np.asarray(x, np.float64)).astype("<u2").tobytes())

        return run(vector)

    def decode(self, code: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype(np.float32))

        return run(code)


@dataclass
class ProductQuantizer:
    """A codebook for each of `parts` equal slices, by Lloyd's algorithm from the first vectors of the sample.

    The sample is the `sample_rows` vectors of least key; its size bounds what reaches the driver.
    """

    dimension: int
    parts: int
    metric: Metric = Metric.L2
    centroids: int = 256
    iterations: int = 20
    sample_rows: int = 20_000
    books: np.ndarray | None = None
    type = Quantize.PQ

    def __post_init__(self):
        if self.parts <= 0 or self.dimension % self.parts:
            raise InvalidArgument(f"{self.dimension} dimensions can't be cut into {self.parts} equal parts")

    def code_size(self) -> int:
        return self.parts

    def train(self, df: DataFrame, vector: str, key: str) -> ProductQuantizer:
        rows = df.select(key, vector).orderBy(key).limit(self.sample_rows).collect()
        if not rows:
            return self
        x = np.array([r[1] for r in rows], np.float64).reshape(len(rows), self.parts, -1)
        k = min(self.centroids, len(x))
        self.books = np.zeros((self.parts, k, x.shape[2]))
        for s in range(self.parts):
            data, c = x[:, s], x[:k, s].copy()
            at = np.full(len(data), -1)
            for _ in range(self.iterations):
                now = _nearest(data, c)
                if (now == at).all():
                    break
                at = now
                n = np.bincount(at, minlength=k)
                sums = np.zeros_like(c)
                np.add.at(sums, at, data)
                c[n > 0] = sums[n > 0] / n[n > 0, None]
            self.books[s] = c
        return self

    def _books(self) -> np.ndarray:
        if self.books is None:
            raise FailedPrecondition("the product quantizer isn't trained")
        return self.books

    def encode(self, vector: Column) -> Column:
        books = self._books()

        @F.pandas_udf("array<int>")
        def run(v: pd.Series) -> pd.Series:
            if not len(v):
                return v
            x = np.stack(v.to_numpy()).astype(np.float64).reshape(len(v), len(books), -1)
            return pd.Series(list(np.stack([_nearest(x[:, s], b) for s, b in enumerate(books)], axis=1).astype(np.int32)))

        return run(vector)

    def decode(self, codes: Column) -> Column:
        books = self._books()

        @F.pandas_udf("array<double>")
        def run(c: pd.Series) -> pd.Series:
            return c.map(lambda x: np.concatenate([books[s, j] for s, j in enumerate(x)]))

        return run(codes)

    def asymmetric_distance(self, query: list[float], codes: Column) -> Column:
        """Distance of an exact query to coded vectors: a table lookup for each part."""
        q = np.asarray(query, np.float64).reshape(self.parts, -1)
        books = self._books()
        product = self.metric in (Metric.IP, Metric.COSINE)
        tables = [b @ q[s] if product else ((b - q[s]) ** 2).sum(1) for s, b in enumerate(books)]
        total = F.lit(0.0)
        for s, table in enumerate(tables):
            total = total + F.get(F.array(*[F.lit(float(t)) for t in table]), F.get(codes, s))
        return 1 - total if product else F.least(total, F.lit(FLOAT_MAX))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if len(x) * len(c) * c.shape[1] < 20_000_000 else np.concatenate([_nearest(x[i : i + 512], c) for i in range(0, len(x), 512)])


def quantizer(kind: Quantize, dimension: int, **kw):
    made = {Quantize.FP16: Fp16, Quantize.INT8: Int8, Quantize.INT4: Int4, Quantize.RABITQ: RaBitQ, Quantize.PQ: ProductQuantizer}.get(kind)
    if made is None:
        raise InvalidArgument(f"no quantizer of type {kind!r}")
    return made(dimension, **kw)
