"""Enumerations and index parameters.  Codes are fixed values."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields
from enum import IntEnum

from pyspark.sql import types as T


class DataType(IntEnum):
    UNDEFINED = 0
    BINARY = 1
    STRING = 2
    BOOL = 3
    INT32 = 4
    INT64 = 5
    UINT32 = 6
    UINT64 = 7
    FLOAT = 8
    DOUBLE = 9
    VECTOR_BINARY32 = 20
    VECTOR_BINARY64 = 21
    VECTOR_FP16 = 22
    VECTOR_FP32 = 23
    VECTOR_FP64 = 24
    VECTOR_INT4 = 25
    VECTOR_INT8 = 26
    VECTOR_INT16 = 27
    SPARSE_VECTOR_FP16 = 30
    SPARSE_VECTOR_FP32 = 31
    ARRAY_BINARY = 40
    ARRAY_STRING = 41
    ARRAY_BOOL = 42
    ARRAY_INT32 = 43
    ARRAY_INT64 = 44
    ARRAY_UINT32 = 45
    ARRAY_UINT64 = 46
    ARRAY_FLOAT = 47
    ARRAY_DOUBLE = 48

    @property
    def is_dense_vector(self) -> bool:
        return 20 <= self <= 27

    @property
    def is_sparse_vector(self) -> bool:
        return self in (30, 31)

    @property
    def is_vector(self) -> bool:
        return self.is_dense_vector or self.is_sparse_vector

    @property
    def is_array(self) -> bool:
        return 40 <= self <= 48

    @property
    def is_scalar(self) -> bool:
        return 1 <= self <= 9

    @property
    def element(self) -> DataType:
        """Element type of an array type."""
        return DataType(self - 39) if self.is_array else DataType.UNDEFINED


SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType(), False)), T.StructField("values", T.ArrayType(T.FloatType(), False))])

_SCALARS = {
    DataType.BINARY: T.BinaryType(), DataType.STRING: T.StringType(), DataType.BOOL: T.BooleanType(), DataType.INT32: T.IntegerType(), DataType.INT64: T.LongType(),
    DataType.UINT32: T.LongType(), DataType.UINT64: T.DecimalType(20, 0), DataType.FLOAT: T.FloatType(), DataType.DOUBLE: T.DoubleType(),
}
_VECTORS = {
    DataType.VECTOR_BINARY32: T.IntegerType(), DataType.VECTOR_BINARY64: T.LongType(), DataType.VECTOR_FP16: T.FloatType(), DataType.VECTOR_FP32: T.FloatType(),
    DataType.VECTOR_FP64: T.DoubleType(), DataType.VECTOR_INT4: T.ByteType(), DataType.VECTOR_INT8: T.ByteType(), DataType.VECTOR_INT16: T.ShortType(),
}


def spark_type(kind: DataType) -> T.DataType:
    if kind in _SCALARS:
        return _SCALARS[kind]
    if kind in _VECTORS:
        return T.ArrayType(_VECTORS[kind], containsNull=False)
    if kind.is_sparse_vector:
        return SPARSE
    if kind.is_array:
        return T.ArrayType(_SCALARS[kind.element])
    return T.NullType()


class Metric(IntEnum):
    UNDEFINED = 0
    L2 = 1
    IP = 2
    COSINE = 3
    MIPSL2 = 4


class IndexType(IntEnum):
    UNDEFINED = 0
    HNSW = 1
    IVF = 2
    FLAT = 3
    HNSW_RABITQ = 4
    DISKANN = 5
    VAMANA = 6
    INVERT = 10
    FTS = 11


class Quantize(IntEnum):
    UNDEFINED = 0
    FP16 = 1
    INT8 = 2
    INT4 = 3
    RABITQ = 4
    PQ = 5


class DocOp(IntEnum):
    INSERT = 0
    UPSERT = 1
    UPDATE = 2
    DELETE = 3


class CompareOp(IntEnum):
    EQ = 0
    NE = 1
    LT = 2
    LE = 3
    GT = 4
    GE = 5
    LIKE = 6
    CONTAIN_ALL = 7
    CONTAIN_ANY = 8
    NOT_CONTAIN_ALL = 9
    NOT_CONTAIN_ANY = 10
    IS_NULL = 11
    IS_NOT_NULL = 12
    HAS_PREFIX = 13
    HAS_SUFFIX = 14


class MetadataOp(IntEnum):
    EQ = 1
    IN = 2
    NE = 3
    GT = 4
    LT = 5
    GTE = 6
    LTE = 7
    EXISTS = 8


class RerankType(IntEnum):
    RRF = 0
    WEIGHTED = 1
    CALLBACK = 2


@dataclass
class IndexParams:
    """Strategy of a field.  Parameters that only steer a graph's build are kept as metadata."""

    metric: Metric = Metric.COSINE
    quantize: Quantize = Quantize.UNDEFINED
    rotate: bool = False
    TYPE = IndexType.UNDEFINED
    #: Accepted, without effect on an exact scan.
    UNUSED = ("quantize", "rotate")

    def __post_init__(self):
        for f in fields(self):
            if f.name in self.UNUSED and getattr(self, f.name) != f.default:
                warnings.warn(f"{type(self).__name__}.{f.name} has no effect", stacklevel=3)

    def to_json(self) -> dict:
        return {"type": self.TYPE.name, **{f.name: int(v) if isinstance(v := getattr(self, f.name), IntEnum) else v for f in fields(self)}}

    @staticmethod
    def from_json(x: dict | None) -> IndexParams | None:
        if not x:
            return None
        kind = next(k for k in KINDS if k.TYPE.name == x["type"])
        own = {k: v for k, v in x.items() if k != "type"}
        own |= {k: e(own[k]) for k, e in (("metric", Metric), ("quantize", Quantize)) if k in own}
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return kind(**own)


@dataclass
class FlatParams(IndexParams):
    major_order: str = ""
    TYPE = IndexType.FLAT
    UNUSED = ("quantize", "rotate", "major_order")


@dataclass
class HnswParams(IndexParams):
    m: int = 50
    ef_construction: int = 500
    contiguous_memory: bool = False
    TYPE = IndexType.HNSW
    UNUSED = ("quantize", "rotate", "contiguous_memory")


@dataclass
class IvfParams(IndexParams):
    n_list: int = 10
    n_iters: int = 20
    use_soar: bool = False
    TYPE = IndexType.IVF
    UNUSED = ("quantize", "rotate", "use_soar")


@dataclass
class HnswRabitqParams(IndexParams):
    m: int = 50
    ef_construction: int = 500
    total_bits: int = 4
    num_clusters: int = 0
    sample_count: int = 0
    TYPE = IndexType.HNSW_RABITQ
    UNUSED = ("quantize", "rotate", "total_bits", "num_clusters", "sample_count")


@dataclass
class DiskAnnParams(IndexParams):
    max_degree: int = 64
    list_size: int = 100
    pq_chunks: int = 0
    alpha: float = 1.2
    TYPE = IndexType.DISKANN
    UNUSED = ("quantize", "rotate", "pq_chunks")


@dataclass
class VamanaParams(IndexParams):
    max_degree: int = 64
    search_list: int = 100
    alpha: float = 1.2
    saturate: bool = False
    contiguous_memory: bool = False
    TYPE = IndexType.VAMANA
    UNUSED = ("quantize", "rotate", "contiguous_memory")


@dataclass
class InvertParams(IndexParams):
    range_optimization: bool = False
    extended_wildcard: bool = False
    TYPE = IndexType.INVERT


@dataclass
class FtsParams(IndexParams):
    tokenizer: str = "standard"
    filters: tuple = ()
    extra: str = ""
    TYPE = IndexType.FTS
    UNUSED = ("quantize", "rotate", "extra")


KINDS = (FlatParams, HnswParams, IvfParams, HnswRabitqParams, DiskAnnParams, VamanaParams, InvertParams, FtsParams)
