import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.errors import InvalidArgument
from stratavec.functions import quantizers as Q
from stratavec.functions import text as X
from stratavec.functions import vector as V
from stratavec.functions.filters import MetadataFilter, compile_filter, parse
from stratavec.types import Metric


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("metric", "a", "b", "expected"),
    [
        (Metric.L2, [0, 0, 0], [3, 4, 0], 25), (Metric.MIPSL2, [3, 4], [0, 0], 25), (Metric.IP, [1, 0], [0, 1], 1), (Metric.IP, [2, 3], [4, 5], -22),
        (Metric.COSINE, [1, 0], [0, 1], 1), (Metric.COSINE, [1, 2], [1, 2], 0), (Metric.COSINE, [1, 0], [-1, 0], 2), (Metric.COSINE, [0, 0], [1, 1], 1),
    ],
)
def test_distances(spark, metric, a, b, expected):
    assert one(spark, V.distance(metric, a, b)) == pytest.approx(expected, abs=1e-9)
    assert V.block_distances(metric, np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(expected, abs=1e-9)


def test_l2_and_score(spark):
    assert one(spark, V.l2([3, 4], [0, 0])) == 5
    assert one(spark, V.score(F.lit(1.0))) == 0.5
    assert one(spark, V.score(F.lit(-1.0))) == float("inf")


def test_not_finite(spark):
    assert one(spark, V.l2_squared([float("nan")], [0])) == pytest.approx(V.FLOAT_MAX)
    assert one(spark, V.inner_product([float("inf")], [1])) == pytest.approx(V.FLOAT_MAX)


def test_normalize(spark):
    assert one(spark, V.normalize([3, 4])) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize([0, 0])) == [0, 0]


@pytest.mark.parametrize(("a", "b", "expected"), [(({0: 1, 2: 2, 5: 3}), ({0: 4, 1: 5, 5: 6}), -21), ({0: 1}, {1: 1}, 1)])
def test_sparse(spark, a, b, expected):
    col = lambda m: F.struct(F.array(*[F.lit(i) for i in m]).alias("indices"), F.array(*[F.lit(float(v)) for v in m.values()]).alias("values"))
    assert one(spark, V.sparse_inner_product(col(a), col(b))) == expected


def test_int4_orders(spark):
    v = F.array(*[F.lit(x) for x in (1, -2, 7, -8, 3)])
    assert one(spark, V.unpack_int4(V.pack_int4(v), 5)) == [1, -2, 7, -8, 3]
    assert [b & 255 for b in one(spark, V.pack_int4(v))] == [0xE1, 0x87, 0x03]
    assert [b & 255 for b in one(spark, V.pack_int4(v, low_first=False))] == [0x1E, 0x78, 0x30]


def test_half_to_float(spark):
    x = np.array([1.5, -2, 0, 65504, 6e-8], np.float16)
    assert one(spark, V.half_to_float(F.array(*[F.lit(int(i)) for i in x.view(np.uint16)]))) == pytest.approx(x.astype(float).tolist())


SCHEMA = T.StructType([T.StructField("age", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("x", T.DoubleType())])
ROWS = [(35, "anna", True, 1.5), (25, "bo*b", False, float("nan")), (None, None, None, None), (0, "", True, 0.0)]
CASES = {
    "": [0, 1, 2, 3], "age >= 30": [0], "age < 30": [1, 3], "age = 35": [0], "age != 35": [1, 3], "name == anna": [0], "name != anna": [1, 3], "name = ": [3], "age IS_NULL": [2], "age IS_NOT_NULL": [0, 1, 3],
    "name LIKE a*a": [0], "name LIKE bo?b": [1], "name LIKE *": [0, 1, 3], "name HAS_PREFIX bo": [1], "name HAS_SUFFIX a": [0], "name CONTAIN_ALL a, n": [0], "name CONTAIN_ANY o,n": [0, 1],
    "name NOT_CONTAIN_ALL a,n": [1, 3], "name NOT_CONTAIN_ANY a,o": [3], "no operator here": [0, 1, 2, 3], "missing == 1": [], "age > text": [], "ok == true": [], "ok == 0": [0, 1, 3], "name < 5": [0, 1, 3],
    "x >= 0": [0, 3], "x != 1.5": [1, 3], "age != 3>2": [], 'name == "anna"': [],
}


@pytest.mark.parametrize("text", CASES)
def test_filter(spark, text):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], T.StructType([T.StructField("i", T.IntegerType()), *SCHEMA.fields]))
    assert sorted(r.i for r in df.where(compile_filter(text, df.schema)).collect()) == CASES[text]


def test_parse_order():
    assert (parse("a!=b>c").op, parse("a!=b>c").field) == (">", "a!=b")
    assert parse("f CONTAIN_ANY LIKE x").op == "CONTAIN_ANY"


META = [
    (MetadataFilter().eq("name", "anna"), [0]), (MetadataFilter().is_in("name", ["anna", "x"]), [0]), (MetadataFilter().int_eq("age", 25), [1]), (MetadataFilter().int_in("age", [0, 35]), [0, 3]), (MetadataFilter().bool_eq("ok", True), [0, 3]),
    (MetadataFilter().int_gt("age", 0), [0, 1]), (MetadataFilter().int_lt("age", 25), [3]), (MetadataFilter().int_gte("age", 25), [0, 1]), (MetadataFilter().int_lte("age", 25), [1, 3]), (MetadataFilter().int_ne("age", 25), [0, 3]),
    (MetadataFilter().exists("name"), [0, 1]), (MetadataFilter().eq("name", "anna").int_gt("age", 40), []), (MetadataFilter(strict=True).int_eq("age", 25), []), (MetadataFilter(strict=True).exists("x"), []), (MetadataFilter(), [0, 1, 2, 3]), (MetadataFilter().eq("none", "x"), []),
]


@pytest.mark.parametrize("n", range(len(META)))
def test_metadata(spark, n):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], T.StructType([T.StructField("i", T.IntegerType()), *SCHEMA.fields]))
    where, expected = META[n]
    assert sorted(r.i for r in df.where(where.column(df.schema)).collect()) == expected


def test_tokenizers(spark):
    assert one(spark, X.standard(F.lit("Hello World! This is a Test."))) == ["hello", "world", "this", "is", "a", "test"]
    assert one(spark, X.whitespace(F.lit("  Hello   world foo "))) == ["Hello", "world", "foo"]
    assert one(spark, X.tokenizer("whitespace", ("lowercase",))(F.lit("A b"))) == ["a", "b"]
    assert one(spark, X.longest_match()(F.lit("我们搜索数据库ab1!"))) == ["我们", "搜索", "数据库", "a", "b", "1"]
    assert one(spark, X.longest_match(["数据", "据库存储"])(F.lit("数据库存储"))) == ["数据", "库", "存", "储"]


def test_longest_match_holds_tokens_of_few_texts_at_a_time(spark, monkeypatch):
    texts = ["我们搜索", None, "", "ab 1!", "x" * 50, "数据库"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    monkeypatch.setattr(X, "SLICE", 8)  # read here and sent along where it is a worker's own
    expected = [["我们", "搜索"], None, [], ["a", "b", "1"], ["x"] * 50, ["数据库"]]
    assert [r.w for r in df.select("i", X.longest_match()(F.col("t")).alias("w")).orderBy("i").collect()] == expected
    slices = list(X.longest_match().func(iter([pa.array(texts)])))
    assert len(slices) > 3 and [x for s in slices for x in s.to_pylist()] == expected


def vectors(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, v array<float>")


def test_int8_and_int4(spark):
    df = vectors(spark, [[0.5, -0.3, 1.0, -1.0], [0.1, 0.2, -0.5, 0.25]])
    for kind, most in ((Q.Int8, 0.1), (Q.Int4, 0.2)):
        q = kind.load(kind(4).train(df, "v").save())
        for r in df.select("v", q.decode(q.encode(F.col("v"))).alias("d")).collect():
            assert np.abs(np.array(r.v) - r.d).max() <= most
        turned = kind(4, rotation=True).train(df, "v")
        assert all(len(r.d) == 4 for r in df.select(turned.decode(turned.encode(F.col("v"))).alias("d")).collect())
    assert (Q.Int8(4).code_size(), Q.Int4(5).code_size(), Q.RaBitQ(9).code_size(), Q.Fp16().code_size()) == (4, 3, 6, 2)


def test_rabitq(spark):
    q = Q.RaBitQ(4)
    r = vectors(spark, [[3.0, -4.0, 0.0, 0.0]]).select(q.encode(F.col("v")).alias("c")).select("c", q.decode(F.col("c")).alias("d")).first()
    assert (list(r.c.bits), r.c.norm, r.d) == ([0b1101], 5.0, [2.5, -2.5, 2.5, 2.5])


def test_fp16_cuts_off(spark):
    q = Q.Fp16()
    rows = [[1.5, -2.0, 0.0, 3.14159], [1 + 2**-11 + 2**-12, 70000.0, float("nan"), -65519.0]]
    got = [r.d for r in vectors(spark, rows).select("id", q.decode(q.encode(F.col("v"))).alias("d")).orderBy("id").collect()]
    assert got[0] == pytest.approx(rows[0], abs=0.01)
    assert got[1] == [1.0, float("inf"), 0.0, -65504.0]


def test_product_quantizer(spark):
    rng = np.random.default_rng(1)
    rows = (rng.integers(0, 4, (200, 1)) * 10 + rng.normal(0, 0.1, (200, 8))).tolist()
    df = vectors(spark, rows)
    q = Q.ProductQuantizer(8, 4, centroids=16).train(df, "v", "id")
    out = df.select("v", q.encode(F.col("v")).alias("c")).select("v", q.decode(F.col("c")).alias("d"), q.asymmetric_distance(rows[0], F.col("c")).alias("a")).collect()
    assert max(np.abs(np.array(r.v) - r.d).max() for r in out) < 1
    for r in out[:20]:
        assert r.a == pytest.approx(((np.array(rows[0]) - r.d) ** 2).sum(), rel=1e-5)
    with pytest.raises(InvalidArgument):
        Q.ProductQuantizer(5, 4)


def test_rotation_is_orthogonal():
    m = Q.random_rotation(6)
    assert np.allclose(m @ m.T, np.eye(6)) and np.array_equal(m, Q.random_rotation(6))
    assert json.loads(Q.Int8(3).save())["dimension"] == 3
