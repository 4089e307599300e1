import numpy as np
import pytest
from pyspark.sql import functions as F

import stratavec
from stratavec import Collection, CollectionSchema, Config, Field, Options, Route
from stratavec.errors import AlreadyExists, Code, FailedPrecondition, InvalidArgument, NotFound, PermissionDenied, Unavailable
from stratavec.functions.filters import MetadataFilter
from stratavec.operators import fts, fusion
from stratavec.sources.files import Folder
from stratavec.streaming.changelog import apply_batch
from stratavec.types import DataType, FlatParams, FtsParams, HnswParams, HnswRabitqParams, IndexType, IvfParams, Metric, RerankType

SCHEMA = CollectionSchema("c", [
    Field("title", DataType.STRING, True, 0, FtsParams()), Field("age", DataType.INT32, True), Field("v", DataType.VECTOR_FP32, False, 2, FlatParams(Metric.L2)), Field("w", DataType.VECTOR_FP32, True, 2, FlatParams(Metric.L2)),
])
DOCS = [
    {"id": "a", "title": "quick brown fox", "age": 20, "v": [1.0, 0.0], "w": [0.0, 1.0]},
    {"id": "b", "title": "lazy dog", "age": None, "v": [0.0, 1.0], "w": [1.0, 0.0]},
    {"id": "c", "title": "brown bear and quick dog", "age": 22, "v": [1.0, 1.0]},
]


@pytest.fixture
def made(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/c", SCHEMA, Options(segment_size=2))
    c.insert(DOCS)
    return c


def ids(df):
    return [r.id for r in df.collect()]


def test_insert_checks_the_whole_batch(made):
    with pytest.raises(InvalidArgument):
        made.insert([{"id": "d", "v": [0.0, 0.0]}, {"id": "e", "v": [1.0]}])
    with pytest.raises(InvalidArgument):
        made.insert([{"id": "", "v": [0.0, 0.0]}])
    with pytest.raises(InvalidArgument):
        made.insert([{"id": "x", "title": "no vector"}])
    with pytest.raises(InvalidArgument):
        made.insert([{"id": "a", "v": [0.0, 0.0]}, {"id": "z", "v": [0.0, 0.0]}])
    with pytest.raises(AlreadyExists):
        made.insert([{"id": "y", "v": [0.0, 0.0]}, {"id": "y", "v": [0.0, 0.0]}])
    assert made.count() == 3
    assert {r.id: r.doc_id for r in made.docs().collect()} == {"a": 1, "b": 2, "c": 3}


def test_upsert_update_delete_and_reopen(spark, made):
    made.upsert([{"id": "b", "title": "new", "v": [100.0, 0.0]}, {"id": "d", "v": [5.0, 5.0]}])
    assert {r.id: r.doc_id for r in made.docs().collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert ids(made.query(Route("v", [100.0, 0.0]), 1)) == ["b"]
    with pytest.raises(NotFound):
        made.update([{"id": "nobody", "v": [0.0, 0.0]}])
    made.update([{"id": "a", "v": [7.0, 7.0]}])
    assert made.fetch(["a"]).first().title is None  # whole documents, not patches
    assert made.delete(["d", "unknown"]) == 1
    again = Collection.open(spark, made.path)
    assert sorted(ids(again.docs())) == ["a", "b", "c"]
    again.snapshot()
    assert again.changes().count() == 0 and again.count() == 3
    again.insert([{"id": "e", "v": [0.0, 0.0]}])
    assert {r.id: r.doc_id for r in Collection.load(spark, made.path).docs().collect()}["e"] == 5
    with pytest.raises(AlreadyExists):
        Collection.create(spark, made.path, SCHEMA)


def test_delete_by_filter(made):
    with pytest.raises(InvalidArgument):
        made.delete_by_filter("everything")
    assert made.delete_by_filter("age >= 22") == 1
    assert made.delete_by_filter(MetadataFilter().eq("title", "lazy dog")) == 1
    assert ids(made.docs()) == ["a"]


def test_null_and_absent(made):
    assert ids(made.matching("age IS_NULL")) == ["b"]
    assert ids(made.matching("w IS_NULL")) == []  # c had no such field
    assert sorted(ids(made.matching("w IS_NOT_NULL"))) == ["a", "b"]


def test_schema_changes(spark, made):
    made.add_column(Field("twice", DataType.INT64, True), "age * 2")
    assert {r.id: r.twice for r in made.docs().collect()} == {"a": 40, "b": None, "c": 44}
    made.alter_column("twice", "double_age", Field("double_age", DataType.DOUBLE, True))
    with pytest.raises(AlreadyExists):
        made.alter_column("age", "title")
    with pytest.raises(NotFound):
        made.drop_column("nothing")
    made.drop_column("double_age")
    assert Collection.open(spark, made.path).schema.names() == ["title", "age", "v", "w"]
    assert CollectionSchema.from_json(made.schema.to_json()) == made.schema


def test_vector_queries(made):
    found = made.query(Route("v", [1.0, 0.1]), 2, output_fields=["title"], include_doc_id=True).collect()
    assert [r.id for r in found] == ["a", "c"] and found[0].doc_id == 1 and found[0].title == "quick brown fox"
    assert ids(made.query(Route("v", [1.0, 0.0]), 5, where="title == lazy dog")) == ["b"]
    assert ids(made.query(Route("v", [1.0, 0.0]), 5, meta=MetadataFilter().int_gt("age", 20))) == ["c"]
    assert ids(made.query(Route("v", [1.0, 0.0]), 5, radius=0.5)) == ["a"]
    assert [(r.qid, r.id) for r in made.batch_query("v", [[1.0, 0.0], [0.0, 1.0]], 1).orderBy("qid").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(InvalidArgument):
        made.query(Route("v", [1.0]), 1)
    with pytest.raises(InvalidArgument):
        made.query(Route("v", [1.0, 0.0]), 0)
    with pytest.raises(NotFound):
        made.query(Route("nothing", [1.0, 0.0]), 1)


def test_group_by(made):
    rows = made.group_by(Route("v", [1.0, 0.0]), "age", 2, 1).collect()
    assert [(r.group_value, r.id) for r in rows] == [("20", "a"), ("22", "c")]
    assert [r.group_value for r in made.group_by(Route("v", [1.0, 0.0]), "age", 0, 1).collect()] == ["20", "22", "<nil>"]
    assert made.group_by(Route("v", [1.0, 0.0]), "age", 0, 0).count() == 0


def test_multi_and_hybrid(made):
    both = [Route("v", [1.0, 0.0]), Route("w", [1.0, 0.0])]
    assert set(ids(made.multi_query(both, 2))) <= {"a", "b", "c"}
    assert ids(made.multi_query(both[:1], 5, where="title == lazy dog")) == ["b"]
    assert ids(made.hybrid_query("v", [1.0, 0.0], "title", "quick", 1)) == ["a"]
    assert ids(made.multi_query([Route("v", [1.0, 0.0])], 1, rerank=RerankType.WEIGHTED, weights=[0.5])) == ["a"]
    assert ids(made.multi_query([Route("nothing", [1.0])], 1)) == []
    assert ids(made.multi_query([Route("title", text="dog")], 5, where="age >= 1", filter_text=True)) == ["c"]


def test_indexes(spark, made):
    made.create_index("v", IvfParams(Metric.L2, n_list=2))
    made.optimize()
    assert ids(made.query(Route("v", [1.0, 0.0]), 3, nprobe=2)) == ["a", "c", "b"]
    made.upsert([{"id": "z", "v": [1.0, 0.0]}])  # cells are older than the log: the exact scan serves
    assert ids(made.query(Route("v", [1.0, 0.0]), 2)) == ["a", "z"]
    made.create_index("v", HnswRabitqParams(Metric.COSINE))
    assert ids(made.query(Route("v", [1.0, 0.0]), 1, refine=3)) == ["a"]
    made.drop_index("v")
    made.drop_index("v")
    assert made.metric("v") == Metric.COSINE
    with pytest.raises(InvalidArgument):
        made.create_index("age", FtsParams())
    assert made.schema.with_index(IndexType.FTS)[0].name == "title"


def test_full_text(made):
    assert sorted(ids(made.query(Route("title", text="quick brown"), 5))) == ["a", "c"]
    assert ids(made.fts_query("title", "quick bear", 5, "and")) == ["c"]
    assert sorted(ids(made.fts_query("title", "lazy fox", 5, "or"))) == ["a", "b"]
    assert ids(made.fts_query("title", '"brown fox"', 5, "advanced")) == ["a"]
    assert ids(made.fts_query("title", "quick NOT bear", 5, "advanced")) == ["a"]
    assert ids(made.fts_query("title", "NOT quick", 5, "advanced")) == ["b"]
    with pytest.raises(NotFound):
        made.fts_query("age", "x", 1)


def test_grammar():
    term = lambda t: fts.Node("term", t)
    assert fts.parse("a OR b AND c") == fts.Node("or", children=(term("a"), fts.Node("and", children=(term("b"), term("c")))))
    assert fts.parse("a and b not c") == fts.Node("not", children=(fts.Node("and", children=(term("a"), term("b"))), term("c")))
    assert fts.parse("hello world") == term("hello")
    assert fts.parse('(a or "b c") NOT d').children[0].children[1] == fts.Node("phrase", "b c")
    assert fts.parse("") is None


def test_fusion(spark):
    lists = [fusion.ranked(spark.createDataFrame(x, "id string, score double"), i) for i, x in enumerate([[("a", 3.0), ("b", 2.0), ("c", 1.0)], [("b", 3.0), ("d", 2.0), ("a", 1.0)]])]
    rows = fusion.rrf(lists, 10).collect()
    assert [r.key for r in rows] == ["b", "a", "d", "c"] and rows[0].score == pytest.approx(1 / 62 + 1 / 61)
    two = [fusion.ranked(spark.createDataFrame(x, "id string, score double"), i) for i, x in enumerate([[("a", 0.9), ("b", 0.8)], [("b", 0.1), ("c", 0.9)]])]
    assert {r.key: round(r.score, 6) for r in fusion.weighted(two, [0.7, 0.3], 10).collect()} == {"a": 0.7, "c": 0.3, "b": 0.0}


def test_read_only_and_closed(spark, made):
    ro = Collection.open(spark, made.path, Options(read_only=True))
    with pytest.raises(PermissionDenied) as e:
        ro.delete(["a"])
    assert e.value.code == Code.PERMISSION_DENIED
    ro.close()
    with pytest.raises(FailedPrecondition):
        ro.docs()


def test_segments_stats_compact(made, tmp_path):
    assert sorted((r.segment_id, r.doc_count) for r in made.segments().collect()) == [(0, 2), (1, 1)]
    assert made.stats()["doc_count"] == 3 and made.stats()["fields"] == {"v": 24, "w": 16}
    made.compact()
    assert made.count() == 3
    assert {r.value: r.doc_count for r in made.field_values("age").collect()} == {20: 1, 22: 1}
    made.destroy()
    with pytest.raises(NotFound):
        Collection.open(made.spark, made.path)


def test_batch_build_and_json(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/b", CollectionSchema("b", [Field("v", DataType.VECTOR_FP32, True, 2, HnswParams(Metric.L2))]))
    assert c.batch_build("v", [[1.0, 0.0], [0.0, 1.0]], ["x"]) == 2
    assert sorted(ids(c.docs())) == ["d1", "x"]
    c.export_json(f"file://{tmp_path}/json")
    assert sorted(ids(Collection.from_json(spark, f"file://{tmp_path}/json", "id", c.schema).docs())) == ["d1", "x"]


def test_changes_by_batch(made):
    rows = [("upsert", "n", 1, [1.0, 1.0]), ("delete", "n", 2, None), ("upsert", "m", 1, [2.0, 2.0]), ("delete", "a", 1, None)]
    batch = made.spark.createDataFrame(rows, "op string, id string, seq int, v array<float>")
    for _ in range(2):  # delivered twice
        apply_batch(made, batch)
    assert sorted(ids(made.docs())) == ["b", "c", "m"]


def test_session():
    with pytest.raises(InvalidArgument):
        stratavec.init(Config(brute_force_by_keys_ratio=2))
    assert not stratavec.is_initialized()
    stratavec.init(Config(log_level="error"))
    with pytest.raises(FailedPrecondition):
        stratavec.init()
    stratavec.shutdown()
    assert stratavec.version()


def test_many_documents_keep_gapless_ids(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/n", CollectionSchema("n", [Field("x", DataType.INT64, True)]))
    c.insert(spark.range(1000).repartition(7).select(F.col("id").cast("string").alias("id"), F.col("id").alias("x")))
    assert sorted(r.doc_id for r in c.docs().collect()) == list(range(1, 1001))


def test_small_files_survive_a_crash_and_refuse_a_second_writer(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}")
    folder.write("CURRENT", {"n": 1})
    folder.write("CURRENT", {"n": 2})
    (tmp_path / "CURRENT.000000000003").write_text('{"n": ')  # a writer died here
    other = Folder(spark, f"file://{tmp_path}")
    assert other.read("CURRENT") == {"n": 2} and folder.read("CURRENT") == {"n": 2}
    other.write("CURRENT", {"n": 3})
    with pytest.raises(Unavailable):
        folder.write("CURRENT", {"n": 4})
    assert folder.read("CURRENT") == {"n": 3}
    folder.write("CURRENT", {"n": 4})
    assert other.read("CURRENT") == {"n": 4}


def test_a_write_that_died_before_its_pointer_does_not_count(spark, tmp_path):
    schema = CollectionSchema("c", [Field("age", DataType.INT32, True)])
    c = Collection.create(spark, f"file://{tmp_path}/c", schema)
    c.insert([{"id": "a", "age": 1}])
    write = c.folder.write
    c.folder.write = lambda *_: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        c.upsert([{"id": "a", "age": 2}, {"id": "b", "age": 3}])
    c.folder.write = write
    again = Collection.open(spark, f"file://{tmp_path}/c")
    assert [(r.id, r.age) for r in again.rows().collect()] == [("a", 1)]
    again.upsert([{"id": "b", "age": 4}])
    assert sorted((r.id, r.age) for r in again.rows().collect()) == [("a", 1), ("b", 4)]


def test_cells_follow_writes_and_schema_changes(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((200, 4)).astype(np.float32).tolist()
    c = Collection.create(spark, f"file://{tmp_path}/c", CollectionSchema("c", [Field("n", DataType.INT32, True), Field("v", DataType.VECTOR_FP32, False, 4, IvfParams(Metric.L2, n_list=6))]))
    c.upsert([{"id": f"d{i}", "n": i, "v": x} for i, x in enumerate(v)])
    c.optimize()
    index, _ = c._cells("v")
    assert 0.95 <= index.recall <= 1

    def same(**kw):
        q = [0.1, 0.2, 0.3, 0.4]
        got = [r.id for r in c.query(Route("v", q), 8, nprobe=6, **kw).collect()]
        assert got == [r.id for r in c.query(Route("v", q), 8, exact=True, **kw).collect()]
        return got

    first = same()[0]
    c.delete([first])
    c.upsert([{"id": "new", "n": 7, "v": [0.1, 0.2, 0.3, 0.4]}, {"id": "d5", "n": 5, "v": [9.0, 9.0, 9.0, 9.0]}])
    assert c._cells("v") and same()[0] == "new" and first not in same()
    assert 0 < len(same(radius=0.5)) < 8
    c.add_column(Field("more", DataType.INT32, True), "n + 1")
    assert c._cells("v") and same(where="more >= 100")
    c.snapshot()
    assert c._cells("v") and same()[0] == "new"
    c.alter_column("more", "other")
    assert c._cells("v") and same(where="other >= 100")
