"""Collections: documents under a schema, with a change log, snapshots and searches.

    <path>/schema.json     schema, options
    <path>/CURRENT         snapshot version, epoch of the change log, last LSN, next doc id (numbered files, see Folder)
    <path>/snapshots/v<n>  documents (Parquet)
    <path>/changes/e<n>/<first LSN>  one folder a write: (lsn, op, id, doc_id, fields)
    <path>/index/<field>   centroids and cells of an IVF field

The state is the snapshot without changed ids, and the last change of each
changed id.  Writes check the whole batch first and append one folder, so they
are all or nothing: a folder counts once CURRENT names its LSNs.  Indexes are
plans over the state, so they are never behind it; the cells of an IVF field are
read together with what was changed after they were written.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, PermissionDenied
from ..functions.filters import PRESENT, MetadataFilter, as_condition, compile_filter, parse
from ..operators import fts, fusion, search
from ..operators.ivf import IvfIndex
from ..schema import CollectionSchema, Field
from ..types import DataType, DocOp, FtsParams, HnswRabitqParams, IndexParams, IndexType, IvfParams, Metric, RerankType
from .files import Folder


@dataclass
class Options:
    read_only: bool = False
    segment_size: int = 0
    #: Files of a compacted snapshot; 0 leaves that to Spark.
    compact_files: int = 0
    #: Accepted, without effect.
    enable_mmap: bool = False
    max_buffer_size: int = 0


@dataclass
class Route:
    """One route of a query: a vector or a text on a field."""

    field: str
    vector: list[float] | None = None
    text: str | None = None
    candidates: int = 0
    mode: str = "words"
    indices: list[int] | None = None


class Collection:
    def __init__(self, spark: SparkSession, path: str, schema: CollectionSchema, options: Options | None = None, frame: DataFrame | None = None):
        self.spark, self.path, self.schema, self.options = spark, path, schema, options or Options()
        self.folder = Folder(spark, path) if path else None
        self._frame = frame
        self._closed = False
        self._staged = ""

    # Lifecycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: CollectionSchema, options: Options | None = None) -> Collection:
        for f in schema.fields:
            f.validate()
        c = cls(spark, path, schema, options)
        if c.folder.exists("schema.json"):
            raise AlreadyExists(f"a collection at {path}")
        c._write_schema()
        c.folder.write("CURRENT", {"version": 0, "epoch": 0, "lsn": 0, "next_doc_id": 1})
        return c

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Collection:
        """Snapshot and change log together: nothing that was written is left out."""
        folder = Folder(spark, path)
        if not folder.exists("schema.json"):
            raise NotFound(f"no collection at {path}")
        saved = folder.read("schema.json")
        return cls(spark, path, CollectionSchema.from_json(saved["schema"]), options or Options(**saved["options"]))

    #: A saved collection has no other form than an open one.
    load = open

    @classmethod
    def over(cls, df: DataFrame, schema: CollectionSchema, key: str = "id") -> Collection:
        """A read-only collection over any DataFrame, without a copy; `key` becomes the text id."""
        rows = df.withColumn("id", F.col(key).cast("string"))
        if "doc_id" not in rows.columns:
            rows = rows.withColumn("doc_id", F.xxhash64("id"))
        names = [f.name for f in schema.fields]
        return cls(df.sparkSession, "", schema, Options(read_only=True), rows.select("id", "doc_id", *names))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, key: str, schema: CollectionSchema) -> Collection:
        return cls.over(spark.read.parquet(path), schema, key)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, key: str, schema: CollectionSchema) -> Collection:
        shape = T.StructType([f for f in schema.to_spark().fields if f.name != "id"])
        if key not in shape.fieldNames():
            shape = shape.add(key, T.StringType())
        return cls.over(spark.read.schema(shape).json(path), schema, key)

    def _write_schema(self) -> None:
        self.folder.write("schema.json", {"schema": self.schema.to_json(), "options": asdict(self.options)})

    def _current(self) -> dict:
        return self.folder.read("CURRENT")

    def _usable(self, write: bool = False) -> None:
        if self._closed:
            raise FailedPrecondition("the collection is closed")
        if write and self.options.read_only:
            raise PermissionDenied("the collection is read-only")

    def save(self) -> None:
        """Folds the change log into a new snapshot; the log stays until the next snapshot()."""
        self.snapshot()

    def snapshot(self) -> None:
        self._usable(write=True)
        self._rewrite(self.docs())

    def flush(self) -> None:
        """Writes are on the store when they return."""
        self._usable()

    def recover(self) -> Collection:
        """The state anew from what is stored; applying a change twice changes nothing."""
        self._closed = False
        return self

    def compact(self) -> None:
        self._usable(write=True)
        docs = self.docs()
        self._rewrite(docs.coalesce(self.options.compact_files) if self.options.compact_files else docs)

    def close(self) -> None:
        self._closed = True

    def destroy(self) -> None:
        self._usable(write=True)
        self._closed = True
        self.folder.delete()

    def _rewrite(self, docs: DataFrame, schema: CollectionSchema | None = None, rows_per_file: int = 0, index: bool = True) -> None:
        now = self._current()
        version = now["version"] + 1
        docs.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(self.folder.at(f"snapshots/v{version}"))
        if schema:
            self.schema = schema
            self._write_schema()
        built = {f.name: self._built(f.name) for f in self.schema.with_index(IndexType.IVF)}
        then = now | {"version": version, "epoch": now["epoch"] + 1}
        self.folder.write("CURRENT", then)
        for name, at in built.items():
            if at == now and not schema:  # the same documents elsewhere
                self.folder.write(f"index/{name}/built.json", then)
            elif at and index:
                self._build_ivf(name)
        for old in (f"snapshots/v{now['version'] - 1}", f"changes/e{now['epoch'] - 1}"):  # the last state stays for readers under way
            self.folder.delete(old)

    # State

    def _shape(self) -> T.StructType:
        fields = self.schema.to_spark().fields
        return T.StructType([fields[0], T.StructField("doc_id", T.LongType()), *fields[1:], T.StructField(PRESENT, T.ArrayType(T.StringType()))])

    def _log_shape(self) -> T.StructType:
        return T.StructType([T.StructField("lsn", T.LongType()), T.StructField("op", T.IntegerType()), *self._shape().fields])

    def changes(self) -> DataFrame:
        """The change log of this epoch: (lsn, op, id, doc_id, fields)."""
        now = self._current()
        at = f"changes/e{now['epoch']}"
        parts = [self.folder.at(f"{at}/{x}") for x in self.folder.names(at) if x.isdigit() and int(x) <= now["lsn"]]
        return self.spark.read.schema(self._log_shape()).parquet(*parts) if parts else self.spark.createDataFrame([], self._log_shape())

    def docs(self) -> DataFrame:
        """id, doc_id, fields, and the names of the fields that a document had."""
        self._usable()
        if self._frame is not None:
            return self._frame
        now = self._current()
        if now["version"]:
            base = self.spark.read.schema(self._shape()).parquet(self.folder.at(f"snapshots/v{now['version']}"))
        else:
            base = self.spark.createDataFrame([], self._shape())
        if not self.folder.exists(f"changes/e{now['epoch']}"):
            return base
        last = self.changes().groupBy("id").agg(F.max_by(F.struct(*self._log_shape().fieldNames()), "lsn").alias("c")).select("c.*")
        kept = last.where(F.col("op") != int(DocOp.DELETE)).select(*base.columns)
        return base.join(last.select("id"), "id", "left_anti").unionByName(kept)

    def rows(self) -> DataFrame:
        """Documents without what only the collection uses."""
        return self.docs().drop(PRESENT)

    def count(self) -> int:
        return self.docs().count()

    def stats(self) -> dict:
        """doc_count and the bytes of each vector field as floats."""
        size = lambda f: F.coalesce(F.sum(F.size(F.col(f.name)["values"] if f.type.is_sparse_vector else F.col(f.name)).cast("bigint") * 4), F.lit(0))
        row = self.docs().agg(F.count("*").alias("doc_count"), *[size(f).alias(f.name) for f in self.schema.vectors()]).first()
        fields = {f.name: row[f.name] for f in self.schema.vectors()}
        return {"doc_count": row.doc_count, "index_bytes": sum(fields.values()), "fields": fields}

    def segments(self) -> DataFrame:
        """(segment_id, doc_count, first, last): documents in runs of segment_size doc ids."""
        size = self.options.segment_size or self.schema.max_docs_per_segment
        segment = F.floor((F.col("doc_id") - 1) / size).cast("bigint")
        return self.docs().groupBy(segment.alias("segment_id")).agg(F.count("*").alias("doc_count"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))

    def write_segments(self, path: str) -> None:
        size = self.options.segment_size or self.schema.max_docs_per_segment
        self.docs().withColumn("segment_id", F.floor((F.col("doc_id") - 1) / size).cast("bigint")).write.mode("overwrite").partitionBy("segment_id").parquet(path)

    def export_json(self, path: str) -> None:
        self.rows().write.mode("overwrite").json(path)

    # Writes

    def _frame_of(self, docs: DataFrame | list[dict]) -> DataFrame:
        """Documents in the shape of the schema, with the names of their fields."""
        names = self.schema.names()
        if isinstance(docs, DataFrame):
            have = [n for n in names if n in docs.columns]
            lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.to_spark().fields[1:] if f.name not in have]
            return docs.select(F.col("id").cast("string").alias("id"), *have, *lacking, F.array(*[F.lit(n) for n in have]).cast("array<string>").alias(PRESENT)).select("id", *names, PRESENT)
        shape = T.StructType([*self.schema.to_spark().fields, T.StructField(PRESENT, T.ArrayType(T.StringType()))])
        return self.spark.createDataFrame([(str(d["id"]) if d.get("id") is not None else None, *[d.get(n) for n in names], [n for n in names if n in d]) for d in docs], shape)

    def _violations(self) -> list[tuple[str, Column]]:
        out = [("the id is empty", F.col("id").isNull() | (F.col("id") == ""))]
        for f in self.schema.fields:
            c = F.col(f"`{f.name}`")
            if not f.nullable:
                out.append((f"field {f.name!r} is missing", c.isNull()))
            if f.type.is_dense_vector:
                out.append((f"field {f.name!r} has the wrong dimension", F.size(c) != f.dimension))
            if f.type.is_sparse_vector:
                out.append((f"field {f.name!r} has indices and values of different lengths", F.size(c["indices"]) != F.size(c["values"])))
            if f.type in (DataType.UINT32, DataType.UINT64):
                out.append((f"field {f.name!r} is out of range", (c < 0) | (c > (2**32 - 1 if f.type == DataType.UINT32 else 2**64 - 1))))
        return out

    def _stage(self, docs: DataFrame | list[dict]) -> DataFrame:
        """The checked batch, written once, numbered in input order."""
        self._usable(write=True)
        self._staged = f"staging/{uuid.uuid4().hex}"
        at = self.folder.at(self._staged)
        numbered = self._frame_of(docs).withColumn("_at", F.monotonically_increasing_id())
        numbered.write.parquet(at)
        batch = self.spark.read.schema(numbered.schema).parquet(at)
        rules = self._violations()
        bad = batch.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(str(i)) for i, (_, c) in enumerate(rules)]).first()
        wrong = [f"{text} in {bad[str(i)]} documents" for i, (text, _) in enumerate(rules) if bad[str(i)]]
        repeated = [] if wrong else [r.id for r in batch.groupBy("id").count().where("count > 1").limit(3).collect()]
        if wrong or repeated:
            self._unstage()
            raise AlreadyExists(f"ids twice in a batch: {repeated}") if repeated else InvalidArgument("; ".join(wrong))
        return batch

    def _numbered(self, batch: DataFrame, start: int) -> tuple[DataFrame, int]:
        """Adds _n, start and up without gaps in input order, and the first number not used.

        Spark numbers rows within partitions; the partitions' counts, one row each, give the offsets.
        """
        part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
        counts = batch.groupBy(part.alias("_p")).agg(F.count("*").alias("c")).orderBy("_p").collect()
        firsts, n = [], start
        for r in counts:
            firsts.append((r["_p"], n))
            n += r.c
        # places within a partition may have gaps after a filter, so they are ranked there
        offsets = self.spark.createDataFrame(firsts, "_p bigint, _first bigint")
        from pyspark.sql import Window as W

        ranked = batch.withColumn("_p", part).withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(place)))
        return ranked.join(F.broadcast(offsets), "_p").withColumn("_n", F.col("_first") + F.col("_r") - 1).drop("_p", "_r", "_first"), n

    def _built(self, name: str) -> dict | None:
        """The state that a field's cells were written from."""
        at = f"index/{name}/built.json"
        return self.folder.read(at) if self.folder and self.folder.exists(at) else None

    def _cells(self, name: str) -> tuple[IvfIndex, DataFrame] | None:
        """Index and cells of the state as it is: the cells as written, without what was changed since, and that with cells of its own; None if the cells are of another snapshot."""
        built, now = self._built(name), self._current() if self.folder else None
        if not built or (built["version"], built["epoch"]) != (now["version"], now["epoch"]):
            return None
        index, cells = IvfIndex.read(self.spark, self.folder.at(f"index/{name}"))
        if built["lsn"] == now["lsn"]:
            return index, cells
        last = self.changes().where(F.col("lsn") > built["lsn"]).groupBy("id").agg(F.max_by(F.struct(*self._log_shape().fieldNames()), "lsn").alias("c")).select("c.*")
        kept = last.where(F.col("op") != int(DocOp.DELETE)).select(*self._shape().fieldNames())
        return index, cells.join(last.select("id"), "id", "left_anti").unionByName(index.assign(kept, name))

    def _append(self, rows: DataFrame, op: DocOp, next_doc_id: int | None = None) -> int:
        """Appends rows(id, doc_id, fields, _at) to the log; the number of rows."""
        now = self._current()
        rows, end = self._numbered(rows, now["lsn"] + 1)
        out = rows.withColumn("lsn", F.col("_n")).withColumn("op", F.lit(int(op)))
        out.select(*self._log_shape().fieldNames()).write.mode("overwrite").parquet(self.folder.at(f"changes/e{now['epoch']}/{now['lsn'] + 1:020d}"))
        n = end - now["lsn"] - 1
        self.folder.write("CURRENT", now | {"lsn": end - 1, "next_doc_id": next_doc_id or now["next_doc_id"]})
        self._unstage()
        return n

    def _unstage(self) -> None:
        """Takes away what this writer staged, and no other's."""
        if self._staged:
            self.folder.delete(self._staged)
            self._staged = ""

    def _ids(self) -> DataFrame:
        return self.docs().select("id", F.col("doc_id").alias("_old"))

    def insert(self, docs: DataFrame | list[dict]) -> int:
        batch = self._stage(docs)
        known = [r.id for r in batch.join(self._ids(), "id", "left_semi").select("id").limit(3).collect()]
        if known:
            self._unstage()
            raise InvalidArgument(f"ids exist: {known}")
        rows, next_id = self._numbered(batch, self._current()["next_doc_id"])
        return self._append(rows.withColumn("doc_id", F.col("_n")).drop("_n"), DocOp.INSERT, next_id)

    def upsert(self, docs: DataFrame | list[dict]) -> int:
        """Whole documents take the place of old ones, which keep their doc ids."""
        batch = self._stage(docs)
        both = batch.join(self._ids(), "id", "left")
        new, next_id = self._numbered(both.where("_old is null"), self._current()["next_doc_id"])
        rows = new.withColumn("doc_id", F.col("_n")).drop("_n").unionByName(both.where("_old is not null").withColumn("doc_id", F.col("_old")))
        return self._append(rows.drop("_old"), DocOp.UPSERT, next_id)

    def update(self, docs: DataFrame | list[dict]) -> int:
        batch = self._stage(docs)
        unknown = [r.id for r in batch.join(self._ids(), "id", "left_anti").select("id").limit(3).collect()]
        if unknown:
            self._unstage()
            raise NotFound(f"no such ids: {unknown}")
        return self._append(batch.join(self._ids(), "id").withColumn("doc_id", F.col("_old")).drop("_old"), DocOp.UPDATE)

    def _remove(self, gone: DataFrame) -> int:
        names = [f.name for f in self._shape().fields if f.name not in ("id", "doc_id")]
        rows = gone.select("id", "doc_id", *[F.lit(None).cast(self._shape()[n].dataType).alias(n) for n in names], F.monotonically_increasing_id().alias("_at"))
        self._staged = f"staging/{uuid.uuid4().hex}"
        at = self.folder.at(self._staged)
        rows.write.parquet(at)
        return self._append(self.spark.read.schema(rows.schema).parquet(at), DocOp.DELETE)

    def delete(self, ids: DataFrame | list[str]) -> int:
        """Ids that don't exist are passed over."""
        self._usable(write=True)
        ids = ids.select(F.col("id").cast("string").alias("id")) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        return self._remove(self.docs().join(ids, "id", "left_semi"))

    def delete_by_filter(self, where: str | MetadataFilter | Column) -> int:
        """A string without an operator holds for every document and is refused here."""
        self._usable(write=True)
        if isinstance(where, str) and not parse(where).op:
            raise InvalidArgument("the filter has no operator; it would delete every document")
        return self._remove(self.docs().where(as_condition(where, self.docs().schema)))

    def fetch(self, ids: list[str] | DataFrame, output_fields: list[str] | None = None, include_vector: bool = True) -> DataFrame:
        ids = ids.select(F.col("id").cast("string").alias("id")) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        found = self.rows().join(ids, "id", "left_semi")
        names = output_fields or [f.name for f in self.schema.fields if include_vector or not f.type.is_vector]
        return found.select("id", "doc_id", *names)

    def batch_build(self, field: str, rows: DataFrame | list[list[float]], ids: list[str] | None = None) -> int:
        """Bulk load of a vector field: documents with that field only; missing ids are d0, d1, ..."""
        if isinstance(rows, DataFrame):
            return self.upsert(rows)
        ids = list(ids or [])
        return self.upsert([{"id": ids[i] if i < len(ids) else f"d{i}", field: v} for i, v in enumerate(rows)])

    # Schema and indexes

    def add_column(self, field: Field, default: str | None = None) -> None:
        self._usable(write=True)
        schema, docs = self.schema.add(field), self.docs()
        value = F.expr(default) if default else F.lit(None)
        docs = docs.withColumn(field.name, value.cast(field.to_spark().dataType))
        if default:
            docs = docs.withColumn(PRESENT, F.array_union(F.coalesce(PRESENT, F.array().cast("array<string>")), F.array(F.lit(field.name))))
        self._rewrite(docs, schema)

    def drop_column(self, name: str) -> None:
        self._usable(write=True)
        schema = self.schema.drop(name)
        self._rewrite(self.docs().drop(name).withColumn(PRESENT, F.array_remove(PRESENT, name)), schema)

    def alter_column(self, old: str, new: str = "", to: Field | None = None) -> None:
        self._usable(write=True)
        schema = self.schema.alter(old, new, to)
        name = new or old
        docs = self.docs().withColumnRenamed(old, name).withColumn(PRESENT, F.transform(PRESENT, lambda x: F.when(x == old, name).otherwise(x)))
        self._rewrite(docs.withColumn(name, F.col(f"`{name}`").cast(schema[name].to_spark().dataType)), schema)

    def create_index(self, name: str, params: IndexParams) -> None:
        self._usable(write=True)
        f = self.schema[name]
        if params.TYPE in (IndexType.FTS, IndexType.INVERT) and f.type != DataType.STRING:
            raise InvalidArgument(f"field {name!r} is no text")
        if params.TYPE not in (IndexType.FTS, IndexType.INVERT) and not f.type.is_vector:
            raise InvalidArgument(f"field {name!r} is no vector")
        self.schema = self.schema.alter(name, to=replace(f, index=params))
        self._write_schema()
        if isinstance(params, IvfParams):
            self._build_ivf(name)

    def drop_index(self, name: str) -> None:
        self._usable(write=True)
        if name in self.schema:
            self.schema = self.schema.alter(name, to=replace(self.schema[name], index=None))
            self._write_schema()
            self.folder.delete(f"index/{name}")

    def _build_ivf(self, name: str) -> None:
        p = self.schema[name].index
        docs = self.docs()
        index = IvfIndex.train(docs, name, p.n_list, p.n_iters, p.metric)
        if len(index.centroids):
            index.write(docs, name, self.folder.at(f"index/{name}"))
            self.folder.write(f"index/{name}/built.json", self._current())

    def optimize(self) -> None:
        """Rewrites the snapshot and trains the cells of IVF fields anew."""
        self._usable(write=True)
        self._rewrite(self.docs(), index=False)
        for f in self.schema.with_index(IndexType.IVF):
            self._build_ivf(f.name)

    # Searches

    def _vector_field(self, name: str) -> Field:
        f = self.schema[name] if name in self.schema else None
        if f is None or not f.type.is_vector:
            raise NotFound(f"no index on field {name!r}")
        return f

    def metric(self, name: str) -> Metric:
        """Of the field's parameters; cosine without any."""
        f = self._vector_field(name)
        return f.index.metric if f.index else Metric.COSINE

    def _near(self, route: Route, k: int, where=None, **kw) -> DataFrame:
        f = self._vector_field(route.field)
        docs = self.docs()
        if f.type.is_sparse_vector:
            return search.sparse_topk(docs, f.name, route.indices or [], route.vector or [], k, where=where, radius=kw.get("radius"))
        if not route.vector:
            raise InvalidArgument("the query vector is empty")
        search.check_query(route.vector, k, f.dimension)
        if isinstance(f.index, HnswRabitqParams) and not kw.get("exact"):
            return search.coded_topk(docs, f.name, route.vector, k, f.index.metric, where=where, candidates=kw.get("refine", 0), radius=kw.get("radius"))
        if isinstance(f.index, IvfParams) and not kw.get("exact") and (found := self._cells(f.name)):
            index, cells = found
            return index.topk(cells, f.name, route.vector, k, kw.get("nprobe", 0), where=where, radius=kw.get("radius"))
        return search.topk(docs, f.name, route.vector, k, self.metric(f.name), where=where, radius=kw.get("radius"))

    def fts(self, name: str) -> fts.FtsIndex:
        f = self.schema[name] if name in self.schema else None
        if f is None or not isinstance(f.index, FtsParams):
            raise NotFound(f"no full-text index on field {name!r}")
        return fts.FtsIndex(self.docs(), name, "id", f.index.tokenizer, tuple(f.index.filters))

    def fts_query(self, name: str, query: str, k: int, mode: str = "words") -> DataFrame:
        """mode: words, and, or, advanced."""
        index = self.fts(name)
        if mode == "words":
            return index.search(query, k)
        return index.advanced(query, k) if mode == "advanced" else index.boolean(query, mode, k)

    def _project(self, rows: DataFrame, output_fields, include_vector: bool, include_doc_id: bool, whole: bool = True) -> DataFrame:
        names = [n for n in output_fields or [] if n not in ("id", "score")]
        if not output_fields and include_vector:
            names = [f.name for f in self.schema.fields if whole or f.type.is_vector]
        return rows.select("id", "score", *(["doc_id"] if include_doc_id and "doc_id" not in names else []), *names)

    def query(self, route: Route, k: int, where: str | Column | None = None, meta: MetadataFilter | None = None, output_fields: list[str] | None = None, include_vector: bool = False, include_doc_id: bool = False, **kw) -> DataFrame:
        """(id, score, ...) in order.  A string or Column filter goes before a metadata filter; text routes aren't filtered."""
        if k <= 0 or not route.field:
            raise InvalidArgument("a query needs a field and k above 0")
        if route.text is not None:
            found = self.fts_query(route.field, route.text, k, route.mode).select("id", "score")
            rows = found.join(self.docs(), "id").orderBy(F.desc("score"), "id")
        else:
            rows = self._near(route, k, where if where is not None else meta, **kw).orderBy("distance", "id")
        return self._project(rows, output_fields, include_vector, include_doc_id)

    def batch_query(self, field: str, vectors: list[list[float]], k: int, where: str | Column | None = None) -> DataFrame:
        """(qid, rank, id, distance, score) for the vectors, numbered from 0; those of a wrong dimension have no rows."""
        f = self._vector_field(field)
        good = [(i, v) for i, v in enumerate(vectors) if len(v) == f.dimension]
        if len(good) < len(vectors):
            warnings.warn(f"{len(vectors) - len(good)} queries have the wrong dimension", stacklevel=2)
        return search.batch_topk(self.docs(), field, good, k, self.metric(field), where=where)

    def multi_query(self, routes: list[Route], k: int, where=None, rerank: RerankType = RerankType.RRF, constant: int = fusion.RRF_CONSTANT, weights: list[float] | None = None, callback=None, output_fields: list[str] | None = None, include_vector: bool = False, include_doc_id: bool = False, filter_text: bool = False) -> DataFrame:
        """Fused results.  Routes on fields without an index are passed over; filters hold for vector routes (filter_text: for all)."""
        if k <= 0:
            raise InvalidArgument("k must be above 0")
        lists = []
        for r in routes:
            n = r.candidates or 2 * k
            try:
                if r.text is not None:
                    found = self.fts_query(r.field, r.text, n, r.mode)
                    if filter_text and where is not None:
                        found = found.join(self.docs().where(as_condition(where, self.docs().schema)).select("id"), "id", "left_semi")
                    lists.append(fusion.ranked(found, len(lists)))
                else:
                    lists.append(fusion.ranked(self._near(r, n, where).select("id", "score", "distance"), len(lists), by="distance", ascending=True))
            except NotFound:
                continue
        if not lists:
            return self._project(self.docs().where(F.lit(False)).withColumn("score", F.lit(0.0)), output_fields, include_vector, include_doc_id, whole=False)
        fused = fusion.rerank(lists, k, rerank, constant, weights, callback)
        rows = fused.withColumnRenamed("key", "id").join(self.docs(), "id").orderBy(F.desc("score"), "id")
        return self._project(rows, output_fields, include_vector, include_doc_id, whole=False)

    def hybrid_query(self, vector_field: str, vector: list[float], text_field: str, text: str, k: int, rerank: RerankType = RerankType.RRF, weights: list[float] | None = None) -> DataFrame:
        return self.multi_query([Route(vector_field, vector, candidates=3 * k), Route(text_field, text=text, candidates=2 * k)], k, rerank=rerank, weights=weights)

    def group_by(self, route: Route, by: str, groups: int, per_group: int, where=None, output_fields: list[str] | None = None, include_vector: bool = False) -> DataFrame:
        """(group_value, rank, id, score, ...)."""
        f = self._vector_field(route.field)
        search.check_query(route.vector or [], 1, f.dimension)
        if by not in self.schema:
            return search.group_topk(self.docs().where(F.lit(False)), f.name, route.vector, "id", groups, per_group, self.metric(f.name)).select("group_value", "rank", "id", "score")
        rows = search.group_topk(self.docs(), f.name, route.vector, by, groups, per_group, self.metric(f.name), where=where)
        names = [n for n in output_fields or [] if n not in ("id", "score")] or ([v.name for v in self.schema.vectors()] if include_vector else [])
        return rows.orderBy("group_value", "rank").select("group_value", "rank", "id", "score", *names)

    def field_values(self, name: str) -> DataFrame:
        """(value, doc_count) of a field, as an inverted or metadata index has them."""
        c = F.col(f"`{name}`")
        rows = self.docs().where(c.isNotNull())
        if self.schema[name].type == DataType.STRING:
            rows = rows.where(c != "")
        return rows.groupBy(c.alias("value")).agg(F.count("*").alias("doc_count"))

    def matching(self, where: str | MetadataFilter | Column) -> DataFrame:
        docs = self.docs()
        return docs.where(compile_filter(where, docs.schema) if isinstance(where, str) else as_condition(where, docs.schema)).drop(PRESENT)
