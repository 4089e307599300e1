"""Queries over the driver's tables, one for each operator, with their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import quantizers as Q
from ..functions import text as X
from ..functions import vector as V
from ..functions.filters import MetadataFilter, compile_filter
from ..operators import fusion, search
from ..operators.fts import FtsIndex
from ..operators.ivf import IvfIndex
from ..schema import CollectionSchema, Field
from ..sources.collection import Collection, Options, Route
from ..types import DataType, FlatParams, FtsParams, HnswParams, IvfParams, Metric

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratavec-")
    return f"{root}/collections/{uuid.uuid4().hex}"


def r6(c):
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


# Vectors.  The query is the stored vector of the least id.

Q_SQL = "with q as (select embedding::double[] as v from embeddings order by vec_id limit 1), e as (select vec_id, label, embedding::double[] as v from embeddings)"
L2_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
NORM_SQL = "sqrt(list_dot_product({a}, {a}))"
COS_SQL = "(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def dist_sql(form: str) -> str:
    return form.format(a="e.v", b="q.v")


def top_sql(d: str, k: int = 10, where: str = "true", more: str = "") -> str:
    return f"{Q_SQL} select vec_id{more}, round(d, 6) + 0::double as distance, round(1 / (1 + d), 6) as score from (select e.*, {d} as d from e, q where {where}) order by d, vec_id limit {k}"


def first_vector(spark, sf_dir) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def top(spark, sf_dir, metric, k=10, where=None, more=()):
    rows = search.topk(read(spark, sf_dir, "embeddings"), "embedding", first_vector(spark, sf_dir), k, metric, key="vec_id", where=where)
    return rows.select("vec_id", *more, r6("distance").alias("distance"), r6("score").alias("score"))


@query(top_sql(dist_sql(COS_SQL)))
def vec_cosine_topk(spark, sf_dir):
    return top(spark, sf_dir, Metric.COSINE)


@query(top_sql(dist_sql(L2_SQL)))
def vec_l2_topk(spark, sf_dir):
    return top(spark, sf_dir, Metric.L2)


@query(top_sql("(1 - list_dot_product(e.v, q.v))"))
def vec_ip_topk(spark, sf_dir):
    return top(spark, sf_dir, Metric.IP)


@query(top_sql(dist_sql(L2_SQL)))
def vec_mipsl2_topk(spark, sf_dir):
    return top(spark, sf_dir, Metric.MIPSL2)


@query(top_sql(dist_sql(COS_SQL), where="e.label >= 5", more=", label"))
def vec_filter_topk(spark, sf_dir):
    return top(spark, sf_dir, Metric.COSINE, where="label >= 5", more=("label",))


@query(top_sql(dist_sql(COS_SQL), where="e.label in (1, 3, 5) and e.label > 1", more=", label"))
def vec_meta_topk(spark, sf_dir):
    return top(spark, sf_dir, Metric.COSINE, where=MetadataFilter().int_in("label", [1, 3, 5]).int_gt("label", 1), more=("label",))


@query(f"{Q_SQL} select vec_id, round(d, 6) as distance from (select vec_id, {dist_sql(L2_SQL)} as d from e, q) where d <= 1.5")
def vec_radius(spark, sf_dir):
    """Every row within a distance."""
    rows = search.topk(read(spark, sf_dir, "embeddings"), "embedding", first_vector(spark, sf_dir), 2**31 - 1, Metric.L2, "vec_id", radius=1.5)
    return rows.select("vec_id", r6("distance").alias("distance"))


@query(f"{Q_SQL} select vec_id, round(sqrt({dist_sql(L2_SQL)}), 6) as l2 from e, q")
def vec_l2_sqrt(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", r6(V.l2(F.col("embedding"), first_vector(spark, sf_dir))).alias("l2"))


@query(f"{Q_SQL} select vec_id, round(1 - {dist_sql(COS_SQL)}, 6) as similarity from e, q")
def vec_cosine_similarity(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", r6(V.cosine_similarity(F.col("embedding"), first_vector(spark, sf_dir))).alias("similarity"))


@query(f"with e as (select vec_id, embedding::double[] as v from embeddings) select vec_id, round(list_sum(list_transform(v, lambda x: abs(x))) / {NORM_SQL.format(a='v')}, 6) as l1, round(v[1] / {NORM_SQL.format(a='v')}, 6) as first from e")
def vec_normalize(spark, sf_dir):
    n = V.normalize(F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", n.alias("n"))
    return rows.select("vec_id", r6(F.aggregate("n", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("l1"), r6(F.get("n", F.lit(0))).alias("first"))


@query(
    f"""with e as (select vec_id, embedding::double[] as v from embeddings), q as (select * from e where vec_id % 20 = 0),
d as (select q.vec_id as qid, e.vec_id, {dist_sql(COS_SQL)} as d from e, q),
r as (select *, row_number() over (partition by qid order by d, vec_id) as rank from d)
select qid, rank::int as rank, vec_id, round(d, 6) + 0::double as distance, round(1 / (1 + d), 6) as score from r where rank <= 10"""
)
def vec_batch_topk(spark, sf_dir):
    """Each row whose id is divisible by 20 against all rows."""
    rows = read(spark, sf_dir, "embeddings")
    found = search.join_topk(rows.where("vec_id % 20 = 0"), rows, "embedding", 10, Metric.COSINE, "vec_id", "vec_id")
    return found.select("qid", "rank", "vec_id", r6("distance").alias("distance"), r6("score").alias("score"))


@query(
    f"""{Q_SQL}, d as (select vec_id, label, {dist_sql(COS_SQL)} as d from e, q order by d, vec_id limit 30),
r as (select *, label::varchar as group_value, row_number() over (partition by label order by d, vec_id) as rank from d),
g as (select group_value from r group by 1 order by 1 limit 5)
select group_value, rank::int as rank, vec_id, round(d, 6) + 0::double as distance from r join g using (group_value) where rank <= 2"""
)
def vec_group_by(spark, sf_dir):
    rows = search.group_topk(read(spark, sf_dir, "embeddings"), "embedding", first_vector(spark, sf_dir), "label", 5, 2, Metric.COSINE, "vec_id")
    return rows.select("group_value", "rank", "vec_id", r6("distance").alias("distance"))


def hybrid(spark, sf_dir) -> Collection:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")).drop("vec_id")
    schema = CollectionSchema("hybrid", [
        Field("embedding", DataType.VECTOR_FP32, True, 64, HnswParams(Metric.COSINE)), Field("text", DataType.STRING, True, 0, FtsParams()), Field("lang", DataType.STRING, True), Field("source", DataType.STRING, True), Field("label", DataType.INT32, True),
    ])
    return Collection.over(rows, schema, "doc_id")


H_SQL = f"h as (select doc_id::varchar as id, d.*, label, embedding::double[] as v from documents d join embeddings on doc_id = vec_id), q as (select embedding::double[] as v from embeddings order by vec_id limit 1), hd as (select id, {COS_SQL.format(a='h.v', b='q.v')} as d from h, q)"


@query(f"with {H_SQL} select id, round(1 / (1 + d), 6) as score, lang, label from hd join h using (id) order by d, id limit 10")
def vec_output_fields(spark, sf_dir):
    found = hybrid(spark, sf_dir).query(Route("embedding", first_vector(spark, sf_dir)), 10, output_fields=["lang", "label"])
    return found.withColumn("score", r6("score"))


@query(f"with {H_SQL}, f as (select id, d from hd join h using (id) where lang = 'en' order by d, id limit 10) select id, round(1 / (1 + d), 6) as score from f")
def collection_query_filter(spark, sf_dir):
    found = hybrid(spark, sf_dir).query(Route("embedding", first_vector(spark, sf_dir)), 10, where="lang == en")
    return found.select("id", r6("score").alias("score"))


TERMS_SQL = r"t as (select doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{Nd}]+)', 1)) as term from documents)"


@query(
    f"""with {TERMS_SQL}, v as (select term, row_number() over (order by term) as i from (select distinct term from t)),
n as (select doc_id, term, count(*)::double as c from t group by all),
q as (select term, c from n where doc_id = (select min(doc_id) from documents)),
s as (select n.doc_id, sum(n.c * q.c) as p from n join q using (term) group by 1)
select doc_id, 1 - coalesce(p, 0) as distance from documents left join s using (doc_id) order by distance, doc_id limit 10"""
)
def sparse_ip_topk(spark, sf_dir):
    """Term counts as sparse vectors over hashed term numbers; the query is the first document's."""
    tokens = read(spark, sf_dir, "documents").select("doc_id", X.standard(F.col("text")).alias("t"))
    counts = tokens.select("doc_id", F.explode("t").alias("term")).groupBy("doc_id", F.xxhash64("term").alias("i")).agg(F.count("*").cast("float").alias("c"))
    sparse = counts.groupBy("doc_id").agg(F.collect_list(F.struct("i", "c")).alias("p")).select("doc_id", F.struct(F.transform("p", lambda x: x["i"]).alias("indices"), F.transform("p", lambda x: x["c"]).alias("values")).alias("v"))
    sparse = tokens.select("doc_id").join(sparse, "doc_id", "left").select("doc_id", F.coalesce("v", F.struct(F.array().cast("array<bigint>").alias("indices"), F.array().cast("array<float>").alias("values"))).alias("v"))
    q = sparse.orderBy("doc_id").first().v
    return search.sparse_topk(sparse, "v", list(q["indices"]), list(q["values"]), 10, key="doc_id").select("doc_id", "distance")


@query(top_sql(dist_sql(COS_SQL)))
def ivf_topk_all(spark, sf_dir):
    """All cells are probed, so the result is exact."""
    rows = read(spark, sf_dir, "embeddings")
    index = IvfIndex.train(rows, "embedding", 8, 10, Metric.COSINE)
    found = index.topk(index.assign(rows, "embedding"), "embedding", first_vector(spark, sf_dir), 10, nprobe=8, key="vec_id")
    return found.select("vec_id", r6("distance").alias("distance"), r6("score").alias("score"))


@query(
    """with q as (select embedding::double[] as v from embeddings order by vec_id limit 1),
e as (select vec_id, case when vec_id % 50 = 0 then list_transform(embedding::double[], lambda x: -x) else embedding::double[] end as v from embeddings where vec_id % 7 <> 3),
d as (select vec_id::varchar as id, list_sum(list_transform(list_zip(e.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from e, q)
select id, round(1 / (1 + d), 6) as score from d order by d, id limit 10"""
)
def ivf_incremental(spark, sf_dir):
    """A search in the cells after an upsert and deletes that came when they were written; all cells are probed."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding")
    dimension = rows.select(F.size("embedding")).first()[0]
    c = Collection.create(spark, work_dir(spark), CollectionSchema("v", [Field("vec_id", DataType.INT64, True), Field("embedding", DataType.VECTOR_FP32, False, dimension, IvfParams(Metric.L2, n_list=8))]))
    c.upsert(rows)
    c.optimize()
    c.upsert(rows.where("vec_id % 50 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    c.delete(rows.where("vec_id % 7 = 3").select("id"))
    found = c.query(Route("embedding", first_vector(spark, sf_dir)), 10, nprobe=8)
    return found.select("id", r6("score").alias("score"))


@query()
def ivf_topk(spark, sf_dir):
    """The 10 nearest of each vector whose id is divisible by 20, in as many cells as were measured to give a recall of 0.95.  Tests hold the mean recall."""
    rows = read(spark, sf_dir, "embeddings")
    index = IvfIndex.train(rows, "embedding", 16, 10, Metric.COSINE)
    cells = index.assign(rows, "embedding")
    index.tune(cells, "embedding", "vec_id")
    found = index.join_topk(rows.where("vec_id % 20 = 0"), cells, "embedding", 10, key="vec_id", query_key="vec_id")
    return found.select(F.col("qid").alias("query_id"), F.col("rank").cast("bigint").alias("rank"), "vec_id", r6("distance").alias("distance"))


@query(
    f"""with q as (select embedding::double[] as v from embeddings order by vec_id limit 1),
qn as (select list_transform(v, lambda x: x / {NORM_SQL.format(a="v")}) as v from q),
e as (select vec_id, list_transform(embedding::double[], lambda x: greatest(least(x / {NORM_SQL.format(a="embedding::double[]")}, 1), -1)) as v from embeddings),
c as (select vec_id, list_transform(v, lambda x: trunc(x * 7) / 7) as v from e)
select vec_id, round(1 - list_dot_product(c.v, qn.v), 6) as distance from c, qn order by 1 - list_dot_product(c.v, qn.v), vec_id limit 10"""
)
def int4_topk(spark, sf_dir):
    found = search.coded_topk(read(spark, sf_dir, "embeddings"), "embedding", first_vector(spark, sf_dir), 10, Metric.COSINE, "vec_id")
    return found.select("vec_id", r6("distance").alias("distance"))


# String filters over whole tables.

EVENTS = ("events", "event_id")
PARTS = ("part", "p_partkey")
DOCS = ("documents", "doc_id")
ORDERS = ("orders", "o_orderkey")

FILTERS = {
    "f_ge": (EVENTS, "value >= 50", "value >= 50"),
    "f_le": (EVENTS, "value <= 20.5", "value <= 20.5::double"),
    "f_gt": (PARTS, "p_size > 25", "p_size > 25"),
    "f_lt": (PARTS, "p_retailprice < 1000", "p_retailprice < 1000"),
    "f_ne": (EVENTS, "event_type != click", "event_type <> 'click'"),
    "f_eq": (DOCS, "lang == de", "lang = 'de'"),
    "f_eq_single": (PARTS, "p_size = 7", "p_size = 7"),
    "f_like": (DOCS, "source LIKE src1?", "regexp_full_match(source, 'src1.')"),
    "f_like_star": (PARTS, "p_name LIKE *a*e*", "p_name like '%a%e%'"),
    "f_prefix": (DOCS, "source HAS_PREFIX src1", "starts_with(source, 'src1')"),
    "f_suffix": (DOCS, "source HAS_SUFFIX 9", "ends_with(source, '9')"),
    "f_contain_all": (DOCS, "text CONTAIN_ALL the, and", "contains(text, 'the') and contains(text, 'and')"),
    "f_contain_any": (DOCS, "text CONTAIN_ANY über, the", "contains(text, 'über') or contains(text, 'the')"),
    "f_not_contain_all": (DOCS, "text NOT_CONTAIN_ALL the, and", "not (contains(text, 'the') and contains(text, 'and'))"),
    "f_not_contain_any": (DOCS, "text NOT_CONTAIN_ANY der, the", "not (contains(text, 'der') or contains(text, 'the'))"),
    "f_is_not_null": (DOCS, "lang IS_NOT_NULL", "lang is not null"),
    "f_no_operator": (ORDERS, "anything goes", "true"),
    "f_text_below": (ORDERS, "o_orderstatus < 5", "o_orderstatus is not null"),
}


def _filter(name, table, key, text, sql):
    def run(spark, sf_dir):
        rows = read(spark, sf_dir, table)
        return rows.where(compile_filter(text, rows.schema)).select(key)

    run.__name__ = name
    query(f"select {key} from {table} where coalesce({sql}, false)")(run)


for _name, ((_table, _key), _text, _sql) in FILTERS.items():
    _filter(_name, _table, _key, _text, _sql)



@query("select doc_id from documents where coalesce(lang, 'en') = 'en'")
def f_is_null(spark, sf_dir):
    """English documents have no lang here, so that there are rows to find and rows to leave."""
    rows = read(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("lang") != "en", F.col("lang")))
    return rows.where(compile_filter("lang IS_NULL", rows.schema)).select("doc_id")


@query("select o_orderkey from orders where o_totalprice > 100000")
def f_priority(spark, sf_dir):
    """`>` is looked for before `!=`, so what stands before it is the field."""
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "o_totalprice != a")
    return rows.where(compile_filter("o_totalprice != a>100000", rows.schema)).select("o_orderkey")


M = MetadataFilter()
METADATA = {
    "m_eq": (DOCS, M.eq("lang", "fr"), "lang = 'fr'"),
    "m_in": (DOCS, M.is_in("lang", ["fr", "es"]), "lang in ('fr', 'es')"),
    "m_int_eq": (PARTS, M.int_eq("p_size", 10), "p_size = 10"),
    "m_int_in": (PARTS, M.int_in("p_size", [1, 2, 3]), "p_size in (1, 2, 3)"),
    "m_gt": (EVENTS, M.int_gt("user_id", 50), "user_id > 50"),
    "m_lt": (EVENTS, M.int_lt("user_id", 50), "user_id < 50"),
    "m_gte": (EVENTS, M.int_gte("user_id", 50), "user_id >= 50"),
    "m_lte": (EVENTS, M.int_lte("user_id", 50), "user_id <= 50"),
    "m_ne": (EVENTS, M.int_ne("user_id", 50), "user_id <> 50"),
    "m_exists": (DOCS, M.exists("lang"), "lang is not null and lang <> ''"),
    "m_conjunction": (DOCS, M.eq("lang", "en").is_in("source", ["src1", "src2"]).int_gt("n_chars", 500), "lang = 'en' and source in ('src1', 'src2') and n_chars > 500"),
}


def _metadata(name, table, key, where, sql):
    def run(spark, sf_dir):
        rows = read(spark, sf_dir, table)
        return rows.where(where.column(rows.schema)).select(key)

    run.__name__ = name
    query(f"select {key} from {table} where coalesce({sql}, false)")(run)


for _name, ((_table, _key), _where, _sql) in METADATA.items():
    _metadata(_name, _table, _key, _where, _sql)


@query("select event_id, true as wide, false as narrow from events where user_id = 50")
def m_strict(spark, sf_dir):
    """Strictly, a 64-bit column can be asked for and a narrower one holds nothing."""
    strict = MetadataFilter(strict=True)
    rows = read(spark, sf_dir, "events").withColumn("short", F.col("user_id").cast("int"))
    wide, narrow = strict.int_eq("user_id", 50).column(rows.schema), MetadataFilter(strict=True).int_eq("short", 50).column(rows.schema)
    return rows.where(wide | narrow).select("event_id", F.coalesce(wide, F.lit(False)).alias("wide"), F.coalesce(narrow, F.lit(False)).alias("narrow"))


@query("select event_id, true as high from events where value > 50")
def m_bool(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("value") > 50).alias("high"))
    return rows.where(M.bool_eq("high", True).column(rows.schema))


@query("select source as value, count(*) as doc_count from documents where source is not null and source <> '' group by 1")
def m_field_values(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    schema = CollectionSchema("docs", [Field("source", DataType.STRING, True)])
    return Collection.over(rows, schema, "doc_id").field_values("source")


@query("select count(*) as doc_count, count(distinct source) as n_values from documents where source is not null and source <> ''")
def m_doc_count(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.where(M.exists("source").column(rows.schema)).agg(F.count("*").alias("doc_count"), F.countDistinct("source").alias("n_values"))


# Full text.

FTS_SQL = r"d as (select doc_id, text, regexp_extract_all(lower(text), '([\p{L}\p{Nd}]+)', 1) as t from documents where text is not null), n as (select count(*)::double as total, avg(len(t)::double) as mean from d)"


def tf_sql(term: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{term}'))::double"


def df_sql(term: str) -> str:
    return f"(select count(*) from d where list_contains(t, '{term}'))::double"


def bm25_sql(term: str, tf: str) -> str:
    return f"(ln((total - {df_sql(term)} + 0.5::double) / ({df_sql(term)} + 0.5::double)) * {tf} * 2.2::double / ({tf} + 1.2::double * (0.25::double + 0.75::double * len(t) / mean)))"


def one_sql(term: str) -> str:
    return bm25_sql(term, tf_sql(term))


def index(spark, sf_dir) -> FtsIndex:
    return FtsIndex(read(spark, sf_dir, "documents"), "text", "doc_id")


def scored(rows):
    return rows.select("doc_id", r6("score").alias("score"))


@query(rf"with {FTS_SQL} select doc_id, len(t) as n, coalesce(t[1], '') as first, coalesce(t[-1], '') as last from d")
def fts_tokens(spark, sf_dir):
    t = index(spark, sf_dir).tokens
    return t.select(F.col("key").alias("doc_id"), F.size("tokens").cast("bigint").alias("n"), F.coalesce(F.get("tokens", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.try_element_at("tokens", F.lit(-1)), F.lit("")).alias("last"))


@query(r"select doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) as n from documents")
def fts_whitespace(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(X.whitespace(F.col("text"))).cast("bigint").alias("n"))


@query(rf"with {FTS_SQL}, p as (select doc_id, unnest(list_distinct(t)) as term from d), f as (select term, count(*) as df from p group by 1) select term, df, round(ln((total - df + 0.5::double) / (df + 0.5::double)), 6) as idf from f, n")
def fts_idf(spark, sf_dir):
    return index(spark, sf_dir).doc_freq().withColumn("idf", r6("idf"))


@query(rf"with {FTS_SQL}, p as (select doc_id, unnest(t) as term, unnest(range(len(t))) as pos from d) select term, doc_id, count(*) as tf, min(pos) as first, max(pos) as last from p group by 1, 2")
def fts_postings(spark, sf_dir):
    p = index(spark, sf_dir).postings
    return p.select("term", F.col("key").alias("doc_id"), "tf", F.get("positions", F.lit(0)).cast("bigint").alias("first"), F.element_at("positions", -1).cast("bigint").alias("last"))


def _sum_sql(terms: dict[str, int]) -> str:
    return " + ".join(f"case when list_contains(t, '{w}') then {bm25_sql(w, f'({n} * {tf_sql(w)})')} else 0 end" for w, n in terms.items())


@query(f"with {FTS_SQL} select doc_id, round(s, 6) as score from (select doc_id, {_sum_sql({'than': 2, 'der': 1, 'la': 1})} as s from d, n where list_has_any(t, ['than', 'der', 'la'])) order by s desc, doc_id limit 20")
def fts_bm25(spark, sf_dir):
    return scored(index(spark, sf_dir).search("Than der than la", 20))


def _bool_sql(terms: list[str], least: int) -> str:
    n = " + ".join(f"list_contains(t, '{w}')::int" for w in terms)
    return f"with {FTS_SQL} select doc_id, ({n})::double as score from d where {n} >= {least} order by score desc, doc_id limit 50"


@query(_bool_sql(["the", "from", "with"], 3))
def fts_bool_and(spark, sf_dir):
    return scored(index(spark, sf_dir).boolean("the from with", "AND", 50))


@query(_bool_sql(["the", "der", "les"], 1))
def fts_bool_or(spark, sf_dir):
    return scored(index(spark, sf_dir).boolean("the der les", "OR", 50))


def _adv_sql(where: str, score: str, k: int = 50) -> str:
    return f"with {FTS_SQL} select doc_id, round(s, 6) as score from (select doc_id, ({score})::double as s from d, n where {where}) order by s desc, doc_id limit {k}"


def has(term: str) -> str:
    return f"list_contains(t, '{term}')"


def part(term: str) -> str:
    return f"case when {has(term)} then {one_sql(term)} else 0 end"


@query(_adv_sql(f"{has('from')} and {has('with')}", f"{one_sql('from')} + {one_sql('with')}"))
def fts_adv_and(spark, sf_dir):
    return scored(index(spark, sf_dir).advanced("from AND with", 50))


@query(_adv_sql(f"{has('der')} or {has('les')}", f"{part('der')} + {part('les')}"))
def fts_adv_or(spark, sf_dir):
    return scored(index(spark, sf_dir).advanced("der or les", 50))


@query(_adv_sql(f"{has('from')} and not {has('with')}", one_sql("from")))
def fts_adv_not(spark, sf_dir):
    return scored(index(spark, sf_dir).advanced("from NOT with", 50))


@query(_adv_sql(f"not {has('the')}", "0"))
def fts_adv_unary_not(spark, sf_dir):
    return scored(index(spark, sf_dir).advanced("NOT the", 50))


@query(_adv_sql(f"({has('der')} or {has('from')}) and not {has('with')}", f"{part('der')} + {part('from')}"))
def fts_nested(spark, sf_dir):
    return scored(index(spark, sf_dir).advanced("(der OR from) NOT with", 50))


@query(
    f"""with {FTS_SQL}, p as (select *, len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' and t[i + 1] = 'than'))::double as c from d)
select doc_id, round(s, 6) as score from (select doc_id, {bm25_sql("the", "c")} + {bm25_sql("than", "c")} as s from p, n where c > 0) order by s desc, doc_id limit 50"""
)
def fts_phrase(spark, sf_dir):
    return scored(index(spark, sf_dir).advanced('"the than"', 50))


@query()
def fts_jieba(spark, sf_dir):
    """Longest-match tokens of each text."""
    cut = X.longest_match()
    return read(spark, sf_dir, "documents").select("doc_id", F.size(cut(F.col("text"))).alias("n"))


# Fusion over the hybrid collection: 10 nearest vectors and 10 best texts.

HF_SQL = f"""{H_SQL}, d as (select doc_id, text, regexp_extract_all(lower(text), '([\\p{{L}}\\p{{Nd}}]+)', 1) as t from h where text is not null), n as (select count(*)::double as total, avg(len(t)::double) as mean from d),
a as (select id, 1 / (1 + d) as s, row_number() over (order by d, id) as rk from hd order by d, id limit @va),
b as (select id, s, row_number() over (order by s desc, id) as rk from (select doc_id::varchar as id, @score as s from d, n where @where) order by s desc, id limit @fb)"""


def fused_sql(body: str, va: int, fb: int) -> str:
    made = HF_SQL.replace("@va", str(va)).replace("@fb", str(fb)).replace("@score", one_sql("than")).replace("@where", has("than"))
    return f"with {made} {body}"


RRF_SQL = "select id, round(sum(1 / (60::double + rk)), 6) as score from (select * from a union all select * from b) group by id order by sum(1 / (60::double + rk)) desc, id limit 10"
SCALED = "select id, case when max(s) over () = min(s) over () then 1 else (s - min(s) over ()) / nullif(max(s) over () - min(s) over (), 0) end as s"


@query(fused_sql(RRF_SQL, 30, 20))
def hybrid_rrf(spark, sf_dir):
    found = hybrid(spark, sf_dir).hybrid_query("embedding", first_vector(spark, sf_dir), "text", "than", 10)
    return found.select("id", r6("score").alias("score"))


@query(fused_sql(f"select id, round(sum(w * s), 6) as score from (select *, 0.7::double as w from ({SCALED} from a) union all select *, 0.3::double as w from ({SCALED} from b)) group by id order by round(sum(w * s), 9) desc, id limit 10", 20, 20))
def multi_query_weighted(spark, sf_dir):
    from ..types import RerankType

    found = hybrid(spark, sf_dir).multi_query([Route("embedding", first_vector(spark, sf_dir)), Route("text", text="than")], 10, rerank=RerankType.WEIGHTED, weights=[0.7, 0.3])
    return found.select("id", r6("score").alias("score"))


@query(f"with {H_SQL}, a as (select id, row_number() over (order by d, id) as rk from hd join h using (id) where lang = 'en' order by d, id limit 20) select id, round(1 / (60::double + rk), 6) as score, lang from a join h using (id) order by rk limit 10")
def multi_query_filter(spark, sf_dir):
    """Filters hold for the vector routes; a route on an unknown field is passed over."""
    found = hybrid(spark, sf_dir).multi_query([Route("embedding", first_vector(spark, sf_dir)), Route("nothing", [1.0])], 10, where="lang == en", output_fields=["lang"])
    return found.withColumn("score", r6("score"))


@query(fused_sql("select id, max(s) as s, round(max(s), 6) as score from (select id, s from a union all select id, s from b) group by id order by s desc, id limit 10", 20, 20).replace("select id, max(s) as s, round(max(s), 6) as score", "select id, round(max(s), 6) as score").replace("order by s desc, id limit 10", "order by max(s) desc, id limit 10"))
def multi_query_callback(spark, sf_dir):
    """A user function: the best score of any route."""
    from ..types import RerankType

    def best(lists, k):
        import pandas as pd

        rows = pd.concat(lists).groupby("key", as_index=False)["score"].max()
        return rows.sort_values(["score", "key"], ascending=[False, True]).head(k)

    found = hybrid(spark, sf_dir).multi_query([Route("embedding", first_vector(spark, sf_dir)), Route("text", text="than")], 10, rerank=RerankType.CALLBACK, callback=best)
    return found.select("id", r6("score").alias("score"))


@query("with a as (select c_custkey as id, row_number() over (order by c_acctbal desc, c_custkey) as rk from customer), b as (select o_custkey as id, row_number() over (order by sum(o_totalprice) desc, o_custkey) as rk from orders group by o_custkey), u as (select * from (select * from a order by rk limit 50) union all select * from (select * from b order by rk limit 50)) select id as key, round(sum(1 / (60::double + rk)), 6) as score from u group by id order by sum(1 / (60::double + rk)) desc, id limit 20")
def rrf_tables(spark, sf_dir):
    """Fusion of any two ranked results: customers by balance and by turnover."""
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    b = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return fusion.rrf([fusion.ranked(a, 0), fusion.ranked(b, 1)], 20).select("key", r6("score").alias("score"))


# Quantizers.

SCALE_SQL = "s as (select list(m order by i) as m from (select i, max(abs(embedding[i]::double)) as m from embeddings, range(1, 65) r(i) group by i))"


def codes_sql(levels: int) -> str:
    return f"with {SCALE_SQL} select vec_id, array_to_string(list_transform(range(1, 65), lambda i: trunc(greatest(least(embedding[i]::double / m[i], 1), -1) * {levels})::int), ',') as codes from embeddings, s"


@query(codes_sql(127))
def q_int8(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    q = Q.Int8(64).train(rows, "embedding")
    return rows.select("vec_id", F.array_join(q.encode(F.col("embedding")).cast("array<string>"), ",").alias("codes"))


@query(
    f"""with {SCALE_SQL}, c as (select vec_id, list_transform(range(1, 65), lambda i: trunc(greatest(least(embedding[i]::double / m[i], 1), -1) * 7)::int) as c from embeddings, s)
select vec_id, array_to_string(list_transform(range(1, 33), lambda i: ((c[2 * i - 1] & 15) * 16 + (c[2 * i] & 15))::int), ',') as bytes from c"""
)
def q_int4(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    q = Q.Int4(64).train(rows, "embedding")
    return rows.select("vec_id", F.array_join(F.transform(q.encode(F.col("embedding")), lambda b: b.cast("int").bitwiseAND(255).cast("string")), ",").alias("bytes"))


@query(
    f"with {SCALE_SQL} select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(trunc(greatest(least(embedding[i]::double / m[i], 1), -1) * 127)::int / 127::double * m[i] - embedding[i]::double))), 6) as error from embeddings, s"
)
def q_int8_error(spark, sf_dir):
    """Sum of decoding errors."""
    rows = read(spark, sf_dir, "embeddings")
    q = Q.Int8(64).train(rows, "embedding")
    diff = F.zip_with(q.decode(q.encode(F.col("embedding"))), "embedding", lambda a, b: F.abs(a - b.cast("double")))
    return rows.select("vec_id", r6(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)).alias("error"))


@query(
    f"select vec_id, array_to_string(list_transform(range(0, 8), lambda b: list_sum(list_transform(range(1, 9), lambda j: case when embedding[8 * b + j] >= 0 then 1 << (j - 1)::int else 0 end))::int), ',') as bits, round({NORM_SQL.format(a='embedding::double[]')}, 5) as norm from embeddings"
)
def q_rabitq(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", Q.RaBitQ(64).encode(F.col("embedding")).alias("c"))
    return rows.select("vec_id", F.array_join(F.col("c.bits").cast("array<string>"), ",").alias("bits"), F.round(F.col("c.norm").cast("double"), 5).alias("norm"))


@query()
def q_fp16(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    q = Q.Fp16()
    return rows.select("vec_id", q.encode(F.col("embedding")).alias("code")).withColumn("value", q.decode(F.col("code")))


@query()
def q_pq(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    q = Q.ProductQuantizer(64, 8, centroids=32, iterations=5).train(rows, "embedding", "vec_id")
    coded = rows.select("vec_id", q.encode(F.col("embedding")).alias("code"))
    return coded.withColumn("distance", q.asymmetric_distance(first_vector(spark, sf_dir), F.col("code")))


@query("select event_id, coalesce((user_id % 16)::int - 8, 0) as a, coalesce((event_id % 16)::int - 8, 0) as b from events")
def int4_pack_unpack(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.array((F.col("user_id") % 16 - 8).cast("tinyint"), (F.col("event_id") % 16 - 8).cast("tinyint")).alias("v"))
    back = V.unpack_int4(V.pack_int4(F.col("v")), 2)
    return rows.select("event_id", F.get(back, F.lit(0)).cast("int").alias("a"), F.get(back, F.lit(1)).cast("int").alias("b"))


# Collections written to disk: parts with a price vector.

PART_SCHEMA = CollectionSchema("parts", [
    Field("name", DataType.STRING, True, 0, FtsParams()), Field("size", DataType.INT32, True), Field("price", DataType.DOUBLE, True), Field("v", DataType.VECTOR_FP32, True, 2, FlatParams(Metric.L2)),
])
BASE_SQL = "p as (select p_partkey::varchar as id, p_name as name, p_size as size, p_retailprice as price from part)"


def part_rows(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.array(F.col("p_size").cast("float"), F.lit(1.0).cast("float")).alias("v")
    )


def parts(spark, sf_dir, segment_size: int = 0) -> Collection:
    c = Collection.create(spark, work_dir(spark), PART_SCHEMA, Options(segment_size=segment_size))
    c.insert(part_rows(spark, sf_dir))
    return c


def shown(c: Collection):
    return c.docs().select("id", "name", "size", "price")


@query(f"with {BASE_SQL} select * from p")
def dml_insert(spark, sf_dir):
    return shown(parts(spark, sf_dir))


@query(f"with {BASE_SQL} select id, name, size, case when size > 25 then price * 2 else price end as price from p union all select 'new', 'added', 1, 0.5::double")
def dml_upsert(spark, sf_dir):
    c = parts(spark, sf_dir)
    c.upsert(part_rows(spark, sf_dir).where("size > 25").withColumn("price", F.col("price") * 2))
    c.upsert([{"id": "new", "name": "added", "size": 1, "price": 0.5, "v": [1.0, 1.0]}])
    return shown(c)


@query(f"with {BASE_SQL} select id, case when size = 3 then 'changed' else name end as name, size, price from p")
def dml_update(spark, sf_dir):
    c = parts(spark, sf_dir)
    c.update(part_rows(spark, sf_dir).where("size = 3").withColumn("name", F.lit("changed")))
    return shown(c)


@query(f"with {BASE_SQL} select * from p where size <> 7")
def dml_delete(spark, sf_dir):
    c = parts(spark, sf_dir)
    c.delete(part_rows(spark, sf_dir).where("size = 7").select("id"))
    return shown(c)


@query(f"with {BASE_SQL} select * from p where not price >= 1200")
def dml_delete_by_filter(spark, sf_dir):
    c = parts(spark, sf_dir)
    c.delete_by_filter("price >= 1200")
    return shown(c)


@query(f"with {BASE_SQL} select * from p where size = 11")
def dml_fetch(spark, sf_dir):
    c = parts(spark, sf_dir)
    return c.fetch(part_rows(spark, sf_dir).where("size = 11").select("id"), ["name", "size", "price"]).drop("doc_id")


@query(f"with {BASE_SQL} select *, size * 2 as twice from p")
def ddl_add_column(spark, sf_dir):
    c = parts(spark, sf_dir)
    c.add_column(Field("twice", DataType.INT32, True), "size * 2")
    return c.docs().select("id", "name", "size", "price", "twice")


@query(f"with {BASE_SQL} select id, name, price, size::bigint as extent from p")
def ddl_alter_column(spark, sf_dir):
    c = parts(spark, sf_dir)
    c.alter_column("size", "extent", Field("extent", DataType.INT64, True))
    return c.docs().select("id", "name", "price", "extent")


@query(f"with {BASE_SQL} select id, name, size from p")
def ddl_drop_column(spark, sf_dir):
    c = parts(spark, sf_dir)
    c.drop_column("price")
    return c.rows().drop("doc_id", "v")


@query("select floor((p - 1) / 300)::bigint as segment_id, count(*) as doc_count, min(p)::bigint as first, max(p)::bigint as last from (select row_number() over () as p from part) group by 1")
def segments(spark, sf_dir):
    return parts(spark, sf_dir, 300).segments()


@query(f"with {BASE_SQL} select id, name, size, case when size > 40 then 0::double else price end as price from p where size <> 7")
def wal_replay(spark, sf_dir):
    """Writes after a snapshot, read back by opening the collection anew."""
    c = parts(spark, sf_dir)
    c.snapshot()
    c.upsert(part_rows(spark, sf_dir).where("size > 40").withColumn("price", F.lit(0.0)))
    c.delete(part_rows(spark, sf_dir).where("size = 7").select("id"))
    return shown(Collection.open(spark, c.path))


@query("select count(*) as doc_count, count(*) * 8 as index_bytes from part")
def stats(spark, sf_dir):
    s = parts(spark, sf_dir).stats()
    return spark.createDataFrame([(s["doc_count"], s["index_bytes"])], "doc_count bigint, index_bytes bigint")


@query(f"with {BASE_SQL}, d as (select *, (size - 10)::double * (size - 10) as d from p) select id, round(1 / (1 + d), 6) as score, name from d order by d, id limit 25")
def collection_query(spark, sf_dir):
    """A search in a written collection, after optimize and compact."""
    c = parts(spark, sf_dir)
    c.optimize()
    c.compact()
    return c.query(Route("v", [10.0, 1.0]), 25, output_fields=["name"]).withColumn("score", r6("score"))


@query(f"with {BASE_SQL} select id, name from p where size is not null")
def export_import_json(spark, sf_dir):
    c = parts(spark, sf_dir)
    at = work_dir(spark)
    c.export_json(at)
    return Collection.from_json(spark, at, "id", PART_SCHEMA).docs().where("size is not null").select("id", "name")


@query("select o_custkey::varchar as id, max(o_orderkey)::varchar as last_order, count(*) as n from orders group by 1")
def stream_changelog(spark, sf_dir):
    """Orders as a stream of upserts by customer, in the order of their keys; the last state, and what the stream held."""
    from ..streaming.changelog import follow

    schema = CollectionSchema("customers", [Field("last_order", DataType.STRING, True)])
    c = Collection.create(spark, work_dir(spark), schema)
    source = read(spark, sf_dir, "orders")
    changes = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/orders.parquet*")
    changes = changes.select(F.lit("upsert").alias("op"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("last_order"), F.col("o_orderkey").alias("seq"))
    follow(changes, c, work_dir(spark)).awaitTermination()
    n = source.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count("*").alias("n"))
    return c.docs().select("id", "last_order").join(n, "id")
