"""Vector search: top k by distance, for one query, for many, in groups, over cells and over codes.

Results are ordered by (distance, id).  An exact scan serves every index type:
one query is an expression that ends in a top-k operator (k rows a task reach
the final merge); many queries are a block product on Arrow batches, where each
batch keeps k rows a query and a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import vector as V
from ..functions.filters import as_condition
from ..types import Metric

#: Values of a block of queries that is broadcast (64 MB); more queries go in several blocks.
QUERY_VALUES = 8_000_000


def check_query(query: list[float], k: int, dimension: int = 0) -> None:
    if k <= 0:
        raise InvalidArgument("k must be above 0")
    if not len(query):
        raise InvalidArgument("the query vector is empty")
    if dimension and len(query) != dimension:
        raise InvalidArgument(f"the query has {len(query)} dimensions, the field {dimension}")


def _by_rank(df: DataFrame, k: int, key: str) -> DataFrame:
    return df.orderBy("distance", key).limit(k)


def topk(df: DataFrame, field: str, query: list[float], k: int, metric: Metric = Metric.COSINE, key: str = "id", where=None, radius: float | None = None) -> DataFrame:
    """df's columns with distance and score of the k nearest rows; filters and the radius come before the cut."""
    check_query(query, k)
    rows = df.where(as_condition(where, df.schema)).where(F.col(field).isNotNull())
    rows = rows.withColumn("distance", V.distance(metric, F.col(field), query))
    if radius is not None:
        rows = rows.where(F.col("distance") <= radius)
    return _by_rank(rows, k, key).withColumn("score", V.score(F.col("distance")))


def _block_topk(rows: DataFrame, block: tuple[list, np.ndarray], k: int, metric: Metric, qid: str) -> DataFrame:
    """(qid, key, distance): for each Arrow batch of rows(key, vector), its k nearest for each query of a broadcast block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        for b in batches:
            if not len(b):
                continue
            keys = b["key"].to_numpy()
            d = V.block_distances(metric, q, np.stack(b["vector"].to_numpy()).astype(np.float64))
            out = []
            for i, name in enumerate(names):
                near = np.flatnonzero(d[i] <= np.partition(d[i], k - 1)[k - 1]) if len(keys) > k else np.arange(len(keys))
                near = sorted(near.tolist(), key=lambda j: (d[i, j], keys[j]))[:k]  # noqa: B023
                out += [(name, keys[j], float(d[i, j])) for j in near]
            yield pd.DataFrame(out, columns=["qid", "key", "distance"])

    return rows.mapInPandas(run, f"qid {qid}, key {rows.schema['key'].dataType.simpleString()}, distance double")


def _merge(parts: list[DataFrame], k: int, key: str) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("distance", "key"))).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", F.col("key").alias(key), "distance", V.score(F.col("distance")).alias("score"))


def _searched(df: DataFrame, field: str, k: int, key: str, where) -> DataFrame:
    if k <= 0:
        raise InvalidArgument("k must be above 0")
    return df.where(as_condition(where, df.schema)).where(F.col(field).isNotNull()).select(F.col(key).alias("key"), F.col(field).alias("vector"))


def batch_topk(df: DataFrame, field: str, queries: list[tuple], k: int, metric: Metric = Metric.COSINE, key: str = "id", where=None) -> DataFrame:
    """(qid, rank, key, distance, score) of the k nearest rows for each of queries [(qid, vector), ...]."""
    rows = _searched(df, field, k, key, where)
    step = max(1, QUERY_VALUES // max([1, *(len(v) for _, v in queries)]))
    blocks = [queries[i : i + step] for i in range(0, len(queries), step)]
    parts = [_block_topk(rows, ([q for q, _ in b], np.array([v for _, v in b], np.float64)), k, metric, "bigint") for b in blocks]
    return _merge(parts or [rows.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("qid"), "key", F.lit(0.0).alias("distance"))], k, key)


def join_topk(queries: DataFrame, df: DataFrame, field: str, k: int, metric: Metric = Metric.COSINE, key: str = "id", query_key: str = "id", where=None) -> DataFrame:
    """batch_topk for queries in a DataFrame (query_key, field): read, and broadcast, a block of bounded size at a time."""
    rows = _searched(df, field, k, key, where)
    queries = queries.where(F.col(field).isNotNull()).select(F.col(query_key).alias("q"), F.col(field).alias("v"))
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (width or 1) // QUERY_VALUES))
    parts = []
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).orderBy("q").collect() if blocks > 1 else queries.orderBy("q").collect()
        if own:
            parts.append(_block_topk(rows, ([r.q for r in own], np.array([r.v for r in own], np.float64)), k, metric, queries.schema["q"].dataType.simpleString()))
    return _merge(parts or [rows.where(F.lit(False)).select(F.col("key").alias("qid"), "key", F.lit(0.0).alias("distance"))], k, key)


def group_key(c: Column, kind: str) -> Column:
    """A value as the text that groups sort by: whole floats without a fraction, null as <nil>."""
    text = c.cast("string")
    if kind in ("float", "double"):
        text = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(text)
    return F.coalesce(text, F.lit("<nil>"))


def group_topk(df: DataFrame, field: str, query: list[float], by: str, groups: int, per_group: int, metric: Metric = Metric.COSINE, key: str = "id", where=None) -> DataFrame:
    """(group_value, rank, ...) of the nearest rows in groups.

    Candidates are the nearest per_group * groups * 3 rows (all, if that isn't
    above 0); the first per_group of each group stay; groups are ordered by their
    text and the first `groups` stay (all, if not above 0).
    """
    check_query(query, 1)
    rows = df.where(as_condition(where, df.schema)).where(F.col(field).isNotNull())
    rows = rows.withColumn("distance", V.distance(metric, F.col(field), query))
    bound = per_group * groups * 3
    if bound > 0:
        rows = _by_rank(rows, bound, key)
    rows = rows.withColumn("group_value", group_key(F.col(by), df.schema[by].dataType.simpleString()))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("group_value").orderBy("distance", key))).where(F.col("rank") <= per_group)
    if groups > 0:  # the names of the first groups are few: a top-k, not a global window
        first = rows.select("group_value").distinct().orderBy("group_value").limit(groups)
        rows = rows.join(F.broadcast(first), "group_value")
    return rows.withColumn("score", V.score(F.col("distance")))


def sparse_topk(df: DataFrame, field: str, indices: list[int], values: list[float], k: int, key: str = "id", where=None, radius: float | None = None) -> DataFrame:
    """Top k by 1 minus the product with a sparse query; rows without a shared index have distance 1."""
    check_query(indices, k)
    if len(indices) != len(values):
        raise InvalidArgument("indices and values differ in length")
    query = F.struct(F.array(*[F.lit(int(i)) for i in indices]).alias("indices"), F.array(*[F.lit(float(v)) for v in values]).alias("values"))
    rows = df.where(as_condition(where, df.schema)).where(F.col(field).isNotNull())
    rows = rows.withColumn("distance", V.sparse_inner_product(F.col(field), query))
    if radius is not None:
        rows = rows.where(F.col("distance") <= radius)
    return _by_rank(rows, k, key).withColumn("score", V.score(F.col("distance")))


def coded_topk(df: DataFrame, field: str, query: list[float], k: int, metric: Metric = Metric.COSINE, key: str = "id", where=None, candidates: int = 0, radius: float | None = None) -> DataFrame:
    """Top k by distances to 4-bit codes of scale 1 (values clamped to [-1, 1]); with candidates > 0, those are ranked again exactly.  The radius holds for the distance that is returned."""
    from ..functions.quantizers import Int4

    check_query(query, k)
    rows = df.where(as_condition(where, df.schema)).where(F.col(field).isNotNull())
    coder = Int4(len(query))
    v = V.normalize(F.col(field)) if metric == Metric.COSINE else F.col(field)
    q = np.array(query, np.float64)
    if metric == Metric.COSINE and (n := float(np.sqrt(q @ q))):
        q = q / n
    near = Metric.IP if metric == Metric.COSINE else metric
    rows = rows.withColumn("distance", V.distance(near, coder.rounded(v), q.tolist()))
    if candidates > 0:
        rows = _by_rank(rows, max(k, candidates), key).withColumn("distance", V.distance(metric, F.col(field), query))
    if radius is not None:
        rows = rows.where(F.col("distance") <= radius)
    return _by_rank(rows, k, key).withColumn("score", V.score(F.col("distance")))
