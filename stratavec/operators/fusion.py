"""Fusion of ranked lists, and queries of several routes.

A list is a DataFrame (key, score) with `rank` from 1.  Fusing is one union and
one keyed aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..types import RerankType

RRF_CONSTANT = 60


def ranked(rows: DataFrame, number: int, key: str = "id", by: str = "score", ascending: bool = False) -> DataFrame:
    """(list, key, score, rank) of a result cut to k rows: the window runs over those only."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    rank = F.row_number().over(W.partitionBy("list").orderBy(order, "key"))
    return rows.select(F.lit(number).alias("list"), F.col(key).alias("key"), F.col("score").cast("double").alias("score"), *([F.col(by)] if by != "score" else [])).withColumn("rank", rank).select("list", "key", "score", "rank")


def union(lists: list[DataFrame]) -> DataFrame:
    if not lists:
        raise InvalidArgument("no list to fuse")
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def rrf(lists: list[DataFrame], k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """(key, score): sum over lists of 1 / (constant + rank)."""
    fused = union(lists).groupBy("key").agg(F.sum(1 / (F.lit(float(constant if constant > 0 else RRF_CONSTANT)) + F.col("rank"))).alias("score"))
    return fused.orderBy(F.desc("score"), "key").limit(k)


def min_max(rows: DataFrame) -> DataFrame:
    """Scores of each list scaled to 0..1; 1 if all are equal."""
    own = W.partitionBy("list")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return rows.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))))


def weighted(lists: list[DataFrame], weights: list[float], k: int) -> DataFrame:
    """(key, score): weighted sum of scaled scores; a list without a weight has 1."""
    own = F.lit(1.0)
    for i, w in enumerate(weights):
        own = F.when(F.col("list") == i, float(w)).otherwise(own)
    fused = min_max(union(lists)).groupBy("key").agg(F.sum(own * F.col("score")).alias("score"))
    return fused.orderBy(F.desc("score"), "key").limit(k)


def callback(lists: list[DataFrame], fn: Callable[[list[pd.DataFrame], int], pd.DataFrame], k: int) -> DataFrame:
    """(key, score) of a user function of the lists, which are the cut results of routes (k rows each or so)."""
    rows = union(lists)
    kind = rows.schema["key"].dataType.simpleString()
    count = len(lists)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [pdf[pdf["list"] == i].sort_values("rank")[["key", "score"]].reset_index(drop=True) for i in range(count)]
        return fn(own, k)[["key", "score"]]

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"key {kind}, score double")


def rerank(lists: list[DataFrame], k: int, kind: RerankType = RerankType.RRF, constant: int = RRF_CONSTANT, weights: list[float] | None = None, fn=None) -> DataFrame:
    if k <= 0:
        raise InvalidArgument("k must be above 0")
    if kind == RerankType.WEIGHTED:
        return weighted(lists, weights or [], k)
    if kind == RerankType.CALLBACK and fn:
        return callback(lists, fn, k)
    return rrf(lists, k, constant)
