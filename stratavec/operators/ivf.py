"""Inverted cells: k-means centroids, rows assigned to their nearest, search in the nearest cells.

Centroids are trained on a bounded sample; every row is assigned.  Written by
cell, a search reads only the folders of the cells that it probes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.filters import as_condition
from ..types import Metric
from . import search

SEED = 42
#: Vectors that centroids are trained on at most.
SAMPLE_ROWS = 200_000


def default_nprobe(n_list: int) -> int:
    return min(n_list, max(4, math.floor(math.sqrt(n_list))))


#: Mean recall that the probed cells are to give, vectors and neighbours that it is measured with.
RECALL, MEASURED, NEIGHBOURS = 0.95, 64, 10


@dataclass
class IvfIndex:
    metric: Metric
    centroids: np.ndarray
    nprobe: int = 0
    #: Measured at build for nprobe; 0 if not measured.
    recall: float = 0.0

    def __post_init__(self):
        self.nprobe = self.nprobe or default_nprobe(len(self.centroids))

    @staticmethod
    def train(df: DataFrame, field: str, n_list: int = 10, n_iters: int = 20, metric: Metric = Metric.COSINE, sample_rows: int = SAMPLE_ROWS) -> IvfIndex:
        rows = df.where(F.col(field).isNotNull()).select(F.col(field).alias("v"))
        n = rows.count()
        if not n:
            return IvfIndex(metric, np.zeros((0, 0)))
        if n > sample_rows:
            rows = rows.orderBy(F.xxhash64("v")).limit(sample_rows)
        v = V.normalize(F.col("v")) if metric == Metric.COSINE else F.transform("v", lambda x: x.cast("double"))
        model = KMeans(k=max(2, min(n_list, n)), maxIter=n_iters, seed=SEED, featuresCol="f").fit(rows.select(array_to_vector(v).alias("f")))
        return IvfIndex(metric, np.array(model.clusterCenters()))

    def assign(self, df: DataFrame, field: str, cell: str = "_cell") -> DataFrame:
        """Adds the number of the nearest centroid; the first, if several are as near or there is no vector."""
        if len(self.centroids) < 2:
            return df.withColumn(cell, F.lit(0))
        shared = df.sparkSession.sparkContext.broadcast((self.metric, self.centroids))

        @F.pandas_udf("int")
        def nearest(vectors: pd.Series) -> pd.Series:
            metric, centroids = shared.value
            out = np.zeros(len(vectors), np.int32)
            some = np.flatnonzero(vectors.notna().to_numpy())
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                out[part] = V.block_distances(metric, centroids, np.stack(vectors.iloc[part].to_numpy()).astype(np.float64)).argmin(0)
            return pd.Series(out)

        return df.withColumn(cell, nearest(F.col(field)))

    def tune(self, cells: DataFrame, field: str, key: str = "id", recall: float = RECALL, cell: str = "_cell") -> IvfIndex:
        """Sets the least nprobe whose mean recall of the nearest NEIGHBOURS reaches `recall`, for the MEASURED rows of least hash, by one exact scan of the assigned rows."""
        rows = cells.where(F.col(field).isNotNull())
        asked = rows.orderBy(F.xxhash64(key), key).limit(MEASURED).select(key, field).collect()
        if not asked or not len(self.centroids):
            return self
        own = rows.sparkSession.createDataFrame([(i, r[1]) for i, r in enumerate(asked)], f"_asked int, {field} array<double>")
        near = search.join_topk(own, rows.withColumn("_key", F.struct(key, cell).cast("string")).select("_key", field), field, NEIGHBOURS, self.metric, "_key", "_asked")
        # the key carries the cell: the last number of the struct's text
        found = near.select("qid", F.regexp_extract("_key", r"(\d+)\}$", 1).cast("int").alias("cell")).collect()
        order = {i: {c: n for n, c in enumerate(self.probes(list(r[1]), len(self.centroids)))} for i, r in enumerate(asked)}
        places = np.array([order[r.qid][r.cell] for r in found])
        self.nprobe, self.recall = len(self.centroids), 1.0
        for n in range(1, len(self.centroids) + 1):
            if (places < n).mean() >= recall:
                self.nprobe, self.recall = n, float((places < n).mean())
                break
        return self

    def probes(self, query: list[float], nprobe: int = 0) -> list[int]:
        d = V.block_distances(self.metric, np.array([query], np.float64), self.centroids)[0]
        return np.argsort(d, kind="stable")[: nprobe or self.nprobe].tolist()

    def topk(self, df: DataFrame, field: str, query: list[float], k: int, nprobe: int = 0, key: str = "id", where=None, cell: str = "_cell", radius: float | None = None) -> DataFrame:
        """Top k within the nearest cells of df, which has been assigned; exact if all cells are probed."""
        condition = as_condition(where, df.schema)
        return search.topk(df.where(F.col(cell).isin(self.probes(query, nprobe))), field, query, k, self.metric, key, condition, radius)

    def join_topk(self, queries: DataFrame, df: DataFrame, field: str, k: int, nprobe: int = 0, key: str = "id", query_key: str = "id", cell: str = "_cell") -> DataFrame:
        """(qid, rank, key, distance, score): top k within the nearest cells of each of queries(query_key, field)."""
        rows = df.where(F.col(field).isNotNull()).select(F.col(key).alias("key"), F.col(field).alias("vector"), F.col(cell).alias("cell"))
        queries = queries.where(F.col(field).isNotNull()).select(F.col(query_key).alias("q"), F.col(field).alias("v"))
        n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
        blocks = max(1, -(-n * (width or 1) // search.QUERY_VALUES))
        kinds = f"qid {queries.schema['q'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, distance double"
        parts = [df.sparkSession.createDataFrame([], kinds)]
        for i in range(blocks):  # read, and broadcast, a block of bounded size at a time
            own = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).orderBy("q").collect()
            if not own:
                continue
            probed = np.zeros((len(own), len(self.centroids)), bool)
            for at, r in enumerate(own):
                probed[at, self.probes(r.v, nprobe)] = True
            shared = df.sparkSession.sparkContext.broadcast(([r.q for r in own], np.array([r.v for r in own], np.float64), probed, self.metric))

            def run(batches, shared=shared):
                names, q, probed, metric = shared.value
                for b in batches:
                    if not len(b):
                        continue
                    keys, cells = b["key"].to_numpy(), b["cell"].to_numpy()
                    d = V.block_distances(metric, q, np.stack(b["vector"].to_numpy()).astype(np.float64))
                    out = []
                    for at, name in enumerate(names):
                        inside = np.flatnonzero(probed[at, cells])
                        out += [(name, keys[j], float(d[at, j])) for j in inside[np.lexsort((keys[inside], d[at, inside]))][:k].tolist()]
                    yield pd.DataFrame(out, columns=["qid", "key", "distance"])

            parts.append(rows.mapInPandas(run, kinds))
        return search._merge(parts, k, key)

    def write(self, df: DataFrame, field: str, path: str) -> None:
        """Rows by cell, and the centroids beside them; nprobe is tuned on what was written."""
        self.assign(df, field).write.mode("overwrite").partitionBy("_cell").parquet(f"{path}/cells")
        spark = df.sparkSession
        self.tune(spark.read.parquet(f"{path}/cells"), field)
        rows = [(i, c.tolist(), int(self.metric), self.nprobe, self.recall) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, metric int, nprobe int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def read(spark: SparkSession, path: str) -> tuple[IvfIndex, DataFrame]:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return IvfIndex(Metric(rows[0].metric), np.array([r.centroid for r in rows]), rows[0].nprobe, rows[0].recall), spark.read.parquet(f"{path}/cells")
