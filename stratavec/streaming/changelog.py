"""Structured Streaming into a collection: each micro-batch of changes is one keyed write.

A change is a row with `op` (insert, upsert, update as upsert, delete), `id`, the
fields, and a column that orders changes of one id.  Of several changes of an id
in a batch, the last counts.  A batch that is delivered again changes nothing:
ids keep their doc ids, and deletes of missing ids are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.collection import Collection


def apply_batch(collection: Collection, batch: DataFrame, order: str = "seq") -> None:
    names = [n for n in ["id", "op", *collection.schema.names()] if n in batch.columns]
    last = batch.groupBy("id").agg(F.max_by(F.struct(*names), order).alias("c")).select("c.*").persist()
    try:
        gone, kept = last.where("op = 'delete'"), last.where("op <> 'delete'")
        if not gone.isEmpty():
            collection.delete(gone.select("id"))
        if not kept.isEmpty():
            collection.upsert(kept.drop("op"))
    finally:
        last.unpersist()


def follow(stream: DataFrame, collection: Collection, checkpoint: str, order: str = "seq", **trigger) -> StreamingQuery:
    """Starts a query that applies a stream of changes."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_batch(collection, batch, order)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
