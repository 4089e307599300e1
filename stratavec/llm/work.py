"""What the operators share on the driver: scratch tables, labelled samples, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with this remainder of crc32(doc_id) mod 5 are never learned from.
HELD_OUT = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True if crc32 of doc_id as text is divisible by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == HELD_OUT, F.lit(False))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a temporary one only where that is unset and the driver is the only machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratavec-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Shuffle files go when the query that wrote them ends, not when the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a rerun.

    Disk holds the tables that haven't been dropped and the shuffle of one table.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, random: bool = False) -> DataFrame:
        """df written and to be read again; random: its numbers are hashes, so that dictionaries of them cost time and save nothing."""
        at = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("parquet.enable.dictionary", str(not random).lower()).parquet(at)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, balanced: bool = False) -> tuple[DataFrame, tuple[int, int]]:
    """(text, y) of at most `limit` labelled documents outside the held-out fold, and the counts of labelled documents (1, 0).

    The documents with the smallest hash of doc_id are taken, so the sample
    doesn't depend on partitioning; balanced: half of them of each kind if there
    are so many, so that rare ones are in it.  Null ids
    and labels are left out; a document with several labels counts once, with
    the largest; of several rows of a document the least text counts.
    """
    y = F.when(F.col(label) > 0, 1).otherwise(0)
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(y).alias("y"))
    n, ones = own.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    least = lambda rows, most: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if balanced:
        half = limit // 2
        few = least(own.where("y = 1"), max(half, limit - (n - ones))) + least(own.where("y = 0"), max(half, limit - ones))
    else:
        few = least(own, limit)
    few = labels.sparkSession.createDataFrame(few, "doc_id bigint, y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows.select("text", "y"), (ones, n - ones)


def components(spark: SparkSession, edges: DataFrame, kind: str, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label): the smallest node that each node of edges(a, b) reaches.

    Rounds of contraction: each node points to its least neighbour, or that
    one's least neighbour, if smaller; edges are moved to where their ends
    point and what has become a loop goes.  Edges shrink with every round; each
    node then follows the pointers of all rounds.  Minima are combined before
    they are shuffled, so a hub costs a row a task.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = scratch.keep(edges.where("a <> b").select(*ordered("a", "b")).distinct(), f"{tag}-edges-0")
    nodes = scratch.keep(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node")), f"{tag}-nodes")
    steps: list[DataFrame] = []
    while left.limit(1).count():
        i = len(steps)
        least = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))  # only the greater end has a smaller neighbour
        least = scratch.keep(least, f"{tag}-least-{i}")
        far = least.select(F.col("node").alias("via"), F.col("to").alias("far"))
        jump = scratch.keep(least.join(far, least["to"] == far.via, "left").select("node", F.coalesce("far", "to").alias("to")), f"{tag}-to-{i}")
        steps.append(jump)
        end_a = jump.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        end_b = jump.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = left.join(end_a, "a", "left").join(end_b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        left = scratch.keep(moved.where("a <> b").select(*ordered("a", "b")).distinct(), f"{tag}-edges-{i + 1}")
        scratch.drop(f"{tag}-edges-{i}", f"{tag}-least-{i}")
    for step in steps:
        last = step.select(F.col("node").alias("via"), F.col("to").alias("far"))
        nodes = nodes.join(last, nodes.label == last.via, "left").select("node", F.coalesce("far", "label").alias("label"))
    labels = scratch.keep(nodes, f"{tag}-labels")
    scratch.drop(f"{tag}-nodes", f"{tag}-edges-{len(steps)}", *(f"{tag}-to-{i}" for i in range(len(steps))))
    return labels


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `value` looked up in table(keys, members, value), null where absent.

    A key may hold a large part of all rows.  Keys with more than 1/1000 of
    them, fewer than 1000 whatever the input, are looked up in a broadcast
    table; their rows go through the keyed join that serves the others under a
    hash of their own and without a match.  Keys are bigint.
    """
    total = rows.count()
    hot = table.where(F.col("members") * 1000 > total).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_hot"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    first = rows.join(F.broadcast(hot), on, "left")
    found = F.col(f"_{keys[0]}").isNotNull()
    own = [F.when(found, F.xxhash64(*[rows[c] for c in rows.columns], F.lit(i))).otherwise(F.col(k)).alias(f"_k_{k}") for i, k in enumerate(keys)]
    first = first.select(*rows.columns, F.col("_hot"), *own, F.when(~found, 1).alias("_k"))
    cold = table.where(F.col("members") * 1000 <= total).select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.lit(1).alias("_c"), F.col(value).alias("_cold"))
    both = first.join(cold, [F.col(f"_k_{k}") == F.col(f"_c_{k}") for k in keys] + [F.col("_k") == F.col("_c")], "left")
    return both.select(*rows.columns, F.coalesce("_hot", "_cold").alias(value))


#: Bits of a membership filter: a table of 2^20 rows (16 MB) at most, whatever the input.
FILTER_BITS = 1 << 26


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any(f"{w}{tail}".lower() in taken for w in wanted):
        tail += "_"
    return [w + tail for w in wanted]


class Members:
    """A filter of fixed size for a set of bigint ids: says no only for ids outside the set.

    The filter is a broadcast table of 64-bit words with a bit for each hash
    that occurs.  Rows that it refuses need no shuffle to meet the set.  It lets
    1 % of the others through with 700,000 ids and nearly all with a billion:
    then it saves nothing, but the keyed join that follows gives the same rows.
    """

    def __init__(self, ids: DataFrame):
        place = F.xxhash64(F.col(ids.columns[0])).bitwiseAND(FILTER_BITS - 1)
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        self.table = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))

    def pick(self, rows: DataFrame, key: str, inside: bool = True) -> DataFrame:
        """Rows whose key may be in the set, or (inside=False) those whose key isn't."""
        word, bits = free_names(rows, "word", "bits")
        place = F.xxhash64(rows[key].cast("bigint")).bitwiseAND(FILTER_BITS - 1)
        there = F.call_function("shiftright", F.col(bits), place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
        table = self.table.select(F.col("word").alias(word), F.col("bits").alias(bits))
        return rows.join(F.broadcast(table), (F.shiftright(place, 6) == F.col(word)) & there, "left_semi" if inside else "left_anti")
