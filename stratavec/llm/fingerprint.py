"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

Of the hashes of a text's five-word shingles, every one below a fixed fraction
of the hash range is kept.  Because the bound is the same for all texts, the
sketch of a union is the union of the sketches, and the share of one sketch
found in another estimates containment even between very unequal texts.

`next_text` pairs each document with the next by doc_id without a global sort:
rows go to ordered buckets (quantile cells, cut evenly), the first row of each
bucket is sent to the bucket before it as well, and a window runs in each
bucket.  Text is shuffled once.

Cases: a null text is empty; a text without kept hashes has the empty
fingerprint and likeness 1 to an equal text, 0 to any other; texts of fewer
than five words are one shingle; a null doc_id comes first; rows of one doc_id
follow each other by text; the only document is its own next; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 5
#: Kept: hashes whose upper 32 bits, unsigned, are below KEEP (a quarter of all).
KEEP = 1 << 30
#: Quantile cells, buckets a cell at most, rows a bucket aimed at.
CELLS, PARTS, ROWS = 128, 512, 1500


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, the sorted sketch of column `text` (no nulls)."""
    words, h = f"{out}_words", f"{out}_hashes"
    df = df.withColumn(words, F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(WIDTH)]))
    upper = F.transform(F.when(F.size(h) >= WIDTH, runs).otherwise(whole), lambda x: F.shiftrightunsigned(x, 32))
    kept = F.transform(F.filter(upper, lambda x: x < KEEP), lambda x: x.cast("int"))
    return df.withColumn(out, F.sort_array(F.array_distinct(kept))).drop(words, h)


def as_text(sketch: str) -> Column:
    """The sketch as hexadecimal digits, eight a hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str, equal: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(equal, 1.0).when(union == 0, 0.0).otherwise(shared / union)


def containment(a: str, b: str, equal: Column) -> Column:
    """Estimated share of the smaller set that is in the larger one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(equal, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def bucketed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """docs(doc_id, text) with its bucket, (bucket, first, before): the bucket's least id and the bucket before it, and how many tasks the buckets are dealt to.

    There are at most (CELLS + 1) * PARTS buckets, so the second table is small whatever the input.
    """
    spark = docs.sparkSession
    n, bounds = docs.select("doc_id").agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [i / CELLS for i in range(CELLS + 1)], 20 * CELLS)).first()
    bounds = sorted(set(bounds or [0]))
    parts = max(1, min(PARTS, n // (ROWS * len(bounds)) + 1))
    low = F.array(*[F.lit(int(x)) for x in bounds])
    place = F.array(*[F.lit(float(x)) for x in [*bounds, bounds[-1] + 1]])  # as doubles, whose differences don't overflow; their order is that of ids
    cell = F.greatest(F.size(F.filter(low, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0))
    docs = docs.withColumn("cell", cell)
    wide = F.greatest(F.get(place, F.col("cell") + 1) - F.get(place, F.col("cell")), F.lit(1.0))
    span = (F.col("doc_id").cast("double") - F.get(place, F.col("cell"))) / wide
    part = F.least(F.greatest(F.floor(span * parts), F.lit(0)), F.lit(parts - 1))
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("cell") * parts + part).cast("bigint")).drop("cell")
    firsts = [tuple(r) for r in docs.groupBy("bucket").agg(F.min("doc_id")).collect()]
    firsts.sort()
    before = [firsts[i - 1][0] for i in range(len(firsts))]  # the first bucket comes after the last
    tasks = max(1, min(len(firsts), n // (2 * ROWS)))  # in proportion to the rows, so that a task's share doesn't grow
    return docs, spark.createDataFrame([(b, f, p) for (b, f), p in zip(firsts, before, strict=True)], "bucket bigint, first bigint, before bigint"), tasks


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) for each row of docs."""
    rows, firsts, tasks = bucketed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    ring = firsts.agg(F.min("bucket")).first()[0] if firsts.count() else 0
    rows = rows.join(F.broadcast(firsts), "bucket")
    own = F.struct(F.col("bucket"), F.lit(0).alias("turn"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("bucket"), F.when(F.col("bucket") == ring, 1).otherwise(0).alias("turn"), F.lit(True).alias("guest"))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    rows = rows.select("to.*", "doc_id", "text").repartition(tasks, "bucket")
    rows = with_sketch(rows, "text", "sketch")
    order = W.partitionBy("bucket").orderBy("turn", F.col("doc_id").asc_nulls_first(), "text", "guest")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.where(~F.col("guest")).drop("bucket", "turn", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row's whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_sketch(rows, "text", "sketch").select("doc_id", as_text("sketch").alias("fingerprint"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text (second half replaced by the start of the next document) and its next."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    same, next_same = F.col("text") == F.col("edited"), F.col("text") == F.col("next_text")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch", same).alias("near_edited"), likeness("sketch", "next_sketch", next_same).alias("near_next"),
        containment("sketch", "edited_sketch", same).alias("contained_edited"), containment("sketch", "next_sketch", next_same).alias("contained_next"),
    )
