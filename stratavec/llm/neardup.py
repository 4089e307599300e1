"""Near-duplicates: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

1. One pass over whole texts gives each document its shingle-set size, the
   128-bit name of the set and the keys of its sketch.  The sketch is the
   smallest hashes of the set; a key is a run of consecutive retained values.
   Of the union's hashes in order at most a share 1 - t is in one set only, so
   two sets of similarity t or more share runs: for sets within the sketch a
   run is certain, beyond it one is missed in about one of 10^7 pairs that are
   just similar enough.
2. Equal sets are one class (a mergeable aggregate, whatever the copies).
3. Inverted lists: classes in a list are tied to the list's least class, not
   to each other, and the connected families are found.  Lists and families
   only say what may be linked.
4. Within a family the links are exact: a class with too many shingles that no
   other class of the family has can't be linked and leaves (again and again,
   as that frees others); the union size of a pair is bounded by what the two
   have alone; the pairs left are intersected in full unless they are joined
   already.  A family is a task's work up to FAMILY shingles.
5. Larger families are compared by blocks of queries against the whole family,
   spread over all tasks, until what hasn't been a query is one component.

Cases: null and empty texts have no shingles and are linked with nothing; a row
with a null doc_id is counted but linked with nothing and kept; repeated rows
are in one class; rows of one doc_id with unlike texts are each judged by their
own; an empty table gives an empty result; `keep_one` keeps all
columns.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .work import Members, Scratch, components, free_names, spread_join

#: Shingles of a family that one task compares (64 MB of hashes).
FAMILY = 8_000_000
#: Shingles of a block of queries in step 5.
BLOCK = 2_000_000
DESCRIBED = "doc_id bigint, mark bigint, n_shingles bigint, hi bigint, lo bigint, keys array<bigint>"


def runs_of(num: int, den: int) -> tuple[int, int]:
    """(length of the runs, size of the sketch) for similarity num / den or more."""
    return (3, 32) if 100 * num >= 85 * den else (2, 24) if 100 * num >= 80 * den else (2, 32) if 100 * num >= 70 * den else (1, 32)


def text_mark() -> F.Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def list_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set's inverted lists; small sets also use single values."""
    run, size = runs_of(num, den)
    low = shingles[:size]
    keys = textkit.ngrams(low, run)
    if len(shingles) * num <= 8 * den:
        keys = np.concatenate([keys, textkit.ngrams(low, 1)])
    return np.unique(keys).view(np.int64)


def describe(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Step 1, for docs(doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in itertools.chain.from_iterable(map(textkit.slices, batches)):
            n, hi, lo, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                s = textkit.shingle_set(textkit.word_hashes(textkit.words_of(t)), width)
                x = set_name(s)
                n.append(len(s))
                hi.append(x[0])
                lo.append(x[1])
                keys.append(list_keys(s, num, den))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "mark", "n_shingles", "hi", "lo", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_mark().alias("mark"), "text").mapInArrow(rows, DESCRIBED)


class Components:
    """Component labels of a family's members, merged by relabelling."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, i: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[i]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]


def link_family(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A component label for each set, under 100 % exact links of similarity num / den or more."""
    found = Components(len(sets))
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    alone = np.zeros(0, np.int64)
    while len(live) > 1:  # leave those that have too much that nobody shares
        n = np.array([len(sets[i]) for i in live])
        flat = np.concatenate([sets[i] for i in live])
        ids, back, df = np.unique(flat, return_inverse=True, return_counts=True)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        alone = np.add.reduceat((df[back] == 1).astype(np.int64), starts)
        stay = den * (n - alone) >= num * n
        if stay.all():
            break
        live = live[stay]
    if len(live) < 2:
        return found.label
    order = np.argsort(alone, kind="stable")
    mark = np.zeros(len(ids), bool)
    vocabulary = [back[s : s + k] for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
    for at, i in enumerate(order[:-1].tolist()):
        rest = order[at + 1 :]
        rest = rest[found.label[live[rest]] != found.label[live[i]]]
        if not len(rest):
            continue
        most = np.minimum(n[i] - alone[i], n[rest] - alone[rest])
        rest = rest[den * most >= num * (n[i] + n[rest] - most)]
        if not len(rest):
            continue
        mark[vocabulary[i]] = True
        for part in range(0, len(rest), 4096):
            some = rest[part : part + 4096]
            begin = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            shared = np.add.reduceat(mark[np.concatenate([vocabulary[j] for j in some.tolist()])].astype(np.int64), begin)
            hit = some[den * shared >= num * (n[i] + n[some] - shared)]
            if len(hit):
                found.merge(int(live[i]), live[hit])
        mark[vocabulary[i]] = False
    return found.label


LINKED = "hi bigint, lo bigint, component_id bigint"


def link_families(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Step 4 for rows(family, rep, hi, lo, text) dealt and sorted by family: (hi, lo, component_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, members = None, {}

        def linked():
            names = list(members)
            label = link_family([members[x][1] for x in names], num, den)
            least: dict[int, int] = {}
            for x, g in zip(names, label.tolist(), strict=True):
                least[g] = min(least.get(g, members[x][0]), members[x][0])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(*x, least[g]) for x, g in zip(names, label.tolist(), strict=True)], strict=True)], ["hi", "lo", "component_id"])

        for b in batches:
            for f, rep, hi, lo, text in zip(*(b.column(c).to_pylist() for c in ("family", "rep", "hi", "lo", "text")), strict=True):
                if f != family and members:
                    yield linked()
                    members = {}
                family = f
                s = textkit.shingle_set(textkit.word_hashes(textkit.words_of(text)), width)
                if (hi, lo) == set_name(s):  # another text of the same doc_id otherwise
                    members[hi, lo] = rep, s
        if members:
            yield linked()

    return rows.select("family", "rep", "hi", "lo", "text").mapInArrow(run, LINKED)


def link_large(rows: DataFrame, width: int, num: int, den: int, scratch: Scratch, block: int) -> DataFrame:
    """Step 5 for rows(family, rep, hi, lo, n, text): (hi, lo, component_id).

    Each round takes a block of queries, compares it exactly with every row of
    its families in one pass without a shuffle, and adds the links.  Queries
    come from the smaller components first; a family is done when all rows that
    haven't been queries are in one component.
    """
    spark = rows.sparkSession
    rows = scratch.keep(rows, "large")
    nodes = rows.select("family", "rep", "hi", "lo", "n").distinct()
    done = spark.createDataFrame([], "hi bigint, lo bigint")
    labels = nodes.select("hi", "lo", F.col("rep").alias("component_id"))
    links, turn = None, 0
    while True:
        left = nodes.join(labels, ["hi", "lo"]).join(done, ["hi", "lo"], "left_anti")
        sizes = left.groupBy("family", "component_id").agg(F.count("*").alias("members"))
        open_ = sizes.groupBy("family").agg(F.count("*").alias("parts")).where("parts > 1").select("family")
        want = left.join(open_, "family").join(sizes, ["family", "component_id"])
        some = want.orderBy("members", "n", "hi", "lo").select("family", "hi", "lo", "n").limit(4096).collect()
        if not some:
            break
        total, queries = 0, []
        for r in some:
            if queries and total + r.n > block:
                break
            total += r.n
            queries.append((r.family, r.hi, r.lo))
        asked = spark.createDataFrame([q[1:] for q in queries], "hi bigint, lo bigint")
        texts = {(r.hi, r.lo): r.text for r in rows.join(F.broadcast(asked), ["hi", "lo"]).select("hi", "lo", "text").collect()}
        shared = spark.sparkContext.broadcast([(f, hi, lo, texts.get((hi, lo))) for f, hi, lo in queries])

        def compare(batches, shared=shared):
            by: dict[int, list] = {}
            for f, hi, lo, text in shared.value:
                by.setdefault(f, []).append((hi, lo, textkit.shingle_set(textkit.word_hashes(textkit.words_of(text)), width)))
            for f, own in by.items():
                flat = np.concatenate([s for _, _, s in own])
                owner = np.repeat(np.arange(len(own)), [len(s) for _, _, s in own])
                order = np.argsort(flat, kind="stable")
                by[f] = own, flat[order], owner[order], np.array([len(s) for _, _, s in own])
            for b in batches:
                out = []
                for f, hi, lo, text in zip(*(b.column(c).to_pylist() for c in ("family", "hi", "lo", "text")), strict=True):
                    if f not in by:
                        continue
                    own, flat, owner, sizes = by[f]
                    s = textkit.shingle_set(textkit.word_hashes(textkit.words_of(text)), width)
                    if not len(s) or (hi, lo) != set_name(s):
                        continue
                    a, z = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                    hits = np.concatenate([owner[x:y] for x, y in zip(a[z > a].tolist(), z[z > a].tolist(), strict=True)] or [np.empty(0, np.int64)])
                    shared_n = np.bincount(hits, minlength=len(own))
                    for q in np.flatnonzero((shared_n > 0) & (den * shared_n >= num * (sizes + len(s) - shared_n))).tolist():
                        if (own[q][0], own[q][1]) != (hi, lo):
                            out.append((hi, lo, own[q][0], own[q][1]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["hi", "lo", "hi2", "lo2"])

        found = scratch.keep(rows.select("family", "hi", "lo", "text").mapInArrow(compare, "hi bigint, lo bigint, hi2 bigint, lo2 bigint"), f"large-links-{turn}")
        links = found if links is None else links.unionByName(found)
        done = done.unionByName(asked) if turn == 0 else scratch.keep(done.unionByName(asked), f"large-done-{turn}")
        reps = nodes.select("hi", "lo", "rep")
        edges = links.join(reps, ["hi", "lo"]).select(F.col("rep").alias("a"), F.col("hi2").alias("hi"), F.col("lo2").alias("lo")).join(reps, ["hi", "lo"]).select("a", F.col("rep").alias("b"))
        tied = components(spark, edges, "bigint", scratch, f"large-{turn}")
        labels = nodes.join(tied, nodes.rep == tied.node, "left").select("hi", "lo", F.coalesce("label", "rep").alias("component_id"))
        turn += 1
    return labels


def near_duplicates(docs: DataFrame, *args, **kw) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...)."""
    return grouped(docs, *args, **kw).drop("mark")


def grouped(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, family: int = FAMILY, block: int = BLOCK) -> DataFrame:
    """near_duplicates with text_mark as `mark`."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = scratch.keep(describe(docs, width, num, den), "described")
    classes = described.where("doc_id is not null and n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n_shingles").alias("n"))
    classes = scratch.keep(classes, "classes")

    postings = described.where("doc_id is not null and n_shingles > 0").select("hi", "lo", "keys").dropDuplicates(["hi", "lo"]).select("hi", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.min("hi").alias("least"), F.max("hi").alias("most")).where("least < most").select("key", "least")
    ties = postings.join(lists.hint("merge"), "key").where("hi <> least").select(F.col("hi").alias("a"), F.col("least").alias("b")).distinct()
    families = components(spark, scratch.keep(ties, "ties"), "bigint", scratch, "families")
    scratch.drop("ties")

    members = classes.join(families, classes.hi == families.node).select("hi", "lo", "rep", "n", F.col("label").alias("family"))
    members = scratch.keep(members, "members")
    scratch.drop("families-labels")
    sizes = members.groupBy("family").agg(F.sum("n").alias("size"))
    large = sizes.where(F.col("size") > family).select("family")
    wanted = Members(members.select("rep")).pick(docs, "doc_id")
    texts = members.join(wanted.hint("merge"), members.rep == wanted.doc_id).select("family", "rep", "hi", "lo", "n", "text")
    small = texts
    any_large = bool(large.limit(1).count())
    if any_large:
        large = scratch.keep(large, "large-families")
        small = texts.join(large, "family", "left_anti")
    linked = link_families(small.repartition("family").sortWithinPartitions("family"), width, num, den)
    if any_large:
        linked = linked.unionByName(link_large(texts.join(large, "family", "left_semi"), width, num, den, scratch, block))
    linked = linked.groupBy("hi", "lo").agg(F.min("component_id").alias("component_id"))

    named = classes.join(linked, ["hi", "lo"], "left").select("hi", "lo", "members", F.coalesce("component_id", "rep").alias("component_id"))
    named = scratch.keep(named, "named")
    scratch.drop("classes", "members", "large-families", "large")
    out = spread_join(described.drop("keys"), named, ["hi", "lo"], "component_id")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), group)
    return out.select("doc_id", "mark", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs, all columns, that are kept: one of each group, and one of repeated rows; rows of one doc_id with unlike texts are rows of their own."""
    own, mark, text = free_names(docs, "id", "mark", "text")
    kept = grouped(docs, **kw).where("kept and doc_id is not null").select(F.col("doc_id").alias(own), F.col("mark").alias(mark)).distinct()
    rows = docs.where("doc_id is not null").withColumn(text, text_mark())
    one = rows.join(kept, (rows["doc_id"].cast("bigint") == kept[own]) & (rows[text] == kept[mark])).drop(own, mark).dropDuplicates(["doc_id", text]).drop(text)
    return one.unionByName(docs.where("doc_id is null"))
