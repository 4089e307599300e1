"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

Test items are the indexed documents, passages of training texts the queries.
Impacts are divided by the item's own score (that of the item as a query), so
one threshold holds for all items.  A passage is two consecutive segments, each
as long as the longest item of the index, so a copied item lies in a passage
whole.  Passages whose terms' largest impacts in no run of blocks reach the
threshold are passed over at once; the others go through block-max WAND, which
returns every item above the threshold.  Such an item is a leak if the passage holds enough of
its word shingles, of its question's and of its answer's (the last sentence, or
the second half of an item of one sentence).

Items are indexed in shards of at most SHARD characters, each broadcast, so the
broadcast is bounded whatever the size of the benchmark; the texts are read once
for each shard and never shuffled.

Cases: null and empty texts and items hold nothing; items without words are
never found; a null doc_id or item_id is carried as it is; repeated rows give
repeated results; empty tables give an empty result; `remove_leaks` keeps all columns.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

K1, B = 1.2, 0.75
#: Share of the item's own score that a passage must reach.
THRESHOLD = 0.6
#: Items a block of the postings covers.
BLOCK = 2
#: Runs of blocks whose bounds are summed for every passage.
GROUPS = 128
#: Terms whose bounds are summed at a time.
TERMS = 8192
WIDTH = 5
#: Shares of shingles: of the item, of its question and of its answer.
WHOLE, PART = 0.8, 0.5
#: Characters of the items of one shard.
SHARD = 4_000_000
SENTENCE = re.compile(r"(?<=[.!?])\s+")
LEAKS = "doc_id bigint, item_id bigint, bm25 double, overlap double, question_overlap double, answer_overlap double"


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    parts = [p for p in (textkit.plain_words(s) for s in SENTENCE.split(text.strip())) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = textkit.plain_words(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


class Index:
    """Postings of normalised BM25 impacts with block maxima."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        items = [(i, t) for i, t in items if textkit.plain_words(t)]
        common: dict[bytes, int] = {}
        for _, t in items:
            for w in set(textkit.plain_words(t)):
                common[w] = common.get(w, 0) + 1
        items.sort(key=lambda x: (max((common[w], w) for w in textkit.plain_words(x[1])), len(x[1])))  # like items share a block, so that its bounds are tight
        self.ids = [i for i, _ in items]
        texts = [textkit.plain_words(t) for _, t in items]
        self.longest = max(map(len, texts), default=1)
        self.words = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}))}
        n, mean = len(texts), sum(map(len, texts)) / max(1, len(texts))
        tf: list[dict[int, int]] = []
        df = np.zeros(len(self.words) + 1)
        for t in texts:
            own: dict[int, int] = {}
            for w in t:
                own[self.words[w]] = own.get(self.words[w], 0) + 1
            tf.append(own)
            df[list(own)] += 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        postings: dict[int, list[tuple[int, float]]] = {}
        for d, own in enumerate(tf):
            raw = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(texts[d]) / mean)) for w, f in own.items()}
            total = sum(raw.values())
            for w, x in raw.items():
                postings.setdefault(w, []).append((d, x / total))
        self.items, self.impacts, self.tops = {}, {}, {}
        self.bound = np.zeros(len(self.words))
        run = BLOCK * max(1, -(-len(texts) // (BLOCK * GROUPS)))
        self.groups = np.zeros((len(self.words), -(-len(texts) // run)), np.float32)
        for w, p in postings.items():
            self.items[w] = [d for d, _ in p]
            self.impacts[w] = [x for _, x in p]
            tops: dict[int, float] = {}
            for d, x in p:
                tops[d // BLOCK] = max(tops.get(d // BLOCK, 0.0), x)
            self.tops[w] = tops
            for d, x in p:
                self.groups[w, d // run] = max(self.groups[w, d // run], np.nextafter(np.float32(x), np.float32(2)))
            self.bound[w] = max(self.impacts[w])
        self.parts = []
        for (_, text), words in zip(items, texts, strict=True):
            q, a = question_answer(text)
            self.parts.append([(min(WIDTH, len(x)), set(textkit.shingle_set(textkit.word_hashes(x), WIDTH).tolist())) for x in (words, q, a)])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item whose score for the distinct terms is at least the threshold, by block-max WAND."""
        from bisect import bisect_left

        cursors = [[self.items[t][0], 0, t] for t in terms]  # (item, place, term)
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.bound[c[2]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.tops[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) >= threshold:
                if cursors[0][0] == item:
                    score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold - 1e-9:
                        out.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:  # nothing in this block; the next block, or where another list begins
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            alive = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < target:
                    c[1] = bisect_left(self.items[c[2]], target, c[1])
                    if c[1] == len(self.items[c[2]]):
                        continue
                    c[0] = self.items[c[2]][c[1]]
                alive.append(c)
            cursors = alive
        return out


def finder(index: Index, threshold: float = THRESHOLD):
    """Function of a text to its leaks: (item, score, overlap, question's, answer's), for a task."""
    words, none = index.words, len(index.words)
    segment = index.longest

    def passages(ids: np.ndarray) -> list[tuple[int, list[int]]]:
        """(start, distinct indexed terms) of the passages that could reach the threshold."""
        at = np.flatnonzero(ids < none)
        if not len(at):
            return []
        seg = at // segment
        both = np.concatenate([seg * 2, seg * 2 + 1])  # passage s holds segments s and s + 1; seg is in s and s - 1
        passage = np.where(both % 2 == 0, both // 2, both // 2 - 1)
        key = np.unique(passage[passage >= 0] * (none + 1) + np.concatenate([ids[at], ids[at]])[passage >= 0])
        p, t = key // (none + 1), key % (none + 1)
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        ends = np.append(starts[1:], len(p))
        reach, at = np.empty(len(starts), np.float32), 0
        while at < len(starts):  # some passages at a time: a whole text's terms may be many
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + TERMS, "right")))
            reach[at:stop] = np.add.reduceat(index.groups[t[starts[at] : ends[stop - 1]]], starts[at:stop] - starts[at], axis=0).max(1)
            at = stop
        return [(int(p[a]) * segment, t[a:z].tolist()) for a, z, r in zip(starts.tolist(), ends.tolist(), reach.tolist(), strict=True) if r >= threshold - 1e-4]


    def find(text: str | None) -> list[tuple]:
        own = textkit.plain_words(text)
        get = words.get
        ids = np.fromiter((get(w, none) for w in own), np.int64, len(own))
        best: dict[int, tuple] = {}
        for start, terms in passages(ids):
            found = index.search(terms, threshold)
            if not found:
                continue
            h = textkit.word_hashes(own[start : start + 2 * segment])
            grams: dict[int, set] = {}
            for item, score in found:
                shares = []
                for width, shingles in index.parts[item]:
                    if width not in grams:
                        grams[width] = set(textkit.ngrams(h, width).tolist()) if width else set()
                    shares.append(len(shingles & grams[width]) / len(shingles) if shingles else 1.0)
                if shares[0] >= WHOLE and shares[1] >= PART and shares[2] >= PART:
                    best[item] = max(best.get(item, (0.0,)), (score, *shares))
        return [(item, *x) for item, x in sorted(best.items())]

    return find


def shards(items: DataFrame) -> Iterator[list[tuple]]:
    """The items, in lists of SHARD characters or so."""
    total, n = items.agg(F.sum(F.length("text")), F.count("*")).first()
    parts = math.ceil((total or 0) / SHARD)
    for part in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield sorted(((r.item_id, r.text) for r in rows.select(F.col("item_id").cast("bigint").alias("item_id"), "text").collect()), key=str)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """LEAKS, a row for each item found in a row of docs."""
    spark = docs.sparkSession
    out = None
    for shard in shards(items):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            find = finder(index, threshold)
            for b in itertools.chain.from_iterable(map(textkit.slices, batches)):
                rows = [(i, index.ids[item], *x) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for item, *x in find(t)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(cols)], [x.split()[0] for x in LEAKS.split(", ")])

        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], LEAKS) if out is None else out


def remove_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    for shard in shards(items):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = finder(Index(shared.value), threshold)
            for b in itertools.chain.from_iterable(map(textkit.slices, batches)):
                yield b.filter(pa.array([not find(t) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
