"""Packing: minimum bin slack by a bitset subset-sum.

A document's ids are cut at every `window`; full pieces are sequences of their
own.  What remains of each document is shorter than a window; windows are
filled from the multiset of remaining lengths: the longest one is placed, a
bitset of reachable sums says how full the rest can get, and the counts of each
length are read back from the bitsets.  Ids aren't needed for that, so a task
holds a few numbers a document, for BATCH documents at a time, and packs what
it has tokenised itself: no shuffle, and nothing that grows with the input.

Cases: a null text is empty and is the final id alone; repeated rows are packed
each; an empty table gives an empty result; further columns are ignored; very
long texts become many full pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
BATCH = 32768
VOCABULARY = "byte_bpe_50k"
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def encoder(vocabulary: str = VOCABULARY):
    """texts -> lists of ids, as the tokenizers file gives them without added special tokens.

    The same vocabulary as ranks is several times faster; the file itself is
    used for a text that the fast encoder refuses.
    """
    import tiktoken
    import tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"))}
    slow: list = []

    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # the regex engine's stack, raised as a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            if not slow:
                slow.append(tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of a sub-multiset of counts whose sum is the largest not over room."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, counts[length], reach))
        left, part = min(counts[length], room // length), 1
        while left > 0:  # counts by doubling: each number of copies is a sum of these parts
            take = min(part, left)
            reach |= reach << (length * take)
            left -= take
            part *= 2
        reach &= mask
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
        if used:
            picked.append((length, used))
    return picked


def pack(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Numbers of the items in each window; every item is in one window."""
    pool = defaultdict(list)
    for i, n in enumerate(lengths):
        pool[n].append(i)
    counts = {n: len(x) for n, x in pool.items()}
    out = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        if not counts[largest]:
            del counts[largest]
        need = defaultdict(int, {largest: 1})
        for n, k in fill(counts, window - largest):
            need[n] += k
        counts[largest] = counts.get(largest, 0) + 1
        times = min(counts[n] // k for n, k in need.items())  # the same filling as often as the counts allow
        for n, k in need.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        for _ in range(times):
            out.append([pool[n].pop() for n, k in need.items() for _ in range(k)])
    return out


def pack_documents(docs: DataFrame, window: int = WINDOW, batch: int = BATCH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        rows: list[tuple] = []
        rest: list[tuple] = []

        def emit():
            nonlocal sequence, rows, rest
            for items in pack([r[2] for r in rest], window):
                at = 0
                for i in items:
                    rows.append((*rest[i], sequence, at))
                    at += rest[i][2]
                sequence += 1
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)
            rows, rest = [], []
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    if len(piece) == window:
                        rows.append((*row, sequence, 0))
                        sequence += 1
                    else:
                        rest.append(row)
                if len(rest) >= batch or len(rows) >= 4 * batch:
                    yield emit()
        if rows or rest:
            yield emit()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
