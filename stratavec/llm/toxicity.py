"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each document is the set of its hashed features: words, adjacent pairs and
pairs that skip one word.  Per-coordinate learning rates and an L1 term leave
few weights, which are broadcast as two short arrays.  Scoring is one pass
over whole texts, without a shuffle.

Cases: null and empty texts have no features and get the score of the bias;
repeated rows are scored each; an empty table gives an empty result; without
labelled rows every score is that of the prior (PRIOR) and nothing is rejected;
further columns of the input are kept by `reject` and ignored by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .work import held_out, labelled_rows

#: Bounds of the training sample and the feature space.
SAMPLE_ROWS = 6000
BITS = 21
EPOCHS = 8
ALPHA, BETA, L1, L2 = 4.0, 1.0, 3.0, 0.0
#: A feature is learned only if so many documents of the sample have it.
SEEN = 3
#: Rows of (toxic, other) that are added to the labelled ones' counts when the bias is set.
PRIOR = (0.5, 4.5)
THRESHOLD = 0.5


def features(h: np.ndarray) -> np.ndarray:
    """Feature numbers of a word-hash sequence, with repeats."""
    if not len(h):
        return np.empty(0, np.int64)
    every = np.concatenate([textkit.ngrams(h, 1), textkit.ngrams(h, 2), textkit.ngrams(h, 2, step=2)])
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in textkit.slices(b):
            x = [np.unique(features(textkit.word_hashes(textkit.plain_words(t)))).astype(np.int32).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), part.column("y")], ["x", "y"])


def train(rows: list[tuple[bytes, int]], known: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) after EPOCHS passes in a fixed order.

    The sample may hold a larger share of toxic rows than there are labelled
    ones; `known`, the counts of labelled (toxic, other) rows, sets the bias right.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    seen = np.zeros(size, np.int32)
    for x, _ in rows:
        seen[np.frombuffer(x, np.int32)] += 1
    data = sorted((x, int(y > 0)) for x, y in rows)
    order = np.random.default_rng(7)

    def weights(at):
        zz = z[at]
        lam = np.where(at == size, 0.0, L1)  # the bias isn't shrunk
        return np.where(np.abs(zz) <= lam, 0.0, -(zz - np.sign(zz) * lam) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(data)):
            x, y = data[i]
            at = np.frombuffer(x, np.int32)
            at = np.append(at[seen[at] >= SEEN].astype(np.int64), size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    ids = np.flatnonzero(w[:size])
    toxic = sum(y for _, y in data)
    prior = np.log((known[0] + PRIOR[0]) / (known[1] + PRIOR[1])) - np.log((toxic + 0.5) / (len(data) - toxic + 0.5))
    return ids.astype(np.int32), w[ids].astype(np.float32), float(w[size] + prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple:
    """Learns from at most `sample_rows` labelled documents outside the held-out fold."""
    own, known = labelled_rows(docs, labels, label, sample_rows, balanced=True)
    rows = own.mapInArrow(featurise, "x binary, y int").collect()
    return train([(bytes(r.x), r.y) for r in rows], known)


def scorer(model):
    """Function of texts to probabilities, for a task."""
    ids, weights, bias = model.value
    table = np.zeros(1 << BITS, np.float32)
    table[ids] = weights

    def score(texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            x = features(textkit.word_hashes(textkit.plain_words(t)))
            x = np.unique(x[table[x] != 0])
            out[i] = 1 / (1 + np.exp(-np.clip(float(table[x].sum()) + bias, -30, 30)))
        return out

    return score


def score(docs: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = scorer(shared)
        for b in batches:
            for part in textkit.slices(b):
                p = of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = scorer(shared)
        for b in batches:
            for part in textkit.slices(b):
                yield part.filter(pa.array(of(part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
