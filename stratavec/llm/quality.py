"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document's terms are its words and its surface forms (case and trailing
symbols of words, words that repeat the one before, line shapes).  Term counts
of a bounded labelled sample are weighted by tf-idf and reduced by a truncated
SVD; the labelled vectors are broadcast.  Every whole document is projected and
its cosines with all labelled vectors are computed in blocks, exactly; the
nearest vote with weights by similarity.  One pass, no shuffle.

Cases: null and empty texts have no terms, the zero vector, and score the
sample's share of label 1; repeated rows are scored each; an empty table gives
an empty result; without labelled rows the score is 0.5; further columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .work import held_out, labelled_rows

#: Bounds: labelled rows, dimensions of the space, hashed word terms.
SAMPLE_ROWS = 4000
RANK = 48
WORD_TERMS = 2048
#: Surface terms come after the word terms: 8 cases x 8 endings, runs, line shapes.
FORMS = 64
TERMS = WORD_TERMS + FORMS + 32
#: Surface terms weigh so much more than words, of which there are many.
FORM_WEIGHT = 3.0
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 256


class WordTerms(dict):
    """word -> word term * FORMS + form, remembered within a task."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        core = word.strip("!?.,;:*#$%&|\"'()[]{}<>=-_+/\\@^~`")
        case = 0 if not core else 1 if core.islower() else 2 if core.istitle() else 3 if core.isupper() else 4 if core.isdigit() else 5 if any(c.isdigit() for c in core) else 6
        tail = word[len(word.rstrip("!?.,;:*#$%&|=-_+/\\@^~<>")) :]
        end = 0 if not tail else 1 if tail in (".", ",", ";", ":", "?") else 2 if tail[-1] in "!?" else 3 if len(set(tail)) == 1 and len(tail) > 1 else 4 if len(tail) == 1 else 5
        code = self[word] = (xxhash.xxh64_intdigest(core.lower().encode("utf-8", "surrogatepass")) % WORD_TERMS) * FORMS + case * 8 + end
        return code


def counts(text: str | None, cache: WordTerms) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, weights) of a text; weights of surface terms are shares, of words log counts."""
    if not text:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    code = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    n = len(code)
    word = np.bincount(code // FORMS, minlength=WORD_TERMS)
    at = np.flatnonzero(word)
    form = np.bincount(code % FORMS, minlength=FORMS) / n
    same = float((code[1:] == code[:-1]).mean()) if n > 1 else 0.0
    distinct = len(np.unique(code)) / n
    lines = text.count("\n") + 1
    more = np.zeros(32)
    more[0], more[1] = same, 1.0 if same > 0.3 else 0.0
    more[2 + min(7, int(distinct * 8))] = 0.3
    more[10 + min(7, int(np.log2(n / lines + 1)))] = 0.3
    more[18 + min(9, int(np.log10(n + 1) * 2))] = 0.1
    more[28] = min(1.0, text.count("|") / n)
    tail = np.concatenate([form, more])
    on = np.flatnonzero(tail)
    return np.concatenate([at, on + WORD_TERMS]).astype(np.int32), np.concatenate([np.log1p(word[at]), tail[on]]).astype(np.float32)


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordTerms()
    for b in batches:
        for part in textkit.slices(b):
            x = [counts(t, cache) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i.tobytes() for i, _ in x], pa.binary()), pa.array([v.tobytes() for _, v in x], pa.binary()), part.column("y")], ["i", "v", "y"])


def weighted(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Dense tf-idf rows: words and surface terms are scaled to unit length apart, then joined."""
    x = np.zeros((len(rows), TERMS), np.float32)
    for r, (i, v) in enumerate(rows):
        x[r, i] = v
    x[:, :WORD_TERMS] *= idf
    for part, weight in ((x[:, :WORD_TERMS], 1.0), (x[:, WORD_TERMS:], FORM_WEIGHT)):
        norm = np.sqrt((part * part).sum(1, keepdims=True))
        part *= weight / np.maximum(norm, 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple:
    """(idf, projection, labelled vectors, labels) from at most `sample_rows` labelled documents outside the held-out fold."""
    rows = labelled_rows(docs, labels, label, sample_rows)[0].mapInArrow(featurise, "i binary, v binary, y int").collect()
    rows = sorted((bytes(r.i), bytes(r.v), int(r.y > 0)) for r in rows)
    if not rows:
        return np.ones(WORD_TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((1, 1), np.float32), np.array([0.5], np.float32)
    sparse = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v, _ in rows]
    y = np.array([r[2] for r in rows], np.float32)
    df = np.zeros(TERMS)
    for i, _ in sparse:
        df[i] += 1
    idf = np.log((1 + len(rows)) / (1 + df[:WORD_TERMS])).astype(np.float32) + 0.1
    x = weighted(sparse, idf)
    rank = min(RANK, len(rows), TERMS)
    q = np.linalg.qr(x @ (x.T @ (x @ np.random.default_rng(11).standard_normal((TERMS, rank + 16)).astype(np.float32))))[0]
    _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
    projection = np.ascontiguousarray(v[:rank].T, np.float32)
    return idf, projection, unit(x @ projection), y


def vote(vectors: np.ndarray, known: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    sim = vectors @ known.T
    k = min(NEIGHBOURS, len(y))
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sim, near, 1), 0) ** SHARPNESS
    total = w.sum(1)
    return np.where(total > 0, (w * y[near]).sum(1) / np.maximum(total, 1e-30), y.mean())


def score(docs: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        idf, projection, known, y = shared.value
        cache = WordTerms()
        for b in itertools.chain.from_iterable(map(textkit.slices, batches)):
            texts, p = b.column("text").to_pylist(), []
            for at in range(0, len(texts), BLOCK):
                rows = [counts(t, cache) for t in texts[at : at + BLOCK]]
                p.append(vote(unit(weighted(rows, idf) @ projection), known, y))
            p = np.clip(np.concatenate(p) if p else np.empty(0), 0, 1).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
