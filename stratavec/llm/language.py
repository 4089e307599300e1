"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1.  A trigram is bound from
its letters' vectors, the first rotated twice and the second once, multiplied
elementwise.  A text bundles (adds) its trigrams; a language's prototype bundles
the unit vectors of its training texts.  The language with the largest cosine wins.

Cases: a null text or one without a letter is `und` with score 0, as is every
text if nothing could be learned; repeated rows are predicted each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .work import held_out

DIMENSIONS = 1024
#: Training texts of each language, on average: those whose hash of doc_id is below a bound for the language.
SAMPLE_ROWS = 500
#: Languages learned, those with most documents.
LANGUAGES = 1000
#: Trigram vectors are dropped from a task's cache beyond this many (128 MB).
CACHE = 1 << 15
UNKNOWN = "und"
SEED = 20_24


class Encoder:
    """Texts to bundled trigram vectors; keeps the vectors of the trigrams it has met."""

    def __init__(self):
        self.kind: dict[int, int] = {}  # code point -> itself if a letter, else 0
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((256, DIMENSIONS), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1
        return self.letters[code]

    def bound(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def grams(self, text: str) -> np.ndarray:
        """Trigrams over letters, any run of other signs being one blank; empty without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known, at = np.unique(codes, return_inverse=True)
        for c in known.tolist():
            if c not in self.kind:
                self.kind[c] = c if chr(c).isalpha() else 0
        codes = np.array([self.kind[c] for c in known.tolist()], np.int64)[at]
        if not codes.any():
            return np.empty(0, np.int64)
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        if len(codes) < 3:
            return np.empty(0, np.int64)
        return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a text; None without a letter."""
        grams = self.grams(text) if text else np.empty(0, np.int64)
        if not len(grams):
            return None
        kinds, n = np.unique(grams, return_counts=True)
        out = np.zeros(DIMENSIONS, np.float32)
        for part in range(0, len(kinds), 4096):
            places = self.places(kinds[part : part + 4096].tolist())
            out += n[part : part + 4096].astype(np.float32) @ self.table[places]
        return out / max(float(np.sqrt(out @ out)), 1e-12)

    def places(self, kinds: list[int]) -> list[int]:
        if len(self.rows) + len(kinds) > CACHE:
            self.rows.clear()
        for g in kinds:
            if g not in self.rows:
                if len(self.rows) == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[len(self.rows)] = self.bound(g)
                self.rows[g] = len(self.rows)
        return [self.rows[g] for g in kinds]


def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, sums = Encoder(), {}
    for b in itertools.chain.from_iterable(map(textkit.slices, batches)):
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if (v := encode.vector(text)) is not None:
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from about `sample_rows` texts a language, all of a language with fewer, outside the held-out fold.

    Counts of languages say how low a document's hash must be, so the sample
    needs no order and depends neither on partitioning nor on other languages.
    """
    few = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = few.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    bounds = docs.sparkSession.createDataFrame([(r.lang, min(1.0, sample_rows / r.n)) for r in sizes], "lang string, bound double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    learned = few.join(F.broadcast(bounds), "lang").where(place < F.col("bound")).select("text", "lang")
    sums: dict[str, np.ndarray] = {}
    for r in sorted(learned.mapInArrow(bundle, "lang string, v binary").collect()):
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(bytes(r.v))
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    p = np.array([sums[x] for x in langs])
    p = p / np.maximum(np.sqrt((p * p).sum(1, keepdims=True)), 1e-12)
    return langs, p.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, prototypes = shared.value
        encode = Encoder()
        for b in itertools.chain.from_iterable(map(textkit.slices, batches)):
            pred, score = [], []
            for text in b.column("text").to_pylist():
                v = encode.vector(text) if langs else None
                if v is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                else:
                    sim = prototypes @ v
                    best = int(sim.argmax())
                    pred.append(langs[best])
                    score.append(float(min(1.0, max(0.0, sim[best]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
