"""Word and shingle hashing shared by the Python operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of text that a task works on at a time, unless a single text is longer.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes of `column` (or one row), so that what a task derives from texts is bounded by bytes, not rows."""
    most = most or SLICE
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; calling the hash is cheaper than remembering so many words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and 0x09-0x0D, with A-Z in lower case (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: ASCII other than letters and digits becomes a space.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation and symbols, in lower case."""
    return text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(h: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """A hash for each run of `width` word hashes taken every `step` words; none if the sequence is shorter."""
    n = len(h) - (width - 1) * step
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, width * 1000 + step, np.uint64)
    for j in range(width):
        acc = acc * MULTIPLIER + h[j * step : j * step + n]
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle, an empty one has none."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(ngrams(h, min(width, len(h))))
