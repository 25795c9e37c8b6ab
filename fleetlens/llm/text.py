"""Vectorised hashing of words and shingles over batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; one longer text is taken by itself.
CHUNK_BYTES = 1 << 20
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes: all but space and tab to carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: letters and digits, and every byte beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALNUM[_a:_b] = True

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; as many as a usual chunk needs are kept for the next call."""
    have = _powers.get(kind, np.ones(1, dtype=np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 2 * CHUNK_BYTES:
        _powers[kind] = have
    return have[:n]


#: Bytes of rows that go to a Python worker at a time, so that its memory doesn't grow with the texts.
BATCH_BYTES = 8 << 20


def bounded_batches(spark) -> None:
    """Rows go to Python workers in batches of BATCH_BYTES, one longer text by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a sequence of word hashes; of k words it is their shingle's."""
    out = np.full(1, len(words), dtype=np.uint64)
    for w in words:
        out = mix(out * np.uint64(_BASE) + w)
    return out


class Chunk:
    """Words of several texts: 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        inside = word_bytes[raw]
        inside[offsets[1:] - 1] = False
        edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LOWER[raw].astype(np.uint64) * _power("up", _BASE, len(raw)), out=sums[1:])
        self.words = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(raw))[starts])
        self.bounds = np.searchsorted(starts, offsets)
        self.raw, self.offsets = raw, offsets
        self.starts, self.ends = starts, ends

    def shingles(self, k: int = SHINGLE) -> np.ndarray:
        """Hash of the k words from each word on; those that cross texts are for nobody."""
        n = max(len(self.words) - k + 1, 0)
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(_BASE) + self.words[i : i + n])
        return out

    def text_shingles(self, i: int, all_shingles: np.ndarray, k: int = SHINGLE) -> np.ndarray:
        """Of text i, in order; a text of fewer than k words has one, its whole sequence."""
        a, b = self.bounds[i], self.bounds[i + 1]
        if b - a >= k:
            return all_shingles[a : b - k + 1]
        if b == a:
            return np.zeros(0, dtype=np.uint64)
        return sequence_hash(self.words[a:b])


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], word_bytes: np.ndarray) -> Iterator[tuple[int, Chunk]]:
    """(index of the first text, chunk) for runs of about CHUNK_BYTES."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield first, Chunk(texts[first:i], word_bytes)
            first, size = i, 0
        size += len(t) + 1
    if size:
        yield first, Chunk(texts[first:], word_bytes)
