"""Benchmark passages in documents, by SimHash fingerprints of item-sized windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, SHINGLE, Chunk, chunks, sequence_hash, texts_of

#: Bits in which the fingerprints of a window and an item may differ.
RADIUS = 12
#: Weighted similarity of shingles from which on a window holds an item.
SIMILARITY = 0.8
#: Bytes of benchmark text taken, and broadcast, at a time.
BLOCK_BYTES = 4_000_000
_BITS = 64


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: weights by shingle, and per length the fingerprints in blocks."""

    ids: list[int]
    lengths: np.ndarray
    shingles: list[np.ndarray]
    #: Per item, the weight of its shingles.
    totals: np.ndarray
    vocabulary: np.ndarray
    weights: np.ndarray
    unknown: float
    prints: np.ndarray
    #: Per fingerprint block: by value, the items that have it.
    tables: list[list[np.ndarray]]


def _cuts() -> list[tuple[int, int]]:
    """(first bit, bits) of RADIUS + 1 blocks: of two prints within RADIUS, one block at least is equal."""
    n = RADIUS + 1
    ends = [round(i * _BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _votes(words: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each word's hash."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of summed votes."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def prepare_items(rows: list[tuple[int, str]], k: int) -> Items:
    """Items with a word at least.  A shingle weighs log(1 + items / items that have it)."""
    chunk = Chunk([t.encode() for _, t in rows], ALNUM)
    every = chunk.shingles(k)
    keep = [i for i in range(len(rows)) if chunk.bounds[i + 1] > chunk.bounds[i]]
    shingles = [np.unique(chunk.text_shingles(i, every, k)) for i in keep]
    vocabulary, counts = np.unique(np.concatenate([*shingles, np.zeros(0, np.uint64)]), return_counts=True)
    n = max(len(keep), 1)
    sums = [_votes(chunk.words[chunk.bounds[i] : chunk.bounds[i + 1]]).sum(axis=0) for i in keep]
    prints = _prints(np.stack(sums)) if sums else np.zeros(0, np.uint64)
    tables = []
    for first, bits in _cuts():
        value = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        tables.append([np.flatnonzero(value == v) for v in range(1 << bits)])
    weights = np.log1p(n / counts)
    return Items(
        ids=[rows[i][0] for i in keep],
        lengths=np.array([chunk.bounds[i + 1] - chunk.bounds[i] for i in keep], dtype=np.int64),
        shingles=shingles,
        totals=np.array([weights[np.searchsorted(vocabulary, s)].sum() for s in shingles]),
        vocabulary=vocabulary,
        weights=weights,
        unknown=math.log1p(n),
        prints=prints,
        tables=tables,
    )


def _within(items: Items, prints: np.ndarray, length: int, longer: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(item, windows) of that length, or of items `longer` than it, whose prints are within RADIUS, found by equal blocks."""
    near: dict[int, list[np.ndarray]] = {}
    for (first, bits), table in zip(_cuts(), items.tables, strict=True):
        value = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        for v in np.unique(value):
            if len(table[v]):
                at = np.flatnonzero(value == v)
                for item in table[v]:
                    if items.lengths[item] > length if longer else items.lengths[item] == length:
                        near.setdefault(int(item), []).append(at)
    for item, parts in near.items():
        at = np.unique(np.concatenate(parts))
        yield item, at[np.bitwise_count(prints[at] ^ items.prints[item]) <= RADIUS]


def _matches(items: Items, chunk: Chunk, i: int, shingles: np.ndarray, k: int, least: float) -> Iterator[tuple[int, int, float]]:
    """(item, first word, similarity) of the best window of text i for each item it holds."""
    a, b = chunk.bounds[i], chunk.bounds[i + 1]
    words = chunk.words[a:b]
    n = len(words)
    if not n or not items.ids:
        return
    own = shingles[a : max(b - k + 1, a)]
    at = np.searchsorted(items.vocabulary, own)
    at[at == len(items.vocabulary)] = 0
    known = items.vocabulary[at] == own
    lengths = np.unique(items.lengths)
    if not known.any():
        lengths = lengths[lengths < k]  # such an item's shingle is its whole sequence
    if not len(lengths):
        return
    some = np.concatenate([[0.0], np.cumsum(np.where(known, items.weights[at], 0.0))])
    # a foreign shingle that comes again within a window counts once: only its first of a text is sure to
    first = np.zeros(n, bool)
    first[np.unique(own, return_index=True)[1]] = True
    strange = np.concatenate([[0], np.cumsum(~known & first[: len(own)])])
    votes = None
    if n >= k and known.any():  # the whole text is the window of items longer than it; known shingles bound what is shared
        window = np.unique(own)
        shared = _weights(items, window, 0.0)
        if (items.totals[items.lengths > n] * least <= shared + 1e-9).any():
            for item, found in _within(items, _prints(_votes(words).sum(axis=0)[None]), n, longer=True):
                same = _similarity(items, window, items.shingles[item]) if len(found) else 0.0
                if same >= least:
                    yield item, 0, same
    for length in lengths[lengths <= n]:
        if length >= k:
            # each distinct foreign shingle of a window adds to the union alone, what is known bounds the intersection
            width = length - k + 1
            starts = np.arange(n - length + 1)
            possible = some[starts + width] - some[starts]
            foreign = strange[starts + width] - strange[starts]
            starts = starts[(possible > 0) & (foreign * items.unknown * least <= possible * (1 - least) + 1e-9)]
        else:
            starts = np.arange(n - length + 1)
        if not len(starts):
            continue
        if votes is None:
            votes = np.concatenate([np.zeros((1, _BITS), np.int32), np.cumsum(_votes(words), axis=0, dtype=np.int32)])
        prints = _prints(votes[starts + length] - votes[starts])
        for item, found in _within(items, prints, int(length)):
            wanted = items.shingles[item]
            best = (0.0, 0)
            for j in found:
                s = int(starts[j])
                window = own[s : s + length - k + 1] if length >= k else None
                if window is None:
                    got = sequence_hash(words[s : s + length])[0]
                    same = 1.0 if len(wanted) == 1 and got == wanted[0] else 0.0
                else:
                    same = _similarity(items, np.unique(window), wanted)
                if same > best[0]:
                    best = (same, s)
            if best[0] >= least:
                yield item, best[1], best[0]


def _weights(items: Items, s: np.ndarray, foreign: float) -> float:
    """Weight of shingles, of which each that no item has weighs `foreign`."""
    at = np.searchsorted(items.vocabulary, s)
    at[at == len(items.vocabulary)] = 0
    return float(np.where(items.vocabulary[at] == s, items.weights[at], foreign).sum())


def _similarity(items: Items, window: np.ndarray, wanted: np.ndarray) -> float:
    """Weight of the shared shingles over the weight of all."""
    weigh = lambda s: _weights(items, s, items.unknown)
    both = weigh(np.intersect1d(window, wanted, assume_unique=True))
    return both / (weigh(window) + weigh(wanted) - both)


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about `most` bytes, by hash of the item."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter(F.length("t") > 0)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // most))
    for part in range(parts):
        got = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()
        if got:
            yield sorted(((r.i, r.t) for r in got), key=lambda r: (r[0] is None, r))


def find_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    k: int = SHINGLE,
    least: float = SIMILARITY,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, tkey, item_id, first_word, n_words, similarity) of each item a document holds.

    Words are runs of letters and digits, A-Z in lower case.  Every window of as
    many words as an item has, at every word of every document, takes part; a
    document shorter than the item takes part as a whole.
    Windows that have too few shingles of the benchmark to reach `least` are
    dropped, which loses none; the others get a 64-bit SimHash of their words.
    Fingerprints are looked up by RADIUS + 1 blocks, one of which is equal where
    two differ in RADIUS bits at most; what is that near is compared exactly, by
    weighted k-word shingles.  The best window of a document and item is given,
    the first of equals.

    Items with no word, and null or empty texts, match nothing.  Rows of equal text match alike, each
    for itself; `tkey` is the hash of the text.  Only the named columns are
    read.  The benchmark is broadcast in blocks of bounded size, one pass over
    the documents each.
    """
    schema = "doc_id long, tkey long, item_id long, first_word int, n_words int, similarity double"
    spark = documents.sparkSession
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tkey"), F.col(text).alias("text")
    )
    found = None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        held = spark.sparkContext.broadcast(prepare_items(block, k))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out: list[tuple] = []
                for first, chunk in chunks(texts_of(batch.column(2)), ALNUM):
                    shingles = chunk.shingles(k)
                    for i in range(len(chunk.bounds) - 1):
                        n = int(chunk.bounds[i + 1] - chunk.bounds[i])
                        for item, word, same in _matches(items, chunk, i, shingles, k, least):
                            out.append((ids[first + i], keys[first + i], items.ids[item], word, min(int(items.lengths[item]), n), same))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "tkey", "item_id", "first_word", "n_words", "similarity"],
                )

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found
