"""Exact top-k by inner product: MaxScore over the shards of a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors searched for, and broadcast, at a time.
BLOCK_BYTES = 8 << 20
#: Terms probed between two looks at who is still competitive.
_STEP = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Queries:
    """A block of query vectors with the best rows found for each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best_ids: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]
        self.best: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]

    def take(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge rows into the best k of query q: higher scores first, then smaller ids."""
        ids, scores = np.concatenate([self.best_ids[q], ids]), np.concatenate([self.best[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best_ids[q], self.best[q] = ids[order], scores[order]

    def bar(self, q: int) -> float:
        """What a row has to reach to be among the best."""
        return float(self.best[q][-1]) if len(self.best[q]) == self.k else -np.inf

    def search(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """MaxScore over one shard of the rows, its terms as posting columns.

        A query's terms are its dimensions, by falling weight.  A suffix of them
        can add |q_rest| * |v_rest| at most, and the sum of each term's largest
        contribution in the shard.  The longest suffix that can't reach the bar
        by itself is non-essential.  The postings of the essential terms are
        traversed; the others are probed, some at a time, for those rows only
        whose score can still reach the bar.
        """
        if not len(ids):
            return
        width = min(rows.shape[1], self.vectors.shape[1])
        rows, queries = rows[:, :width], self.vectors[:, :width]
        largest = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(width, 1)
        if largest >= _EXACT:
            self._search_exact(ids, rows, queries)
            return
        low, high = rows.min(axis=0), rows.max(axis=0)
        postings = np.ascontiguousarray(rows.T)
        squares = postings**2
        for q, vector in enumerate(queries):
            order = np.argsort(-np.abs(vector), kind="stable")
            weights = vector[order]
            each = np.maximum(weights * low[order], weights * high[order])
            after = np.concatenate([np.cumsum(each[::-1])[::-1], [0.0]])
            norm = np.sqrt(np.concatenate([np.cumsum((weights**2)[::-1])[::-1], [0.0]]))
            own = ids == self.ids[q]
            bar = self.bar(q)
            total = np.sqrt(squares.sum(axis=0).max())
            bound = np.minimum(after, norm * total) * (1 + 1e-9) + 1e-6
            split = int(np.argmax(bound < bar)) if (bound < bar).any() else width
            at = np.flatnonzero(~own)
            score = weights[:split] @ postings[order[:split]] if split else np.zeros(len(ids))
            score = score[at]
            left = squares[order[split:]].sum(axis=0)[at] if split < width else None
            done = split
            while done < width:
                most = score + np.minimum(after[done], norm[done] * np.sqrt(np.maximum(left, 0.0)) * (1 + 1e-9) + 1e-6)
                alive = most >= bar
                at, score, left = at[alive], score[alive], left[alive]
                if not len(at):
                    break
                some = order[done : done + _STEP]
                columns = postings[np.ix_(some, at)]
                score = score + vector[some] @ columns
                left = left - (columns**2).sum(axis=0)
                done += len(some)
            alive = score >= bar
            at, score = at[alive], score[alive]
            if len(at) > self.k:
                # ties with the k-th stay for the order by id
                kth = np.partition(score, len(score) - self.k)[len(score) - self.k]
                at, score = at[score >= kth], score[score >= kth]
            if len(at):
                self.take(q, ids[at], score.astype(np.int64))

    def _search_exact(self, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> None:
        """Products that doubles can't hold exactly; scores beyond a long are taken as its limits."""
        whole = [[int(x) for x in row] for row in rows]
        for q, vector in enumerate(queries):
            weights = [int(x) for x in vector]
            scores = [max(-_LONG, min(_LONG, sum(a * b for a, b in zip(weights, row, strict=True)))) for row in whole]
            keep = ids != self.ids[q]
            self.take(q, ids[keep], np.array(scores, dtype=np.int64)[keep])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(lengths.max(initial=0))))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == out.size:
        return values.reshape(out.shape)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; vectors that take part only."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~bad)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `k` rows of the largest inner product.

    Both tables are (vec_id, v) with whole numbers as doubles.  Ties go to the
    smaller vec_id; a query's own rows, those with its vec_id, don't count; with
    fewer than `k` others it gets them all.  Queries of one vec_id are one, the
    smallest vector; repeated rows come as often as they are there.  A shorter
    vector is filled with zeros.  Without queries or rows there is no result.

    Queries are broadcast in blocks of bounded size, one pass over the rows each.
    A task keeps the best `k` per query of its shard; those are merged.
    """
    spark = rows.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    count, longest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, -(-(count or 0) * 8 * max(longest or 1, 1) // block_bytes))
    schema = "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    for part in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").toArrow()
        if not block.num_rows:
            continue
        ids = block.column("vec_id").to_numpy()
        held = spark.sparkContext.broadcast((ids, _matrix(block.column("v").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Queries(*held.value, k)
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    some = batch.slice(start, 4096)
                    search.search(some.column(0).to_numpy(), _matrix(some.column(1)))
            sizes = [len(b) for b in search.best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(search.ids, sizes), pa.int64()),
                    pa.array(np.concatenate([*search.best_ids, np.zeros(0, np.int64)]), pa.int64()),
                    pa.array(np.concatenate([*search.best, np.zeros(0, np.int64)]), pa.int64()),
                ],
                names=["query_id", "vec_id", "score"],
            )

        found = found.union(rows.select("vec_id", "v").mapInArrow(run, schema))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
