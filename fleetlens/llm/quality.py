"""Quality of texts, learned from trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import cut_lineage
from .text import NOT_SPACE, Chunk, chunks, texts_of

#: Bins of the byte histogram: ASCII one by one, all other bytes together.
BINS = 129


@dataclass(frozen=True)
class Model:
    """A linear score over standardised features; `prior` is the share of good text."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def features_of(chunk: Chunk) -> np.ndarray:
    """One row a text: byte shares, lengths, and how much of it repeats."""
    shingles = chunk.shingles()
    out = np.zeros((len(chunk.bounds) - 1, BINS + 9))
    for i, row in enumerate(out):
        raw = chunk.raw[chunk.offsets[i] : chunk.offsets[i + 1] - 1]
        a, b = chunk.bounds[i], chunk.bounds[i + 1]
        words, size = chunk.words[a:b], chunk.ends[a:b] - chunk.starts[a:b]
        if len(raw):
            counts = np.bincount(np.minimum(raw, BINS - 1), minlength=BINS)
            row[:BINS] = np.sqrt(counts / len(raw))
        row[BINS:BINS + 2] = np.log1p(len(raw)), np.log1p(len(words))
        if len(words):
            last = chunk.raw[chunk.ends[a:b] - 1]
            own = chunk.text_shingles(i, shingles)
            row[BINS + 2:] = (
                size.mean(),
                size.std(),
                len(np.unique(words)) / len(words) ** 0.8,
                len(np.unique(own)) / len(own),
                (words[1:] == words[:-1]).mean() if len(words) > 1 else 0,
                ((last < 48) | ((last > 57) & (last < 65))).mean(),
                (size == 1).mean(),
            )
    return out


def _features(df: DataFrame, text: str) -> DataFrame:
    """(features, weight) of each text, as the bytes of its row of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, chunk in chunks(texts_of(batch.column(0)), NOT_SPACE):
                found = pa.array([r.tobytes() for r in features_of(chunk)], pa.binary())
                yield pa.RecordBatch.from_arrays([found, batch.column(1).slice(first, len(found))], names=["features", "weight"])

    return df.select(F.col(text).alias("text"), "weight").mapInArrow(run, "features binary, weight long")


def _sample(df: DataFrame, text: str, most: int) -> DataFrame:
    """(text, weight): distinct texts drawn evenly by their hash, with weights that add up to about `most` rows at most.

    A text of n copies weighs its share of `most`, rounded up or down by its
    hash, and is one row however many copies it has.  So the rows are at most
    as many as the weights add up to, also where one text is a third of all.
    """
    rows = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text", F.lit(11)))
    counts = cut_lineage(rows.groupBy("h").agg(F.count("*").alias("n")))
    share = min(1.0, most / max(counts.agg(F.sum("n")).first()[0] or 0, 1))
    place = F.lit(0.5) - F.col("h") / F.lit(2.0**64)
    weight = F.col("n") if share == 1.0 else F.floor(F.col("n") * share + place)
    drawn = counts.select("h", weight.cast("long").alias("weight")).filter("weight > 0")
    return rows.join(F.broadcast(drawn), "h").dropDuplicates(["h"]).select("text", "weight")


def _matrix(df: DataFrame) -> np.ndarray:
    """Features of a sample, a text as often as it weighs."""
    got = _features(df, "text").collect()
    rows = np.stack([np.frombuffer(r.features) for r in got]) if got else np.zeros((0, BINS + 9))
    return np.repeat(rows, [r.weight for r in got], axis=0)


def _logistic(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float = 0.02, decay: float = 1e-3) -> np.ndarray:
    """Weights, bias last, that minimise the non-negative unbiased risk.

    risk = prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]).  Where the
    second part is negative, the step undoes it, as the non-negative estimator asks.
    """
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp.clip(-40, 40))), 1 / (1 + np.exp(-zu.clip(-40, 40)))
        negative = _logistic(-zu).mean() - prior * _logistic(-zp).mean()
        of_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        gradient = -of_negative if negative < 0 else prior * (p.T @ (sp - 1)) / len(p) + of_negative
        gradient[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u, from scores of held-back positives and of u.

    Above any score, u holds at least the share `prior` of what the positives
    hold, and no more where no negative scores as high: the least ratio of the
    two survival functions, over thresholds that keep a third of p at least.
    """
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0, 2 / 3, 41))
    share_p = np.array([(p >= c).mean() for c in cuts])
    share_u = np.array([(u >= c).mean() for c in cuts])
    slack = 1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u))
    return float(np.clip(((share_u + 0.1 * slack) / share_p).min(), 0.05, 0.98))


def learn(
    positives: DataFrame, unlabelled: DataFrame, text: str = "text", most: int = 6000, steps: int = 600
) -> Model:
    """Fit on bounded samples: at most about `most` positives and `most` unlabelled texts, copies counted by weight.

    A first fit, on half of the positives as if all unlabelled text were bad,
    gives scores from which the class prior is estimated; the second minimises the
    positive-unlabelled risk at that prior.  Without positives or without
    unlabelled text nothing is known, and every score is one half.
    """
    p, u = _matrix(_sample(positives, text, most)), _matrix(_sample(unlabelled, text, most))
    # rows arrive in any order; sums must not depend on it
    p, u = (x[np.lexsort(x.T[::-1])] if len(x) else x for x in (p, u))
    mean, scale = np.zeros(BINS + 9), np.ones(BINS + 9)
    if len(p) < 2 or not len(u):
        return Model(mean, scale, np.zeros(BINS + 9), 0.0, 0.5)
    mean, scale = p.mean(axis=0), p.std(axis=0) + 0.02
    p, u = (((x - mean) / scale).clip(-8, 8) for x in (p, u))
    first = _fit(p[::2], u, 0.5, steps)
    prior = estimate_prior(p[1::2] @ first[:-1], u @ first[:-1])
    w = _fit(p, u, prior, steps)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out`, 0 to 1: how likely each whole text is good.

    Null and empty texts are scored alike, as texts without words.  Other
    columns go through; one named like `out` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(features_of(c)) for _, c in chunks(texts_of(batch.column(kept.index(text))), NOT_SPACE)]
            scores = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*kept, out])

    return rows.mapInArrow(run, schema)
