"""Text lists per group in long form: one row per group and distinct text, at every size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(
    df: DataFrame, keys: Sequence[str], lines: Mapping[str, str], totals: Callable[[Column], Sequence[Column]] | None = None
) -> DataFrame:
    """(keys, one column per entry of `lines`, copies, totals of the whole group).

    `lines` maps an output column to a text column; `copies` is how often a row
    of texts occurs.  Repeated texts are counted before the shuffle, so neither a
    hot group nor a hot text ends in one task, and no text is built that grows
    with the group.  `totals` gets the copies and returns aggregates over the
    distinct rows; they come from a second, small aggregate.
    """
    keys = list(keys)
    renamed = [F.col(text).alias(out) for out, text in lines.items()]
    copies = df.select(*keys, *renamed).groupBy(*keys, *lines).agg(F.count("*").alias("copies"))
    if totals is None:
        return copies
    return copies.join(copies.groupBy(*keys).agg(*totals(F.col("copies"))), keys)
