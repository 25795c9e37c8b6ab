"""Joins with a table that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a checked side is broadcast; of a few numbers each, some MB.
BROADCAST_ROWS = 50_000


def join_checked(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with `side`, a checkpointed table: broadcast if its counted rows are few, else by shuffle."""
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if few else side, on, how)
