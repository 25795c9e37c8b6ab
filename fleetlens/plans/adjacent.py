"""Previous / next row within a key, for keys of any size.

A window partitioned by the key is right for ordinary keys: one shuffle.  It
would put a hot key into one task, so hot keys are cut by time, level by level:
a row's neighbour is found inside its own slice, and only the first and last
row of each slice go on to the next coarser level.  Every level is exact, and a
task sorts the rows of one ordinary key or of one (hot key, slice).  Both
outcomes of a level read the same shuffle, so the input is read once.

A key is hot when it has more than `HOT_ROWS` rows and more than one in
`HOT_SHARE` of all rows, so there can be at most `HOT_SHARE` hot keys whatever
the size of the data.  That bound is what allows their list to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("MINUTE", "DAY")
HOT_ROWS = 1_000_000
HOT_SHARE = 100_000

_OPEN, _CELL, _EDGE, _VALUE, _HOT = "__open", "__cell", "__edge", "__value", "__hot"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of `df` with more than `hot_rows` rows and their share; at most `HOT_SHARE`."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    everything = sizes.agg(F.sum("__n")).scalar()
    n = F.col("__n")
    return sizes.filter((n > hot_rows) & (n * HOT_SHARE > everything)).select(
        *keys, F.lit(True).alias(_HOT)
    )


def _neighbour(
    df: DataFrame, keys: list[str], ts: str, order: list[str], out: str, levels: Sequence[str], back: bool
) -> DataFrame:
    """`df` has `_VALUE`, `_HOT`, and `_OPEN` where a row still looks for its neighbour."""
    step, other = (F.lag, F.lead) if back else (F.lead, F.lag)
    if not levels:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, step(_VALUE).over(whole)).filter(_OPEN)

    inside = Window.partitionBy(*keys, _CELL).orderBy(*order)
    looked = (
        df.withColumn(_CELL, F.when(F.col(_HOT), F.date_trunc(levels[0], F.col(ts))))
        .withColumn(out, step(_VALUE).over(inside))
        .withColumn(_EDGE, other(_VALUE).over(inside).isNull())
    )
    found = F.col(out).isNotNull()
    answered = looked.filter(F.col(_OPEN) & (found | ~F.col(_HOT))).drop(_CELL, _EDGE)
    rest = (
        looked.filter(F.col(_HOT))
        .withColumn(_OPEN, F.col(_OPEN) & ~found)
        .filter(F.col(_OPEN) | F.col(_EDGE))
        .drop(_CELL, _EDGE, out)
    )
    return answered.unionByName(_neighbour(rest, keys, ts, order, out, levels[1:], back))


def _adjacent(df, keys, ts, order, values, out, levels, sizing, hot_rows, back) -> DataFrame:
    keys = list(keys)
    started = df.withColumn(_VALUE, F.struct(*values)).withColumn(_OPEN, F.lit(True))
    if levels:
        hot = hot_keys(df if sizing is None else sizing, keys, hot_rows)
        started = started.join(F.broadcast(hot), keys, "left").withColumn(
            _HOT, F.coalesce(_HOT, F.lit(False))
        )
    else:
        started = started.withColumn(_HOT, F.lit(False))
    done = _neighbour(started, keys, ts, list(order), out, levels, back)
    return done.drop(_VALUE, _OPEN, _HOT)


def previous_row(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
    values: Sequence[str | Column], out: str = "previous", levels: Sequence[str] = LEVELS,
    sizing: DataFrame | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add struct `out` with the `values` of the row before; NULL for the first.

    `order` must be unique within a key and start with `ts`.  `levels` are
    units of `date_trunc`, finest first.  `sizing` is a cheaper frame with the
    same keys to count rows in; it decides how the work is split, never the
    result.
    """
    return _adjacent(df, keys, ts, order, values, out, levels, sizing, hot_rows, True)


def next_row(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
    values: Sequence[str | Column], out: str = "next", levels: Sequence[str] = LEVELS,
    sizing: DataFrame | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add struct `out` with the `values` of the row after; NULL for the last."""
    return _adjacent(df, keys, ts, order, values, out, levels, sizing, hot_rows, False)
