"""Row numbers within keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut_lineage


def numbered(df: DataFrame, key: str, order: Sequence[Column], out: str) -> DataFrame:
    """Add `out`: 1, 2, ... within `key` by `order`, which must be unique.

    Rows are range-partitioned by (key, order), so a hot key spans several
    ranges.  The range a row fell into is written with it (checkpoint), rows
    are numbered inside (key, range), and the rows of earlier ranges are added.
    """
    ranged = cut_lineage(
        df.repartitionByRange(F.col(key), *order).withColumn("__range", F.spark_partition_id())
    )
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order))
    return (
        ranged.withColumn(out, inside)
        .join(offsets, [key, "__range"])
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop("__range", "__before")
    )
