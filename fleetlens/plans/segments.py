"""The row before, within keys of any size: a segmented scan over range partitions.

Rows are range-partitioned by key and order and sorted, once.  So a hot key
spans as many tasks as its rows ask for, and small keys share one, without
anything being counted before.  Inside a partition the row before is the one
above; only a partition's first row has it elsewhere, as the last row of the
partition before.  Those edges, two rows a partition at most, are matched after
the scan's rows have been written, so no row is shuffled or computed twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixpoint import cut_lineage

_PART, _VALUE, _FIRST, _LAST = "__part", "__value", "__first", "__last"


def _same(above: pa.Array, here: pa.Array) -> np.ndarray:
    """Where two columns are equal, nulls too."""
    equal = pc.fill_null(pc.equal(above, here), False)
    return pc.or_(equal, pc.and_(pc.is_null(above), pc.is_null(here))).to_numpy(zero_copy_only=False)


def _scan(keys: list[int], value: int):
    """Of sorted batches of one partition: the value of the row above where the keys agree, and which rows are the edges.

    A batch waits for the next one, to know whether its last row is the partition's.
    """

    def finish(columns: list[pa.Array], first: bool, last: bool) -> pa.RecordBatch:
        own = columns.pop(value)
        n = len(own)
        ends = np.zeros((2, n), dtype=bool)
        ends[0, 0], ends[1, -1] = first, last
        kept = own.take(pa.array(np.arange(n), mask=~ends[1]))  # of other rows nothing is asked
        columns += [kept, pa.array(ends[0]), pa.array(ends[1])]
        return pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: list[pa.Array] | None = None
        waiting, first = None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            told = [batch.column(i) for i in (*keys, value)]
            before = [pa.nulls(1, c.type) for c in told] if above is None else above
            joined = [pa.concat_arrays([b, c]) for b, c in zip(before, told, strict=True)]
            same = np.ones(n, dtype=bool)
            for k in joined[:-1]:
                same &= _same(k[:n], k[1:])
            same[0] &= above is not None
            previous = joined[-1].take(pa.array(np.arange(n), mask=~same))
            if waiting is not None:
                yield finish(waiting, first, False)
                first = False
            waiting, above = [*batch.columns, previous], [c[n - 1 :] for c in told]
        if waiting is not None:
            yield finish(waiting, first, True)

    return run


def row_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str | Column], out: str = "previous"
) -> DataFrame:
    """Add struct `out` with the `values` of the row before within the keys; NULL for the first.

    `order` must be unique within a key; nulls come first.  Null keys are one
    key.  An empty table gives none.  Columns named like `out` are replaced.
    """
    keys = list(keys)
    df = df.drop(out)
    named = df.withColumn(_VALUE, F.struct(*values))
    by = [F.col(c) for c in (*keys, *order)]
    dealt = named.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_PART, F.spark_partition_id())
    value = dealt.schema[_VALUE].dataType
    at = {c: i for i, c in enumerate(dealt.columns)}
    schema = T.StructType(
        [f for f in dealt.schema.fields if f.name != _VALUE]
        + [T.StructField(out, value), T.StructField(_VALUE, value), T.StructField(_FIRST, T.BooleanType()), T.StructField(_LAST, T.BooleanType())]
    )
    scanned = cut_lineage(dealt.mapInArrow(_scan([at[k] for k in keys], at[_VALUE]), schema))

    # one row a partition, so one window over all of them is small
    ends = scanned.filter(_LAST).select(_PART, _VALUE, *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)])
    carried = ends.withColumn("__to", F.lead(_PART).over(Window.orderBy(_PART))).drop(_PART).withColumnRenamed(_VALUE, "__carried")
    met = F.col(_PART) == F.col("__to")
    for i, k in enumerate(keys):
        met &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    first = scanned.filter(_FIRST).join(carried, met, "left").withColumn(out, F.col("__carried"))
    columns = [F.col(c) for c in (*df.columns, out)]
    return scanned.filter(~F.col(_FIRST)).select(*columns).union(first.select(*columns))
