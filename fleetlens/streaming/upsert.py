"""A table of newest rows by key, kept in hash buckets of which a batch rewrites those it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

BUCKETS = 64

_BUCKET, _LIVE = "bucket", "live"


class UpsertTable:
    """Rows of `schema`, one folder per hash bucket of their `keys`.

    `merge` overwrites the partitions of the touched buckets together (dynamic partition
    overwrite); the others keep their files.  Merging the same batch again
    gives the same rows, so a batch that is repeated after a failure changes nothing, also
    where the first attempt replaced a part of its buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets
        empty = self._placed(spark.createDataFrame([], schema))
        empty.write.mode("ignore").partitionBy(_BUCKET).parquet(path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return rows.select(*self.schema.fieldNames()).withColumn(_LIVE, F.lit(True)).withColumn(_BUCKET, bucket)

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(_LIVE, BooleanType()), StructField(_BUCKET, IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().filter(_LIVE).drop(_LIVE, _BUCKET)

    def merge(self, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the touched buckets by `step(their rows, changes)`; returns the buckets.

        `step` must give the same when the changes are in the rows already, and
        keep every row in its bucket, that is leave the keys alone.
        """
        placed = self._placed(changes)
        # at most one number a bucket
        touched = sorted(r[0] for r in placed.select(_BUCKET).distinct().collect())
        if not touched:
            return []
        old = self._stored().filter(_LIVE).filter(F.col(_BUCKET).isin(touched)).select(*self.schema.fieldNames())
        left = self._placed(step(old, placed.select(*self.schema.fieldNames())))
        # a bucket that lost all its rows is overwritten too: each has one row that isn't live
        nulls: list[Column] = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        marks = self.spark.createDataFrame([(b,) for b in touched], f"{_BUCKET} int").select(*nulls, F.lit(False).alias(_LIVE), _BUCKET)
        both = left.unionByName(marks).hint("rebalance", _BUCKET)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)
        return touched


def newest(keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A step that keeps each key's row with the greatest `order`."""

    def step(old: DataFrame, changes: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in keys and c not in order]
        best = old.unionByName(changes).groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("s"))
        return best.select(*keys, "s.*")

    return step
