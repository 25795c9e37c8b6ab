"""Reading the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Bytes of files one task reads; of shuffled rows, half as many.
TASK_READS = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every operator relies on; all are runtime settings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a skewed join side even where that costs a further shuffle
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # a task's hash maps and sorts grow with what it reads: a quarter of the default sizes, of files and of shuffles
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_READS))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_READS // 2))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of the files at its path.

    The path is given as a glob: it may be one file or a folder of files.
    """
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")
