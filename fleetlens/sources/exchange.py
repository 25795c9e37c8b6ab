"""Collected datasets: writing, reading back, routing, and raw event documents."""

from __future__ import annotations

import re
from datetime import date
from typing import NamedTuple

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..functions.semantics import KEY
from ..plans.fixpoint import cut_lineage

TAG = "drop"
_DAY = "snapshot_day"

EVENT_SCHEMA = (
    "STRUCT<_timestamp: STRING, data: ARRAY<STRUCT<_name: STRING, type: STRUCT<_name: STRING>, value: STRING>>>"
)


def safe_name(dataset: str) -> str:
    """Letters, digits, `-` and `_` only."""
    return re.sub(r"[^0-9A-Za-z_-]", "", dataset)


def write_dataset(
    df: DataFrame, path: str, dataset: str, runtime: str, mode: str = "append", format: str = "parquet"
) -> str:
    """Write one dataset below `path`, one folder per instance and run, as Parquet or XML.

    Folders are named `[instance]_dataset_runtime`, as collected files are.
    Returns the folder of the dataset.  Rows are rebalanced by instance first:
    small instances share a task and leave one file each, and the rows of a hot
    one are split over several tasks by the adaptive engine.
    """
    name = safe_name(dataset)
    target = f"{path}/{name}"
    tag = F.concat(F.lit("["), F.col(KEY), F.lit(f"]_{name}_{runtime}"))
    tagged = df.withColumn(TAG, tag).drop(KEY).hint("rebalance", TAG)
    writer = tagged.write.mode(mode).partitionBy(TAG).format(format)
    writer.options(**(_XML if format == "xml" else {})).save(target)
    return target


#: A row per element; times to the microsecond.
_XML = {"rowTag": "row", "rootTag": "table", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_CORRUPT = "corrupt_record"


class Collected(NamedTuple):
    """Rows that could be read, and the records that couldn't, by file."""

    rows: DataFrame
    broken: DataFrame


def read_collected_xml(spark: SparkSession, path: str, schema: str, row_tag: str = "row") -> Collected:
    """Collected XML documents of all instances, with `instance_guid` and `dataset`.

    The schema is declared, so nothing is inferred from the files.  A record that breaks off or holds
    a value of another type is kept apart, with its instance, dataset, file and
    text; the records before it in its file are rows.  The documents are parsed once,
    and both tables read what was parsed.
    """
    read = spark.read.format("xml").options(**_XML | {"rowTag": row_tag}).option("columnNameOfCorruptRecord", _CORRUPT)
    found = read.schema(f"{schema}, {_CORRUPT} string").load(path)
    tag = F.col(TAG) if TAG in found.columns else F.url_decode(F.col("_metadata.file_name"))
    parsed = found.select(
        *[c for c in found.columns if c != TAG], instance_of(tag).alias(KEY), dataset_of(tag).alias("dataset"),
        F.col("_metadata.file_path").alias("file"),
    )
    named = cut_lineage(parsed)
    good = named.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT, "file")
    broken = named.filter(F.col(_CORRUPT).isNotNull()).select(KEY, "dataset", "file", F.col(_CORRUPT).alias("record"))
    return Collected(good, broken.distinct())


def instance_of(tag: Column) -> Column:
    """`[inst_1]_x` gives inst_1, `inst_x_y` gives inst."""
    return F.when(tag.startswith("["), F.regexp_extract(tag, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(tag, r"^([^_.]*)", 1)
    )


def dataset_of(tag: Column) -> Column:
    """The part between the instance and a trailing run time."""
    rest = F.regexp_replace(tag, r"^(\[[^\]]*\]|[^_]*)_", "")
    return F.regexp_replace(F.regexp_replace(rest, r"\.\w+$", ""), r"_\d{8,14}$", "")


def read_collected(
    spark: SparkSession, path: str, format: str = "parquet", row_tag: str = "row", schema: str | None = None
) -> DataFrame:
    """Collected rows of all instances, with `instance_guid` and `dataset`.

    The tag is the `drop=` folder where there is one, the file name otherwise.
    """
    reader = spark.read.format(format)
    if format == "xml":
        reader = reader.option("rowTag", row_tag)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.load(path)
    tag = F.col(TAG) if TAG in rows.columns else F.url_decode(F.col("_metadata.file_name"))
    return rows.withColumn(KEY, instance_of(tag)).withColumn("dataset", dataset_of(tag)).drop(TAG)


def route_by_dataset(files: DataFrame, routes: dict[str, str], tag: str = "name") -> DataFrame:
    """`files` with the `target` of the first route whose pattern its name matches.

    Patterns use `*` and `?`.  Write the result partitioned by `target`; names
    no route matches have a NULL target.
    """
    target = F.coalesce(
        *[
            F.when(F.col(tag).rlike("(?i)^" + _glob(pattern) + "$"), F.lit(to))
            for pattern, to in routes.items()
        ],
        F.lit(None).cast("string"),
    )
    return files.withColumn("target", target)


def write_routed(routed: DataFrame, path: str, mode: str = "append") -> None:
    """Routed rows in one folder per target; rows without a target are not written."""
    placed = routed.filter(F.col("target").isNotNull()).hint("rebalance", "target")
    placed.write.mode(mode).partitionBy("target").parquet(path)


def write_snapshots(df: DataFrame, path: str, ts: str, mode: str = "append", period: str = "day") -> None:
    """Dated rows in one folder per day (or month), so retention drops or skips whole folders."""
    day = F.date_trunc(period, F.to_date(F.col(ts))).cast("date").alias(_DAY)
    df.select("*", day).hint("rebalance", _DAY).write.mode(mode).partitionBy(_DAY).parquet(path)


def expire_snapshots(path: str, before: date, period: str = "day") -> list[str]:
    """Drop the folders of `write_snapshots` that lie wholly before a day; returns their names.

    Only folders are listed and removed: no row is read, and no kept file written again.
    The path is one that Arrow's file systems open (file, HDFS, S3, GCS).
    """
    store, root = FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
    days = [f for f in store.get_file_info(FileSelector(root)) if f.base_name.startswith(f"{_DAY}=")]
    first = before if period == "day" else before.replace(day=1)
    old = sorted(f.base_name for f in days if f.base_name.removeprefix(f"{_DAY}=") < first.isoformat())
    for name in old:
        store.delete_dir(f"{root}/{name}")
    return old


def read_snapshots(spark: SparkSession, path: str, schema: StructType, since: date, period: str = "day") -> DataFrame:
    """Dated rows of the folders from a day on; the others aren't opened.  Within the first the reader's own filter decides."""
    rows = spark.read.schema(StructType([*schema.fields, StructField(_DAY, DateType())])).parquet(path)
    first = since if period == "day" else since.replace(day=1)
    return rows.filter(F.col(_DAY) >= F.lit(first)).drop(_DAY)


def _glob(pattern: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)


def shred_events_xml(raw: DataFrame, destination: str = "0x0000001c") -> DataFrame:
    """Login failures from event documents: (instance, event_ts, login_name).

    Each failure is recorded once per destination; only `destination` is kept.
    The login stands between quotes after the fixed opening of the message.
    """
    event = raw.withColumn("e", F.from_xml("event_xml", EVENT_SCHEMA))

    def value(condition) -> Column:
        return F.filter("e.data", condition).getItem(0).getField("value")

    sent_to = value(lambda d: d["type"]["_name"] == "error_destination")
    text = value(lambda d: d["_name"] == "message")
    keep = [c for c in raw.columns if c != "event_xml"]
    return (
        event.select(
            *keep, F.to_timestamp("e._timestamp").alias("event_ts"),
            F.regexp_extract(text, r"^.{23}(.*?)'\.", 1).alias("login_name"),
            sent_to.alias("destination_code"),
        )
        .filter(F.col("destination_code") == destination)
    )
