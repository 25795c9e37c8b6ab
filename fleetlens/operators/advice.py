"""Maintenance decisions as data; nothing is ever executed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import KEY, instant, seconds_between
from ..plans.ranking import numbered

# fixed values: class keywords of an object selection
KEYWORDS = ("ALL_DATABASES", "SYSTEM_DATABASES", "USER_DATABASES", "AVAILABILITY_GROUP_DATABASES")

# fixed values: default actions per fragmentation group, in order of preference
DEFAULT_PREFERENCES: dict[str, tuple[str, ...]] = {
    "Low": (),
    "Medium": ("INDEX_REORGANIZE", "INDEX_REBUILD_ONLINE", "INDEX_REBUILD_OFFLINE"),
    "High": ("INDEX_REBUILD_ONLINE", "INDEX_REBUILD_OFFLINE"),
}


def _item(text: str) -> tuple[Column, bool]:
    """Condition of one list item and whether it includes."""
    include = not text.startswith("-")
    text = text if include else text[1:]
    condition = F.lit(True)
    if text.upper() in KEYWORDS:
        keyword, text = text.upper(), "%"
        if keyword == "SYSTEM_DATABASES":
            condition = F.col("is_system")
        elif keyword == "USER_DATABASES":
            condition = ~F.col("is_system")
        elif keyword == "AVAILABILITY_GROUP_DATABASES":
            condition = F.col("in_availability_group")
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    # only % is a wildcard here
    pattern = text.replace("\\", "\\\\").replace("_", "\\_")
    return condition & F.col("name").ilike(pattern), include


def select_objects(objects: DataFrame, expression: str, delimiter: str = ",") -> DataFrame:
    """Objects an expression such as `USER_DATABASES,-temp%,[x]` selects.

    Excludes win.  `position` is the first including item that matches.  The
    items are a parameter, so they become one predicate of the scan instead of
    a join.  `objects` has name, is_system and in_availability_group.
    """
    includes: list[tuple[int, Column]] = []
    excluded = F.lit(False)
    for n, raw in enumerate(expression.split(delimiter), start=1):
        text = raw.strip()
        if not text:
            continue
        condition, include = _item(text)
        if include:
            includes.append((n, condition))
        else:
            excluded = excluded | condition
    position = F.coalesce(*[F.when(c, n) for n, c in includes], F.lit(None).cast("int"))
    return objects.withColumn("position", position).filter(F.col("position").isNotNull() & ~excluded)


def selectable_databases(databases: DataFrame, group_databases: DataFrame) -> DataFrame:
    """Databases with their class; tempdb and snapshots are never selectable."""
    grouped = group_databases.select(KEY, "database_id", F.lit(True).alias("grouped")).distinct()
    system = F.lower("name").isin("master", "msdb", "model")
    if "is_distributor" in databases.columns:
        system = system | F.col("is_distributor")
    return (
        databases.filter((F.lower("name") != "tempdb") & F.col("source_database_id").isNull())
        .join(grouped, [KEY, "database_id"], "left")
        .select(
            KEY, "database_id", "name", system.alias("is_system"),
            F.coalesce("grouped", F.lit(False)).alias("in_availability_group"),
        )
    )


ORDERS: dict[str, str] = {
    "DATABASE_NAME": "name", "DATABASE_SIZE": "size_mb", "DATABASE_LAST_GOOD_CHECK": "last_good_check",
    "REPLICA_LAST_GOOD_CHECK": "last_command_time",
}


def rank_objects(objects: DataFrame, order: str | None = None) -> DataFrame:
    """Selected objects numbered per instance, ties by name.

    `order` is one of `ORDERS` with `_ASC` or `_DESC`; without it the selection
    position decides.  Unknown times come first when ascending.
    """
    if order is None:
        keys = [F.asc("position"), F.asc("name")]
    else:
        column, _, direction = order.rpartition("_")
        if column not in ORDERS or direction not in ("ASC", "DESC"):
            raise ValueError(f"unknown order: {order}")
        c = ORDERS[column]
        first = F.asc_nulls_first(c) if direction == "ASC" else F.desc_nulls_last(c)
        keys = [first] if c == "name" else [first, F.asc("name")]
    return numbered(objects, KEY, keys, "object_order")


def allowed_actions(index_stats: DataFrame) -> dict[str, Column]:
    """Which actions an index allows.

    Types 1-5 are row and column stores; online rebuilds need an edition and a
    layout that permit them (`allow_online`).
    """
    stored = ~F.col("on_read_only_filegroup") & F.col("index_type").between(1, 5)
    return {
        "INDEX_REORGANIZE": stored & (F.col("allow_page_locks") | (F.col("index_type") == 5)),
        "INDEX_REBUILD_OFFLINE": stored,
        "INDEX_REBUILD_ONLINE": ~F.col("on_read_only_filegroup") & F.col("index_type").isin(1, 2)
        & F.col("allow_online"),
    }


def fragmentation_action(
    index_stats: DataFrame, preferences: Mapping[str, Sequence[str]] = DEFAULT_PREFERENCES,
    low: float = 5, high: float = 30, min_pages: int = 1000, max_pages: int | None = None,
) -> DataFrame:
    """Fragmentation group of every index and the first preferred action it allows.

    No action below `min_pages` or above `max_pages`.
    """
    level = F.col("fragmentation")
    group = F.when(
        ~F.col("on_read_only_filegroup"),
        F.when(level >= high, "High").when(level >= low, "Medium").when(level < low, "Low"),
    )
    allowed = allowed_actions(index_stats)
    sized = (F.col("page_count") >= min_pages) | F.lit(min_pages == 0)
    if max_pages is not None:
        sized = sized & (F.col("page_count") <= max_pages)
    action = F.lit(None).cast("string")
    for name, wanted in preferences.items():
        best = F.coalesce(*[F.when(allowed[a], a) for a in wanted], F.lit(None).cast("string"))
        action = F.when(sized & (F.col("fragmentation_group") == name), best).otherwise(action)
    return index_stats.withColumn("fragmentation_group", group).withColumn("action", action)


def stats_update_due(
    index_stats: DataFrame, scope: str = "ALL", only_modified: bool = False, level: float | None = None
) -> DataFrame:
    """Statistics with `update_due`.

    `scope` is ALL, INDEX or COLUMNS; an index about to be rebuilt (`action`)
    needs no update.
    """
    of_index = F.col("index_id").isNotNull()
    kind = F.col("index_type").isin(1, 2, 3, 4, 7)
    if scope == "ALL":
        in_scope = kind | ~of_index
    elif scope == "INDEX":
        in_scope = of_index & kind
    elif scope == "COLUMNS":
        in_scope = ~of_index
    else:
        raise ValueError("scope must be ALL, INDEX or COLUMNS")
    changed = F.col("modification_counter")
    if not only_modified and level is None:
        stale = F.lit(True)
    else:
        stale = (changed > 0) if only_modified else F.lit(False)
        if level is not None:
            percent = changed.cast("double") / F.nullif(F.col("row_count"), F.lit(0)) * 100
            stale = stale | (percent >= level) | (
                (changed > 0) & (changed >= F.sqrt(F.col("row_count") * 1000))
            )
    due = in_scope & F.coalesce(stale, F.lit(False))
    if "action" in index_stats.columns:
        due = due & ~F.coalesce(F.col("action").startswith("INDEX_REBUILD"), F.lit(False))
    return index_stats.withColumn("update_due", due)


def backup_type_choice(
    db_stats: DataFrame, requested: str, level: float | None = None, change: bool = True
) -> DataFrame:
    """Backup type each database can take.

    A log backup without a log chain becomes differential; a differential
    without a usable base, of master, or of a mostly modified database becomes
    full.
    """
    master = F.lower("name") == "master"
    kind = F.lit(requested)
    if change:
        kind = F.when(
            (kind == "LOG") & F.col("recovery_model_desc").isin("FULL", "BULK_LOGGED")
            & F.col("log_lsn").isNull() & ~master,
            "DIFF",
        ).otherwise(kind)
        unusable = master | F.col("differential_base_lsn").isNull() | F.col("differential_base_is_snapshot")
        if level is not None:
            modified = F.try_divide(
                F.col("modified_extent_pages") * 100.0, F.col("allocated_extent_pages").cast("double")
            )
            unusable = unusable | F.coalesce(modified >= level, F.lit(False))
        kind = F.when((kind == "DIFF") & unusable, "FULL").otherwise(kind)
    return db_stats.withColumn("backup_type", kind)


def log_backup_due(
    db_stats: DataFrame, size_mb: float | None, seconds: int | None, *, as_of: datetime | str
) -> DataFrame:
    """`log_backup_due`: enough log, enough time, or nothing known.

    Only when both limits are given is anything held back.
    """
    if size_mb is None or seconds is None:
        return db_stats.withColumn("log_backup_due", F.lit(True))
    age = seconds_between(F.col("last_log_backup"), instant(as_of))
    due = (
        F.col("log_mb_since_backup").isNull() | F.col("last_log_backup").isNull()
        | (F.col("log_mb_since_backup") >= size_mb) | (age >= seconds)
    )
    return db_stats.withColumn("log_backup_due", due)


def command_history_summary(command_log: DataFrame) -> DataFrame:
    """Runs, errors and seconds per command type, object and day of the start; an unfinished run has no duration."""
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1_000_000
    return command_log.groupBy(KEY, "command_type", "database_name", F.to_date("start_time").alias("day")).agg(
        F.count("*").alias("runs"),
        F.count_if(F.coalesce("error_number", F.lit(0)) != 0).alias("errors"),
        F.sum(seconds).alias("total_seconds"),
        F.max(seconds).alias("longest_seconds"),
    )


def last_successful_command(command_log: DataFrame, command_type: str = "DBCC_CHECKDB") -> DataFrame:
    """Start of the last run without error per database."""
    return (
        command_log.filter((F.col("command_type") == command_type) & (F.col("error_number") == 0))
        .groupBy(KEY, "database_name")
        .agg(F.max("start_time").alias("last_command_time"))
    )
