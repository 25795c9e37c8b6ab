"""Capacity and counter metrics with thresholds.

Sizes are pages of 8 KB, then whole hundredths of a megabyte (rounded half up per
file before they are summed), and become `decimal(20,2)` only in the results.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import (
    KEY, MB, cents_to_mb, like_text, pages_to_cents, pages_to_mb,
)
from ..functions.states import state_code
from ..plans.listing import listed
from ..plans.patterns import match_patterns
from ..plans.segments import row_before

_BYTES_PER_MB = 1048576

# fixed values: counter types
RATIO, AVERAGE, PER_SECOND, INSTANT, BASE = (
    537003264, 1073874176, 272696576, 65792, 1073939712,
)


def file_inventory(
    db_files: DataFrame, databases: DataFrame, policy_database: DataFrame
) -> DataFrame:
    """Files of online databases, and of unreachable ones known to the policy.

    An unreachable database has no readable usage or filegroups: used is 0.
    Both kinds come from one pass over the files.
    """
    known = databases.select(
        KEY, "database_id", "state", F.col("is_read_only").alias("database_is_read_only")
    ).join(
        policy_database.select(KEY, "database_id", F.lit(True).alias("has_policy")),
        [KEY, "database_id"], "left",
    )
    online = F.col("state") == 0
    used = F.when(online, F.coalesce("used_pages", F.lit(0))).otherwise(0).cast("long")
    return (
        db_files.join(known, [KEY, "database_id"])
        .filter(online | F.col("has_policy"))
        .select(
            KEY, "database_id", "state", "database_is_read_only", "file_id", "name", "file_type",
            "physical_name",
            F.when(online, F.coalesce("filegroup_id", F.lit(0))).alias("filegroup_id"),
            F.when(online, F.col("filegroup_name")).alias("filegroup_name"),
            F.when(online, F.col("filegroup_is_readonly")).alias("filegroup_is_readonly"),
            F.upper(F.substring("physical_name", 1, 1)).alias("drive"),
            used.alias("used_pages"),
            pages_to_mb(used).alias("used_mb"),
            pages_to_mb(F.col("size_pages")).alias("reserved_mb"),
            "size_pages", "max_size_pages", "growth", "is_percent_growth",
        )
    )


def file_headroom(files: DataFrame, drives: DataFrame) -> DataFrame:
    """Files plus `disk_free_mb` and `headroom_mb`, the space each can still use.

    Everything is compared in whole units of 1/12800 MB, where pages, rounded
    hundredths of megabytes and percents of pages are all exact integers.  When
    growth room equals the free disk exactly the disk is the bound.
    """
    def from_cents(c: Column) -> Column:
        return c * 128

    def from_pages(c: Column) -> Column:
        return c.cast("long") * 100

    free_cents = (F.col("disk_free_mb") * 100).cast("long")
    free = from_cents(free_cents)
    used = from_cents(pages_to_cents(F.col("used_pages")))
    reserved = from_cents(pages_to_cents(F.col("size_pages")))
    slack = reserved - used
    size, limit = from_pages(F.col("size_pages")), from_pages(F.col("max_size_pages"))
    percent = F.col("is_percent_growth")
    step = F.when(percent, F.col("size_pages") * F.col("growth")).otherwise(from_pages(F.col("growth")))
    disk_bound = F.when(step > free, slack).otherwise(free)
    too_big = F.when(percent, step >= limit - size).otherwise(step > limit - size)
    size_bound = F.when(too_big, slack).otherwise(limit - used)
    fixed = F.coalesce("filegroup_is_readonly", F.lit(False))
    headroom = F.when(
        free.isNotNull(),
        F.when(fixed, slack)
        .when(F.col("max_size_pages") == 0, F.lit(None).cast("long"))
        .when(F.col("growth") == 0, slack)
        .when(F.col("max_size_pages") == -1, disk_bound)
        .when(limit - reserved >= free, disk_bound)
        .otherwise(size_bound),
    )
    # units to hundredths, half up
    cents = F.shiftright(headroom + 64, 7)
    return files.join(
        drives.select(KEY, "drive", F.col("free_mb").cast(MB).alias("disk_free_mb")),
        [KEY, "drive"], "left",
    ).withColumns({"headroom_cents": cents, "headroom_mb": cents_to_mb(cents)})


def filegroup_headroom(headroom: DataFrame) -> DataFrame:
    """Used, reserved and usable space per filegroup, the disk counted once per drive.

    Sums are over integers, so both aggregates stay in hash buffers.
    """
    group = [
        KEY, "database_id", "state", "database_is_read_only", "filegroup_id", "filegroup_name",
        "filegroup_is_readonly", "file_type",
    ]
    pages_limit = F.when(
        (F.col("max_size_pages") == -1) & (F.col("growth") == 0), F.col("size_pages")
    ).otherwise(F.col("max_size_pages"))
    placed = F.col("disk_free_mb").isNotNull()
    per_drive = headroom.groupBy(*group, "drive").agg(
        F.sum(pages_to_cents(F.col("used_pages"))).alias("used"),
        F.sum(pages_to_cents(F.col("size_pages"))).alias("reserved"),
        F.max((F.col("disk_free_mb") * 100).cast("long")).alias("free"),
        F.sum(F.when(placed, pages_limit)).alias("limit_pages"),
        F.sum(F.when(placed, F.col("growth"))).alias("growth"),
        F.min(F.when(placed, pages_limit)).alias("lowest"),
        F.sum("headroom_cents").alias("rooms"),
    )
    open_ended = (F.col("growth") > 0) & (F.col("lowest") < 0)
    above_disk = F.col("limit_pages") * 100 - F.col("reserved") * 128 >= F.col("free") * 128
    room = F.when(
        above_disk | open_ended, F.col("free") + F.col("reserved") - F.col("used")
    ).otherwise(F.col("rooms"))
    return per_drive.groupBy(*group).agg(
        cents_to_mb(F.sum("used")).alias("used_mb"),
        cents_to_mb(F.sum("reserved")).alias("reserved_mb"),
        cents_to_mb(F.sum(F.when(F.col("free").isNotNull(), room))).alias("headroom_mb"),
    )


def _bytes(mb: Column) -> Column:
    return (mb.cast(MB) * F.lit(_BYTES_PER_MB)).cast("decimal(28,2)")


def _plain(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def chart_capacity(filegroups: DataFrame, policy_database: DataFrame) -> DataFrame:
    """Used space per database and data space, in bytes, with thresholds."""
    total = F.col("used_mb") + F.col("headroom_mb")
    frozen = F.coalesce("filegroup_is_readonly", F.lit(False)) | F.col("database_is_read_only")

    def threshold(percent: str) -> Column:
        level = (total - total * F.col(percent).cast("decimal(5,2)") / F.lit(100)).cast(MB)
        watched = ~(frozen | (F.col("state") != 0))
        return F.when(watched & (level >= 1), _bytes(level))

    space = F.concat_ws("_", "file_type", "filegroup_name")
    label = F.concat_ws(
        "_", F.replace("db_name", F.lit(" "), F.lit("_")), F.replace(space, F.lit(" "), F.lit("_"))
    )
    charted = filegroups.join(
        policy_database.filter("is_enabled").select(
            KEY, "database_id", "db_name", "capacity_warning_percent_free",
            "capacity_critical_percent_free",
        ),
        [KEY, "database_id"],
    ).select(
        KEY,
        "database_id",
        label.alias("label"),
        _bytes(F.col("used_mb")).alias("val"),
        threshold("capacity_warning_percent_free").alias("warn"),
        threshold("capacity_critical_percent_free").alias("crit"),
        _bytes(F.when(frozen, F.col("reserved_mb")).otherwise(total)).alias("max"),
        _bytes(F.col("reserved_mb")).alias("reserved"),
    )
    pnp = F.concat(
        F.lit("'"), F.col("label"), F.lit("_used'="), F.col("val").cast("string"),
        F.lit(";"), _plain(F.col("warn")), F.lit(";"), _plain(F.col("crit")),
        F.lit(";0;"), F.col("max").cast("string"),
        F.lit("|'"), F.col("label"), F.lit("_reserved'="), F.col("reserved").cast("string"),
        F.lit(";;;;"),
    )
    return charted.withColumn("pnp", pnp)


def chart_capacity_drive(
    db_files: DataFrame, databases: DataFrame, drives: DataFrame, unreadable: DataFrame
) -> DataFrame:
    """Used against allocated against drive size, in bytes.

    `unreadable` lists (instance, database_id) of secondaries that cannot be read.
    """
    readable = databases.filter(F.col("state_desc") == "ONLINE").select(KEY, "database_id").join(
        unreadable.select(KEY, "database_id"), [KEY, "database_id"], "left_anti"
    )
    page_bytes = 8192

    def size(pages: str) -> Column:
        return (F.sum(pages) * page_bytes).cast(MB)

    per_drive = (
        db_files.withColumn("drive", F.upper(F.substring("physical_name", 1, 1)))
        .join(readable, [KEY, "database_id"], "left_semi")
        .groupBy(KEY, "drive")
        .agg(size("used_pages").alias("val"), size("size_pages").alias("warn"))
    )
    sized = per_drive.join(
        drives.select(
            KEY, "drive", (F.col("capacity_mb") * F.lit(_BYTES_PER_MB)).cast(MB).alias("crit")
        ),
        [KEY, "drive"], "left",
    ).withColumn("max", (F.col("crit") * F.lit(Decimal("1.05"))).cast(MB))
    pnp = F.concat(
        F.lit("'"), F.col("drive"), F.lit("'="), F.col("val").cast("string"), F.lit(";"),
        F.col("warn").cast("string"), F.lit(";"), F.col("crit").cast("string"), F.lit(";0;"),
        F.col("max").cast("string"),
    )
    return sized.withColumn("pnp", pnp)


def counter_match(counter_samples: DataFrame, policy_counter: DataFrame) -> DataFrame:
    """Samples selected by policy patterns, once per matching policy row.

    Patterns are matched on the distinct names, not on the samples.
    """
    names = [KEY, "object_name", "counter_name", "instance_name"]
    distinct = counter_samples.select(*names).distinct()
    rules = policy_counter.select(
        KEY,
        F.col("object_name").alias("object_pattern"),
        F.col("counter_name").alias("counter_pattern"),
        F.col("instance_name").alias("instance_pattern"),
        "warning_threshold", "critical_threshold",
    )
    matched = match_patterns(
        distinct, rules,
        [("counter_name", "counter_pattern"), ("object_name", "object_pattern"),
         ("instance_name", "instance_pattern")],
        [KEY],
    ).drop("object_pattern", "counter_pattern", "instance_pattern")
    return counter_samples.join(matched, names)


def base_stem(counter_name: Column, cntr_type: Column) -> Column:
    """What the name of a ratio or average has in common with its base counter's; NULL for other types."""
    name = F.rtrim(counter_name)
    base = F.lower(F.rtrim(F.regexp_replace(name, "(?i)Ratio| Base| BS|Avg ", "")))
    based = F.lower(F.rtrim(F.regexp_replace(name, r"(?i)\(ms\)|Ratio|Avg ", "")))
    return F.when(cntr_type == BASE, base).when(cntr_type.isin(RATIO, AVERAGE), based)


RATED = (RATIO, AVERAGE, PER_SECOND, INSTANT)


def counter_rate(counter_samples: DataFrame) -> DataFrame:
    """Value of each counter at each sample after the first of its series.

    Ratios and averages use the base counter of the same sample, found through
    the counter name without its `Base`, `Ratio`, `Avg` and unit parts.
    """
    at = [KEY, "object_name", "instance_name", "base_name", "seq"]
    stem = base_stem(F.col("counter_name"), F.col("cntr_type"))
    base = counter_samples.filter(F.col("cntr_type") == BASE).select(
        KEY, "object_name", "instance_name", stem.alias("base_name"), "seq", F.col("cntr_value").alias("base_value")
    )
    wanted = counter_samples.filter(F.col("cntr_type").isin(*RATED))
    based = wanted.withColumn("base_name", stem).join(base, at, "left")
    stepped = row_before(
        based, [KEY, "object_name", "counter_name", "instance_name"],
        ["sample_ts", "seq"], ["cntr_value", "ms_ticks", "base_value"],
    ).filter(F.col("previous").isNotNull())

    return stepped.withColumn("val", rate_value()).drop("previous", "base_name", "base_value")


def rate_value() -> Column:
    """The value of a sample with its `base_value` and the `previous` sample of its series."""

    def number(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    value, kind = F.col("cntr_value"), F.col("cntr_type")
    gain = value - F.col("previous.cntr_value")
    result = (
        F.when(
            kind == RATIO,
            F.when(value > 0, F.try_divide(number(value) * 100, number(F.col("base_value"))))
            .otherwise(0),
        )
        .when(
            kind == AVERAGE,
            F.when(
                gain > 0,
                F.try_divide(
                    number(gain), number(F.col("base_value") - F.col("previous.base_value"))
                ),
            ).otherwise(0),
        )
        .when(
            kind == PER_SECOND,
            F.when(
                gain > 0,
                F.try_divide(
                    number(gain) * 1000, number(F.col("ms_ticks") - F.col("previous.ms_ticks"))
                ),
            ).otherwise(0),
        )
        .otherwise(value)
    )
    return F.round(result, 2).cast(MB)


def counter_uom(counter_name: Column, instance_name: Column, cntr_type: Column) -> Column:
    """Unit of a counter from its type and name; NULL when none applies."""

    def named(pattern: str, c: Column = counter_name) -> Column:
        return c.ilike(like_text(pattern))

    return (
        F.when((cntr_type == RATIO) | named("%[%]%"), "%")
        .when((cntr_type == INSTANT) & named("Percent %"), "%")
        .when((cntr_type == INSTANT) & (F.lower(F.rtrim(counter_name)) == "usage"), "c")
        .when(named("%(ms)%") | named("%(ms)%", instance_name), "ms")
        .when(named("%(KB)%") | named("%(KB)%", instance_name), "KB")
        .when(named("%Byte%") & ~named("%/sec%"), "B")
    )


def chart_counter(matched: DataFrame) -> DataFrame:
    """Rates of matched counters as chart rows."""

    def slug(c: Column) -> Column:
        return F.replace(F.lower(F.rtrim(c)), F.lit(" "), F.lit("_"))

    instance = F.col("instance_name")
    label = F.concat(
        F.replace(slug(F.col("object_name")), F.lit("sqlserver:"), F.lit("")), F.lit("_"),
        slug(F.col("counter_name")),
        F.when(F.length(F.rtrim(instance)) > 0, F.concat(F.lit("_"), slug(instance))).otherwise(""),
    )
    uom = counter_uom(F.col("counter_name"), instance, F.col("cntr_type"))
    return (
        matched.withColumn("label", label)
        .withColumn("uom", uom)
        .withColumn(
            "pnp",
            F.concat(
                F.lit("'"), F.col("label"), F.lit("'="), F.col("val").cast("string"),
                F.coalesce("uom", F.lit("")), F.lit(";"), _plain(F.col("warning_threshold")),
                F.lit(";"), _plain(F.col("critical_threshold")), F.lit(";;"),
            ),
        )
        .select(
            KEY, "sample_ts", "seq", "label", "val", F.col("warning_threshold").alias("warn"),
            F.col("critical_threshold").alias("crit"), "uom", "pnp",
        )
    )


def threshold_state(val: Column, warn: Column, crit: Column) -> Column:
    """High is bad when crit >= warn, low is bad otherwise; both must be set."""
    high = F.when(val >= crit, "CRITICAL").when(val >= warn, "WARNING").otherwise("OK")
    low = F.when(val <= crit, "CRITICAL").when(val <= warn, "WARNING").otherwise("OK")
    return (
        F.when(warn.isNull() | crit.isNull(), "OK").when(crit >= warn, high).otherwise(low)
    )


def chart_evaluate(charts: DataFrame, keys: Sequence[str] = (KEY, "chart")) -> DataFrame:
    """Worst code and number of rows per chart, with a row for each distinct performance text and its breach.

    Rows without a value or a text are skipped.  `breach` is NULL where the
    thresholds hold; `copies` is how often the two texts occur.
    """
    shown = charts.filter(F.col("val").isNotNull() & (F.coalesce("pnp", F.lit("")) != ""))
    judged = shown.withColumn("state", threshold_state(F.col("val"), F.col("warn"), F.col("crit")))
    name = F.replace(F.substring_index("pnp", "=", 1), F.lit("'"), F.lit(""))
    breach = F.when(F.col("state") != "OK", F.concat("state", F.lit(" - "), name))
    told = F.coalesce(F.substring_index("breach", " - ", 1), F.lit("OK"))
    return listed(
        judged.withColumn("breach", breach), keys, {"breach": "breach", "perf": "pnp"},
        lambda n: [F.max(state_code(told)).alias("state_code"), F.sum(n).alias("rows")],
    )
