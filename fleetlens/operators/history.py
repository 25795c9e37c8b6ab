"""Incremental extracts of backup, capacity, error, job and maintenance history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import (
    KEY, MB, SANITIZED_NOTICE, agent_seconds, agent_timestamp, clean_text, instant, iso_with_offset,
    name_key, pages_to_mb,
)
from ..plans.adjacent import next_row
from ..sources.exchange import expire_snapshots, read_snapshots, write_snapshots
from .policy import retention_purge

# fixed values: how run states read in the job history
RUN_STATUS = {
    0: "Failed", 1: "Succeeded", 2: "Retry (step only)", 3: "Canceled", 4: "In-Progress", 5: "Unknown",
}


def extract_window(
    marks: DataFrame, dataset: str, *, as_of: datetime | str, start: datetime | str | None = None,
    end: datetime | str | None = None, mark: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(windows, new marks) for one dataset.

    A window starts at the last mark of the instance, or a day before `as_of`.
    Marks move to the window's end only with `mark`; write them after the
    extract has been written.
    """
    now = instant(as_of)
    ends = instant(end) if end is not None else now
    own = F.col("dataset") == dataset
    if start is not None:
        starts = instant(start)
    else:
        starts = F.coalesce("last_run", now - F.expr("INTERVAL 1 DAY"))
    windows = marks.filter(own).select(KEY, starts.alias("start_at"), ends.alias("end_at"))
    moved = marks.withColumn("last_run", F.when(own, ends).otherwise(F.col("last_run"))) if mark else marks
    return windows, moved


def in_window(
    df: DataFrame, ts_col: str, windows: DataFrame, *, inclusive: bool = False
) -> DataFrame:
    """Rows in (start, end] of their instance; `inclusive` also takes the start.

    The earliest start and latest end of all windows, one row, become literals
    that reach the scan; the exact test per instance follows.
    """
    after = F.col(ts_col) >= F.col("start_at") if inclusive else F.col(ts_col) > F.col("start_at")
    return (
        within_bounds(df, ts_col, windows)
        .join(windows, KEY).filter(after & (F.col(ts_col) <= F.col("end_at"))).drop("start_at", "end_at")
    )


def window_bounds(windows: DataFrame) -> tuple[int | None, int | None]:
    """Microseconds of the earliest start and the latest end, None without windows."""
    return tuple(windows.agg(F.unix_micros(F.min("start_at")), F.unix_micros(F.max("end_at"))).first())


def within_bounds(df: DataFrame, ts_col: str, windows: DataFrame) -> DataFrame:
    """Rows that can be in a window of some instance, by literals on the raw column."""
    low, high = window_bounds(windows)
    if low is None or high is None:
        return df.filter(F.lit(False))
    at = F.col(ts_col)
    return df.filter((at >= F.timestamp_micros(F.lit(low))) & (at <= F.timestamp_micros(F.lit(high))))


def _or_null(df: DataFrame, column: str, kind: str) -> Column:
    """A column older collectors do not deliver."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def log_backup(
    backup_history: DataFrame, databases: DataFrame, policy_database: DataFrame, windows: DataFrame
) -> DataFrame:
    """Backups started in the window with sizes, compression and encryption."""
    b = in_window(backup_history, "backup_start_date", windows)
    packed = _or_null(b, "compressed_backup_size", "bigint")
    size = F.col("backup_size").cast("decimal(20,0)")
    known = (
        databases.filter(name_key(F.col("name")) != "tempdb")
        .select(KEY, "database_id", name_key(F.col("name")).alias("name_key"), "name")
        .join(
            policy_database.select(KEY, "database_id", "backup_frequency_hours"), [KEY, "database_id"]
        )
    )

    def megabytes(c: Column) -> Column:
        return (c.cast("decimal(20,0)") / F.lit(1048576)).cast(MB)

    return (
        b.withColumn("name_key", name_key(F.col("database_name")))
        .drop("database_name")
        .join(known, [KEY, "name_key"])
        .select(
            KEY,
            iso_with_offset(F.col("backup_start_date")).alias("backup_start_date"),
            iso_with_offset(F.col("backup_finish_date")).alias("backup_finish_date"),
            F.col("name").alias("database_name"),
            F.col("type").alias("backup_type"),
            "is_copy_only", "software_name", "user_name", "physical_device_name",
            megabytes(F.col("backup_size")).alias("backup_size_mb"),
            megabytes(packed).alias("compressed_backup_size_mb"),
            (F.try_divide(size - packed.cast("decimal(20,0)"), size) * 100)
            .try_cast("decimal(5,2)").alias("compression_ratio"),
            _or_null(b, "encryptor_type", "string").alias("encryptor_type"),
            _or_null(b, "encryptor_thumbprint", "binary").alias("encryptor_thumbprint"),
            _or_null(b, "is_password_protected", "boolean").alias("is_password_protected"),
            "backup_frequency_hours",
        )
    )


def drive_sizes(service_eav: DataFrame, drives_free: DataFrame) -> DataFrame:
    """Drive capacity from the inventory (bytes per volume) joined to free space."""
    volume = service_eav.filter(
        (F.lower("property") == "capacity") & F.col("hierarchy").ilike("%Win32\\_Volume%")
    ).select(
        KEY,
        F.upper(F.regexp_extract("hierarchy", "(?i)Win32_Volume/(.)", 1)).alias("drive"),
        (F.col("value").try_cast("decimal(20,0)") / F.lit(1048576)).cast(MB).alias("capacity_mb"),
    )
    return volume.join(drives_free.select(KEY, "drive", "free_mb"), [KEY, "drive"])


def log_capacity(
    db_files: DataFrame, databases: DataFrame, drives: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """Used and reserved space per file beside the drive it is on."""
    return (
        db_files.join(
            databases.select(KEY, "database_id", F.col("name").alias("database_name")),
            [KEY, "database_id"],
        )
        .withColumn("drive", F.upper(F.substring("physical_name", 1, 1)))
        .join(drives.select(KEY, "drive", "free_mb", "capacity_mb"), [KEY, "drive"])
        .select(
            KEY, "database_name", "physical_name", F.col("name").alias("logical_name"),
            F.col("file_type").alias("type_desc"),
            pages_to_mb(F.coalesce("used_pages", F.lit(0))).alias("used_mb"),
            pages_to_mb(F.col("size_pages")).alias("reserved_mb"),
            "drive", "free_mb", "capacity_mb",
            iso_with_offset(instant(as_of)).alias("check_date"),
        )
    )


def stage_capacity_append(
    stage: DataFrame, capacity: DataFrame, *, as_of: datetime | str, keep_months: int | None = 3
) -> DataFrame:
    """Staged snapshots plus a new one, older snapshots than the retention removed.

    No retention set means three months; zero keeps only what is not older than
    `as_of`.
    """
    keep = 3 if keep_months is None else keep_months
    both = stage.unionByName(capacity).withColumn("__at", F.to_timestamp("check_date"))
    return retention_purge(both, "__at", as_of=as_of, keep_months=keep).drop("__at")


def append_capacity(
    capacity: DataFrame, path: str, *, as_of: datetime | str, keep_months: int | None = None
) -> DataFrame:
    """`stage_capacity_append` on a table of month folders: append, drop what expired, read the rest.

    Retention counts in months.  Kept folders are neither read for the append nor written again;
    the month the retention ends in is cut when it is read.
    """
    keep = 3 if keep_months is None else keep_months
    spark = capacity.sparkSession
    write_snapshots(capacity, path, "check_date", period="month")
    limit = instant(as_of) - F.expr(f"INTERVAL {abs(int(keep))} MONTH")
    first_day = spark.range(1).select(F.to_date(limit).alias("d")).first()["d"]  # one value
    expire_snapshots(path, first_day, period="month")
    rows = read_snapshots(spark, path, capacity.schema, first_day, period="month")
    return stage_capacity_append(rows, rows.limit(0), as_of=as_of, keep_months=keep_months)


def sanitize_message(
    df: DataFrame, messages: DataFrame, text: str, message_id: str, *, sanitize: bool,
    unmatched: str | None = SANITIZED_NOTICE,
) -> DataFrame:
    """Free text replaced by its catalogue template when `sanitize` is on.

    `unmatched` stands in for texts without a template; None drops such rows.
    """
    if not sanitize:
        return df
    catalogue = messages.select(F.col("message_id").alias(message_id), F.col("text").alias("__template"))
    how = "left" if unmatched is not None else "inner"
    safe = F.coalesce("__template", F.lit(unmatched)) if unmatched is not None else F.col("__template")
    return df.join(catalogue, message_id, how).withColumn(text, safe).drop("__template")


HEADER = "Error:%Severity:%State:%"
INTEGRITY_FOUND = "%found % errors and repaired % errors%"
INTEGRITY_CLEAN = "%found 0 errors and repaired 0 errors%"


def log_error_pairs(
    error_log: DataFrame, messages: DataFrame, windows: DataFrame, *, sanitize: bool
) -> DataFrame:
    """Error headers with the text of the log line that follows.

    The following line is found per instance in (log_date, source, seq) order,
    through time slices, so the log of one busy instance is not one task.
    Headers with an id missing from the catalogue are left out.
    """
    lines = next_row(
        in_window(error_log, "log_date", windows).select(KEY, "log_date", "source", "seq", "message"),
        [KEY], "log_date", ["log_date", "source", "seq"], ["message"], out="following",
        sizing=within_bounds(error_log, "log_date", windows),
    )
    pairs = lines.filter(
        F.col("message").ilike(HEADER) & F.col("following").isNotNull()
    ).select(
        KEY, "log_date", "source", F.col("message").alias("message_header"), F.col("following.message").alias("message")
    )
    return catalogued_pairs(pairs, messages, sanitize=sanitize)


def catalogued_pairs(
    pairs: DataFrame, messages: DataFrame, *, sanitize: bool, also: tuple[str, ...] = ()
) -> DataFrame:
    """Headers and their texts as reported: those in the catalogue, sources without numbers, texts cleaned.

    `pairs` is (instance, log_date, source, message_header, message); columns `also` go through.
    """
    found = pairs.withColumn(
        "source", F.when(F.lower("source").startswith("spid"), "spid").otherwise(F.col("source"))
    ).withColumn("message_id", F.regexp_extract("message_header", r"^(?i)Error:\s*(-?\d+)\s*,", 1).try_cast("int"))
    if sanitize:
        found = sanitize_message(found, messages, "message", "message_id", sanitize=True, unmatched=None)
    else:
        found = found.join(messages.select("message_id"), "message_id", "left_semi")
    return found.select(
        KEY, iso_with_offset(F.col("log_date")).alias("log_date"), "source", "message_header",
        clean_text(F.col("message")).alias("message"), *also,
    )


def log_error_integrity(error_log: DataFrame, windows: DataFrame, *, sanitize: bool) -> DataFrame:
    """Integrity-check lines that report errors."""
    found = in_window(error_log, "log_date", windows).filter(
        F.col("message").ilike(INTEGRITY_FOUND) & ~F.col("message").ilike(INTEGRITY_CLEAN)
    )
    text = clean_text(F.col("message"))
    if sanitize:
        at = F.instr(F.lower(text), " found ")
        text = F.substring(text, at, F.length(text))
    return found.select(
        KEY, iso_with_offset(F.col("log_date")).alias("log_date"), "source",
        F.lit("Error: dbcc").alias("message_header"), text.alias("message"),
    )


def log_error(
    error_log: DataFrame, messages: DataFrame, windows: DataFrame, *, sanitize: bool
) -> DataFrame:
    """Header pairs and integrity lines together."""
    return log_error_pairs(error_log, messages, windows, sanitize=sanitize).unionByName(
        log_error_integrity(error_log, windows, sanitize=sanitize)
    )


def log_job(
    job_history: DataFrame, messages: DataFrame, windows: DataFrame, *, sanitize: bool
) -> DataFrame:
    """Runs that neither succeeded nor are running.

    The run time is computed from integers, which cannot be pushed down, so the
    days of the windows are: `run_date` (yyyymmdd) is bounded by two literals.
    """
    failed = job_history.filter(~F.col("run_status").isin(1, 4))
    days = [F.date_format(F.timestamp_micros(F.lit(b)), "yyyyMMdd").cast("long") for b in window_bounds(windows) if b is not None]
    if len(days) == 2:
        failed = failed.filter((F.col("run_date") >= days[0]) & (F.col("run_date") <= days[1]))
    timed = failed.withColumn("run_at", agent_timestamp(F.col("run_date"), F.col("run_time")))
    windowed = in_window(timed, "run_at", windows)
    if sanitize:
        windowed = sanitize_message(windowed, messages, "message", "sql_message_id", sanitize=True)
        error = F.col("message")
    else:
        error = F.when(F.col("run_status") == 0, F.col("message"))
    status = F.lit("Unknown")
    for code, label in RUN_STATUS.items():
        status = F.when(F.col("run_status") == code, label).otherwise(status)
    return windowed.select(
        KEY, iso_with_offset(F.col("run_at")).alias("run_datetime"), "job_name", "step_id", "step_name",
        clean_text(error).alias("error_message"), status.alias("run_status"),
        agent_seconds(F.col("run_duration")).alias("run_duration_sec"),
    )


def log_maintenance(
    plans: DataFrame, subplans: DataFrame, plan_log: DataFrame, jobs: DataFrame, windows: DataFrame
) -> DataFrame:
    """Maintenance plan runs; up to five detail lines joined by ` | `."""
    lines = [F.when(F.length(F.rtrim(f"line{n}")) > 0, F.col(f"line{n}")) for n in range(2, 6)]
    text = F.concat_ws(" | ", F.col("line1"), *lines)
    return (
        in_window(plan_log, "start_time", windows)
        .join(subplans.select(KEY, "plan_id", "subplan_id", "job_id"), [KEY, "plan_id", "subplan_id"])
        .join(plans.select(KEY, "plan_id", "plan_name"), [KEY, "plan_id"])
        .join(jobs.select(KEY, "job_id", "job_name"), [KEY, "job_id"], "left")
        .select(
            KEY,
            iso_with_offset(F.col("start_time")).alias("start_time"),
            iso_with_offset(F.col("end_time")).alias("end_time"),
            "plan_name", "job_name", clean_text(text).alias("description"), "succeeded", "error_number",
            clean_text(F.col("error_message")).alias("error_message"),
        )
    )
