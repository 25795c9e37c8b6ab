"""Daily status reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import KEY, MB, agent_timestamp, instant, name_key
from ..plans.fixpoint import cut_lineage
from ..plans.segments import row_before

# fixed values: marks of the report parameters
FREQUENCY_MARK = "Database Backup Frequency (Days)"
RESTORED_MARK = "Exclude from restored database report"
OFFLINE_MARK = "excluded_from_Monitoring_DBName"

# fixed values: first four characters of a product version and its release
RELEASES = {
    "16.0": "2022", "15.0": "2019", "14.0": "2017", "13.0": "2016", "12.0": "2014", "11.0": "2012",
    "10.5": "2008 R2", "10.0": "2008", "9.0.": "2005", "8.00": "2000",
}


def _days_before(now: Column, days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - days.cast("long") * 86_400_000_000)


def backup_status_report(
    databases: DataFrame, backup_history: DataFrame, restore_history: DataFrame,
    logship_secondary: DataFrame, report_params: DataFrame, *, as_of: datetime | str,
    restored_within_days: int = 1,
) -> DataFrame:
    """Status of every database and of backups whose database is gone."""
    now = instant(as_of)
    k = "name_key"
    # the long pass keeps one instant per spelling of a name; spellings meet afterwards
    spelled = backup_history.filter(F.col("type") == "D").groupBy(KEY, "database_name").agg(
        F.max("backup_start_date").alias("started")
    )
    full = spelled.groupBy(KEY, name_key(F.col("database_name")).alias(k)).agg(
        F.max("started").alias("started"), F.max("database_name").alias("backup_name")
    )
    restored = (
        restore_history.filter(
            (F.col("restore_type") == "D")
            & (F.col("restore_date") >= now - F.expr(f"INTERVAL {int(restored_within_days)} DAY"))
        )
        .select(KEY, name_key(F.col("destination_database_name")).alias(k), F.lit(True).alias("was_restored"))
        .distinct()
    )
    shipped = logship_secondary.select(
        KEY, name_key(F.col("secondary_database")).alias(k), F.lit(True).alias("is_shipped")
    ).distinct()

    def marked(mark: str, out: str) -> DataFrame:
        return report_params.filter(F.lower("comments") == mark.lower()).select(
            KEY, name_key(F.col("parametername")).alias(k), F.col("setting").try_cast("int").alias(out)
        )

    offline = report_params.filter(F.lower("parametername") == OFFLINE_MARK.lower()).select(
        KEY, name_key(F.col("setting")).alias(k), F.col("status").alias("offline_status")
    )
    mine = databases.select(
        KEY, name_key(F.col("name")).alias(k), "name", "create_date", "state_desc", "is_read_only",
        "is_in_standby",
    )
    exists = F.col("name").isNotNull()
    day_ago = now - F.expr("INTERVAL 1 DAY")
    days = F.coalesce("frequency_days", F.lit(1))
    due_since = _days_before(now, days)
    is_offline = F.col("state_desc") == "OFFLINE"
    status = (
        F.when(F.col("create_date") > day_ago, "New database")
        .when(F.col("was_restored") & F.col("hide_restored").isNull(), "Restored")
        .when(F.col("was_restored") & (F.col("hide_restored") == 1), "Exclude from restored database report")
        .when(
            (F.col("frequency_days") == 0) | F.col("is_shipped") | (F.col("state_desc") == "RESTORING"),
            "Backup not required",
        )
        .when(F.col("is_read_only"), "Read only database")
        .when(F.col("is_in_standby"), "Standby database")
        .when(is_offline & (F.coalesce("offline_status", F.lit(0)) != 1), "IsOffline database")
        .when(is_offline, "OK")
        .when(F.col("backup_name").isNull() & (F.col("create_date") < day_ago), "Never backed up")
        .when(~exists, "Deleted")
        .when(F.col("started") >= due_since, "OK")
        .when(F.col("started") < due_since, "Backup Due")
        .otherwise("****")
    )
    joined = mine.join(full, [KEY, k], "full_outer")
    for extra in (restored, shipped, marked(FREQUENCY_MARK, "frequency_days"),
                  marked(RESTORED_MARK, "hide_restored"), offline):
        joined = joined.join(extra, [KEY, k], "left")
    # parameters describe existing databases only
    forgotten = ~exists & (F.col("started") < _days_before(now, F.lit(2)))
    return joined.filter(~forgotten).select(
        KEY, F.coalesce("name", "backup_name").alias("database_name"),
        F.col("started").alias("last_full_backup"), status.alias("status"),
    )


def database_size_report(
    databases: DataFrame, db_files: DataFrame, policy_database: DataFrame, server_collation: str
) -> DataFrame:
    """Size, owner and status text per database; offline ones only while monitored."""
    listed = databases.join(
        policy_database.select(KEY, "database_id", "is_enabled"), [KEY, "database_id"]
    ).filter((F.col("state_desc") != "OFFLINE") | F.col("is_enabled"))
    sizes = db_files.groupBy(KEY, "database_id").agg(F.sum("size_pages").alias("pages"))
    return listed.join(sizes, [KEY, "database_id"]).select(
        KEY, F.col("name"),
        (F.col("pages").cast("decimal(20,0)") / F.lit(128)).cast(MB).alias("size_mb"),
        F.coalesce("owner", F.lit("~~UNKNOWN~~")).alias("owner"),
        "database_id", "create_date",
        F.concat(
            F.lit("Status ="), F.col("state_desc"),
            F.lit("| Updateability="), F.when(F.col("is_read_only"), "READ_ONLY").otherwise("READ_WRITE"),
            F.lit("| Recovery="), F.col("recovery_model_desc"),
            F.lit("| Collation="), F.coalesce("collation_name", F.lit(server_collation)),
        ).alias("status"),
        "compatibility_level",
    )


def error_keyword_report(
    error_log: DataFrame, instances: DataFrame, *, as_of: datetime | str, days: int = 1
) -> DataFrame:
    """Log lines about errors and failures, and the line after each error header."""
    now = instant(as_of)
    recent = error_log.filter(
        (F.col("log_date") >= now - F.expr(f"INTERVAL {int(days)} DAY")) & (F.col("log_date") <= now)
    ).select(KEY, "log_date", "source", "seq", "message")
    text = F.col("message")
    keyword = text.ilike("%error%") | text.ilike("%failed%")
    benign = (
        text.ilike("%found 0 errors and repaired 0 errors%")
        | text.ilike("%LOG\\\\ERRORLOG%")
        | text.ilike("%without errors%")
    )
    header = keyword & ~benign & text.ilike("%Error:%Severity:%State:%")
    marked = row_before(recent.withColumn("header", header), [KEY], ["log_date", "seq"], ["header"])
    follows = F.coalesce(F.col("previous.header"), F.lit(False)) & ~keyword
    shown = marked.filter((keyword & ~benign) | follows).select(
        KEY, "log_date", "source",
        F.replace(
            F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit("\n"), F.lit("|")),
            F.lit("\r"), F.lit(""),
        ).alias("message"),
    )
    shown = cut_lineage(shown)  # read for the quiet instances too
    quiet = instances.select(KEY).join(shown.select(KEY).distinct(), KEY, "left_anti").select(
        KEY, now.alias("log_date"), F.lit("").alias("source"),
        F.lit("There are no error log messages").alias("message"),
    )
    return shown.unionByName(quiet)


def job_failure_report(
    job_history: DataFrame, instances: DataFrame, *, as_of: datetime | str, days: int = 0, until_as_of: bool = True
) -> DataFrame:
    """Failed steps since 06:00, and failed jobs that show no failed step.

    `days` moves the start back.  Job-level rows reach one day further.  With `until_as_of`
    runs after `as_of` aren't known yet; without it every run since the start is reported.
    Messages are given whole; cutting them is for who shows them.
    The history is scanned once: what may be shown is written, and steps, jobs and
    quiet instances are told from that.
    """
    now = instant(as_of)
    since = F.date_trunc("DAY", now) + F.expr("INTERVAL 6 HOUR") - F.expr(f"INTERVAL {int(days)} DAY")
    # whole days as numbers, for the scan; the exact instants follow
    first_day = F.date_format(since - F.expr("INTERVAL 1 DAY"), "yyyyMMdd").cast("long")
    days_read, known = F.col("run_date") >= first_day, F.lit(True)
    if until_as_of:
        days_read = days_read & (F.col("run_date") <= F.date_format(now, "yyyyMMdd").cast("long"))
        known = F.col("run_at") <= now
    timed = job_history.filter(days_read).withColumn(
        "run_at", agent_timestamp(F.col("run_date"), F.col("run_time"))
    )
    is_step = ~F.col("run_status").isin(1, 4) & (F.col("step_id") != 0) & (F.col("run_at") >= since)
    is_outcome = (
        (F.col("run_status") != 1) & (F.col("step_id") == 0) & (F.col("run_at") >= since - F.expr("INTERVAL 1 DAY"))
    )
    recent = cut_lineage(
        timed.filter(known & (is_step | is_outcome)).select(
            KEY, "job_name", "step_id", "step_name", "run_status", "run_at", "message"
        )
    )
    steps = recent.filter("step_id <> 0")
    outcomes = recent.filter("step_id = 0").join(steps.select(KEY, "job_name").distinct(), [KEY, "job_name"], "left_anti")

    def unquoted(c: Column) -> Column:
        return F.replace(c, F.lit('"'), F.lit("'"))

    status = (
        F.when(F.col("run_status") == 0, "Failed").when(F.col("run_status") == 2, "Retry")
        .when(F.col("run_status") == 3, "Cancelled").otherwise("In progress")
    )
    columns = [
        F.col(KEY),
        unquoted(F.col("job_name")).alias("job_name"), F.col("step_id"),
        unquoted(F.col("step_name")).alias("step_name"), status.alias("status"),
        F.date_format("run_at", "dd/MM/yyyy").alias("date"), F.date_format("run_at", "HH:mm:ss").alias("time"),
    ]

    def message(c: Column) -> Column:
        return F.replace(F.replace(unquoted(c), F.lit("\r"), F.lit("|")), F.lit("\n"), F.lit("")).alias("message")

    shown = steps.select(*columns, message(F.col("message"))).unionByName(
        outcomes.select(*columns, message(F.col("message")))
    )
    quiet = instances.select(KEY).join(shown.select(KEY).distinct(), KEY, "left_anti").select(
        KEY, F.lit("").alias("job_name"), F.lit(0).alias("step_id"), F.lit("").alias("step_name"),
        F.lit("").alias("status"), F.date_format(now, "dd/MM/yyyy").alias("date"),
        F.date_format(now, "HH:mm:ss").alias("time"), F.lit("There are no failed jobs").alias("message"),
    )
    return shown.unionByName(quiet)


def version_report(instances: DataFrame) -> DataFrame:
    """One line per instance: label, release, edition, bitness and patch level."""
    release = F.lit("xxxx")
    for prefix, year in RELEASES.items():
        release = F.when(F.substring("product_version", 1, 4) == prefix, year).otherwise(release)
    edition = F.rtrim(
        F.replace(
            F.replace(
                F.replace("edition", F.lit(": Core-based Licensing"), F.lit("")), F.lit("Edition"), F.lit("")
            ),
            F.lit("  "), F.lit(" "),
        )
    )
    name = F.coalesce("instance_name", F.lit("MSSQLSERVER"))
    product = F.concat(
        F.col("tenant"), F.lit(","), F.col("machine_name"), F.lit("#"), name,
        F.lit(",Microsoft SQL Server "), release, F.lit(" "), edition,
    )
    bits = F.when(
        F.endswith(product, F.lit("(64-bit)")), F.replace(product, F.lit(" (64-bit)"), F.lit(""))
    ).otherwise(F.concat(product, F.lit(" 32-bit")))
    patch = F.concat(
        F.concat_ws("-", "product_level", "product_update_level", "product_build_type"),
        F.lit(","), F.col("product_version"),
    )
    return instances.select(
        KEY, F.concat(F.lit("0 mssql_"), name, F.lit(" - "), bits, F.lit(","), patch).alias("version")
    )
