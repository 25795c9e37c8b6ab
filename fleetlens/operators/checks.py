"""Alert checks: one job over all instances, each row `message, state`.

History is reduced before it is joined (map-side combine on the object key),
so a database or job with a third of the history costs partial aggregates, not
one long task.  Policy tables are joined without hints: the optimizer and AQE
broadcast them while they are small and split skewed partitions when not.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import (
    KEY, hours_between, instant, minutes_between, name_key, quote_name,
)
from ..functions.states import state_code, with_summary
from ..plans.listing import listed

TOTAL = "_Total"
DEFAULT = "_default"
SYSTEM_DATABASES = ("master", "model", "msdb", "tempdb")  # fixed values
NEVER = "1900-01-01"

# fixed values: outcome codes of job runs
OUTCOMES = {0: "FAIL", 1: "SUCCESS", 2: "RETRY", 3: "CANCEL", 4: "IN PROGRESS"}


def _text(c: Column) -> Column:
    return c.cast("string")


def object_label(name: Column) -> Column:
    """`tenant,machine#instance#object`; the unnamed instance is MSSQLSERVER."""
    return F.concat(
        F.col("tenant"), F.lit(","), F.col("machine_name"), F.lit("#"),
        F.coalesce(F.col("instance_name"), F.lit("MSSQLSERVER")), F.lit("#"), name,
    )


def _not_tempdb(column: str) -> Column:
    return name_key(F.col(column)) != "tempdb"


def _monitored_summary(policy: DataFrame, monitored: Column, opted_out: Column) -> DataFrame:
    return policy.groupBy(KEY).agg(
        F.concat(
            _text(F.count_if(monitored)), F.lit(" database(s) monitored, "),
            _text(F.count_if(opted_out)), F.lit(" database(s) opted-out"),
        ).alias("message")
    )


def latest_backup(backup_history: DataFrame) -> DataFrame:
    """Newest full or differential backup per database, copy-only ones left out.

    Only two maxima per database are kept, so the aggregate stays in fixed-width
    hash buffers.
    """
    eligible = backup_history.filter(F.col("type").isin("D", "I") & ~F.col("is_copy_only"))
    newest = eligible.groupBy(KEY, name_key(F.col("database_name")).alias("name_key")).agg(
        F.max(F.when(F.col("type") == "D", F.col("backup_finish_date"))).alias("full_at"),
        F.max(F.when(F.col("type") == "I", F.col("backup_finish_date"))).alias("diff_at"),
    )
    return newest.select(
        KEY, "name_key",
        F.greatest("full_at", "diff_at").alias("finished_at"),
        F.when(F.col("full_at") == F.greatest("full_at", "diff_at"), "FULL")
        .otherwise("DIFFERENTIAL").alias("kind"),
    )


def _backup_candidates(databases, backup_history, policy) -> DataFrame:
    readable = databases.filter((F.col("state") == 0) & ~F.col("is_in_standby")).select(
        KEY, "database_id", name_key(F.col("name")).alias("name_key")
    )
    watched = policy.filter(
        (F.col("backup_frequency_hours") > 0) & _not_tempdb("db_name") & F.col("is_enabled")
    ).select(KEY, "database_id", "db_name", "backup_frequency_hours", "backup_state_alert")
    return readable.join(watched, [KEY, "database_id"]).join(
        latest_backup(backup_history), [KEY, "name_key"], "left"
    )


def _backup_rows(candidates: DataFrame, instances: DataFrame, now: Column) -> DataFrame:
    late = F.col("finished_at").isNull() | (
        hours_between(F.col("finished_at"), now) > F.col("backup_frequency_hours")
    )
    return candidates.join(instances, KEY).select(
        KEY,
        F.col("db_name").alias("object"),
        F.concat(
            object_label(F.col("db_name")), F.lit(","),
            F.coalesce(F.date_format("finished_at", "yyyy-MM-dd"), F.lit(NEVER)), F.lit(","),
            F.coalesce("kind", F.lit("UNKNOWN")),
        ).alias("message"),
        F.when(late, F.col("backup_state_alert")).otherwise("OK").alias("state"),
    )


def check_backup(
    databases: DataFrame, backup_history: DataFrame, policy_database: DataFrame,
    instances: DataFrame, *, as_of: datetime | str,
) -> DataFrame:
    """Age of the newest backup of every watched database, good ones included."""
    rows = _backup_rows(
        _backup_candidates(databases, backup_history, policy_database), instances, instant(as_of)
    )
    summary = _monitored_summary(
        policy_database,
        (F.col("backup_frequency_hours") > 0) & _not_tempdb("db_name") & F.col("is_enabled"),
        ((F.col("backup_frequency_hours") == 0) & _not_tempdb("db_name")) | ~F.col("is_enabled"),
    )
    return with_summary("check_backup", rows, summary)


def check_backup_replicated(
    databases: DataFrame, backup_history: DataFrame, policy_database: DataFrame,
    instances: DataFrame, replica_state: DataFrame, group_databases: DataFrame,
    policy_replica_group: DataFrame, *, as_of: datetime | str,
) -> DataFrame:
    """As `check_backup`, only where backups are taken here.

    A database counts when its group prefers the primary and this replica is
    the primary; one outside any group always counts.  After a role change the
    check waits one backup frequency.
    """
    now = instant(as_of)
    placed = (
        group_databases.join(
            replica_state.select(KEY, "ag_id", "automated_backup_preference", "role"), [KEY, "ag_id"]
        )
        .join(
            policy_replica_group.select(KEY, "ag_id", "ag_role_change_datetime"),
            [KEY, "ag_id"], "left",
        )
        .select(KEY, "database_id", "automated_backup_preference", "role", "ag_role_change_datetime")
    )
    taken_here = (F.coalesce("automated_backup_preference", F.lit(0)) == 0) & (
        F.coalesce("role", F.lit(1)) == 1
    )
    settled = F.col("ag_role_change_datetime").isNull() | (
        hours_between(F.col("ag_role_change_datetime"), now) > F.col("backup_frequency_hours")
    )
    candidates = (
        _backup_candidates(databases, backup_history, policy_database)
        .join(placed, [KEY, "database_id"], "left")
        .filter(taken_here & settled)
    )
    rows = _backup_rows(candidates, instances, now)
    counted = policy_database.join(placed, [KEY, "database_id"], "left")
    watched = (
        (F.col("backup_frequency_hours") > 0) & _not_tempdb("db_name") & F.col("is_enabled")
        & taken_here
    )
    totals = counted.groupBy(KEY).agg(
        F.count_if(watched).alias("watched"),
        F.count_if(_not_tempdb("db_name") | ~F.col("is_enabled")).alias("known"),
    )
    summary = totals.select(
        KEY,
        F.concat(
            _text(F.col("watched")), F.lit(" database(s) monitored, "),
            _text(F.col("known") - F.col("watched")), F.lit(" database(s) opted-out"),
        ).alias("message"),
    )
    return with_summary("check_backup_replicated", rows, summary)


def check_integrity(
    db_info: DataFrame, databases: DataFrame, policy_database: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """Databases whose last good integrity check is too old."""
    now = instant(as_of)
    good = db_info.filter(F.col("field") == "dbi_dbccLastKnownGood").groupBy(
        KEY, name_key(F.col("database_name")).alias("name_key")
    ).agg(F.max("value").alias("checked_at"))
    watched = policy_database.filter((F.col("checkdb_frequency_hours") > 0) & F.col("is_enabled"))
    existing = databases.select(KEY, name_key(F.col("name")).alias("name_key"), "create_date", "name")
    age = hours_between(F.col("checked_at"), now)
    never = F.col("checked_at") == instant("1900-01-01 00:00:00")
    rows = (
        good.join(watched.withColumn("name_key", name_key(F.col("db_name"))), [KEY, "name_key"])
        .join(existing, [KEY, "name_key"])
        .filter(
            (hours_between(F.col("create_date"), now) > F.col("checkdb_frequency_hours"))
            & (F.col("checked_at").isNull() | (age > F.col("checkdb_frequency_hours")))
            & (F.col("checkdb_state_alert") != "OK")
        )
        .select(
            KEY,
            F.col("name").alias("object"),
            F.concat(
                F.lit("database="), quote_name(F.col("name")),
                F.lit("; last_checkdb="),
                F.when(never, "NEVER").otherwise(F.date_format("checked_at", "yyyy-MM-dd'T'HH:mm:ss")),
                F.lit("; checkdb_missed="),
                F.when(never, "ALL").otherwise(
                    _text(F.floor(age / F.col("checkdb_frequency_hours")))
                ),
            ).alias("message"),
            F.col("checkdb_state_alert").alias("state"),
        )
    )
    summary = _monitored_summary(
        policy_database,
        (F.col("checkdb_frequency_hours") > 0) & _not_tempdb("db_name") & F.col("is_enabled"),
        ((F.col("checkdb_frequency_hours") == 0) & _not_tempdb("db_name")) | ~F.col("is_enabled"),
    )
    return with_summary("check_integrity", rows, summary)


def check_database_state(databases: DataFrame, policy_database: DataFrame) -> DataFrame:
    """Databases neither online, restoring nor recovering."""
    watched = databases.select(KEY, "database_id", "name", "state", "state_desc").join(
        policy_database.filter("is_enabled").select(KEY, "database_id", "change_state_alert"),
        [KEY, "database_id"],
    )
    rows = watched.filter(~F.col("state").isin(0, 1, 2)).select(
        KEY,
        F.col("name").alias("object"),
        F.concat(quote_name(F.col("name")), F.lit("="), F.upper("state_desc")).alias("message"),
        F.col("change_state_alert").alias("state"),
    )

    def number(state: int) -> Column:
        return _text(F.count_if(F.col("state") == state))

    summary = watched.groupBy(KEY).agg(
        F.concat(
            number(0), F.lit(" online, "), number(1), F.lit(" restoring, "), number(2),
            F.lit(" recovering."),
        ).alias("message")
    )
    return with_summary("check_database_state", rows, summary)


def check_inventory(
    databases: DataFrame, policy_database: DataFrame, instances: DataFrame
) -> DataFrame:
    """Label of every user database; offline ones only while monitored."""
    rows = (
        databases.join(
            policy_database.select(KEY, "database_id", "is_enabled"), [KEY, "database_id"]
        )
        .filter(
            ~name_key(F.col("name")).isin(*SYSTEM_DATABASES)
            & ((F.col("state_desc") != "OFFLINE") | F.col("is_enabled"))
        )
        .join(instances, KEY)
        .select(
            KEY,
            F.col("name").alias("object"),
            object_label(F.col("name")).alias("message"),
            F.lit("OK").alias("state"),
        )
    )
    summary = instances.select(KEY, F.lit("No user databases found.").alias("message"))
    return with_summary("check_inventory", rows, summary)


def _job_summary(policy_job: DataFrame, monitored: Column, ignored: Column) -> DataFrame:
    return policy_job.groupBy(KEY).agg(
        F.concat(
            _text(F.count_if(monitored)), F.lit(" job(s) monitored; "),
            _text(F.count_if(ignored)), F.lit(" job(s) not monitored; "),
        ).alias("message")
    )


def check_job(job_history: DataFrame, policy_job: DataFrame) -> DataFrame:
    """Enabled jobs whose newest run failed (newest per job name)."""
    run_at = F.col("run_date").cast("long") * 1_000_000 + F.col("run_time")
    # the long pass keeps fixed-width values only, so it runs in hash buffers;
    # names shared by several jobs are settled on its small result
    rank = run_at.cast("decimal(38,0)") * F.lit(Decimal(10) ** 19) + F.col("instance_id")
    per_job = job_history.groupBy(KEY, "job_name", "job_id").agg(
        F.max(rank).alias("rank"), F.max_by("run_status", rank).alias("run_status")
    )
    newest = per_job.groupBy(KEY, "job_name").agg(
        F.max(F.struct("rank", "job_id", "run_status")).alias("run")
    ).select(KEY, "job_name", "run.job_id", "run.run_status")
    outcome = F.lit("UNKNOWN")
    for code, label in OUTCOMES.items():
        outcome = F.when(F.col("run_status") == code, label).otherwise(outcome)
    rows = (
        newest.filter(F.col("run_status") == 0)
        .join(
            policy_job.filter("is_enabled").select(KEY, "job_id", "change_state_alert"),
            [KEY, "job_id"],
        )
        .select(
            KEY,
            F.col("job_name").alias("object"),
            F.concat(F.lit("job="), quote_name(F.col("job_name")), F.lit("; state="), outcome).alias(
                "message"
            ),
            F.col("change_state_alert").alias("state"),
        )
    )
    summary = _job_summary(policy_job, F.col("is_enabled"), ~F.col("is_enabled"))
    return with_summary("check_job", rows, summary)


def check_job_long_running(
    job_activity: DataFrame, policy_job: DataFrame, instances: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """Running jobs beyond their limit; editions without a job agent say so."""
    now = instant(as_of)
    no_agent = instances.filter(F.lower("edition").contains("express"))
    running = job_activity.filter(
        F.col("start_execution_date").isNotNull()
        & F.col("stop_execution_date").isNull()
        & (F.col("start_execution_date") < now)
    )
    ran = minutes_between(F.col("start_execution_date"), now)
    rows = (
        running.join(
            policy_job.filter(F.col("is_enabled") & (F.col("max_exec_time_min") > 0)).select(
                KEY, "job_id", "max_exec_time_min", "change_state_alert"
            ),
            [KEY, "job_id"],
        )
        .filter(ran > F.col("max_exec_time_min"))
        .join(no_agent, KEY, "left_anti")
        .select(
            KEY,
            F.col("job_name").alias("object"),
            F.concat(
                F.lit("job="), quote_name(F.col("job_name")),
                F.lit("; run_duration_min="), _text(ran),
                F.lit("; max_threshold_min="), _text(F.col("max_exec_time_min")),
            ).alias("message"),
            F.col("change_state_alert").alias("state"),
        )
    )
    counts = _job_summary(
        policy_job,
        F.col("is_enabled") & (F.col("max_exec_time_min") > 0),
        ~F.col("is_enabled") | (F.col("max_exec_time_min") <= 0),
    ).join(no_agent, KEY, "left_anti")
    absent = no_agent.select(KEY, F.lit("Express Edition Detected. No SQL Agent.").alias("message"))
    return with_summary("check_job_long_running", rows, counts.unionByName(absent))


def login_totals(
    login_events: DataFrame, policy_login: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """Failures per explicit login and in total, each over its own window.

    A login is left out when its threshold or its period is zero.  The longest
    period of any policy row, one number, bounds the events at the scan; they are
    counted per login before the total is built, so a hot login is combined
    map-side.
    """
    now = instant(as_of)
    longest = longest_period(policy_login)
    since = now - F.expr(f"INTERVAL {longest} MINUTE")
    failures = login_events.filter((F.col("event_ts") >= since) & (F.col("destination_code") == LOGIN_FAILURE))
    # windows are whole minutes before as_of, so events are counted per minute of age
    age = F.ceil((F.unix_micros(now) - F.unix_micros("event_ts")) / 60_000_000)
    counted = failures.groupBy(KEY, F.lower("login_name").alias("login_key"), age.alias("age")).agg(F.count("*").alias("n"))
    return totals_of_minutes(counted, policy_login)


LOGIN_FAILURE = "0x0000001c"


def longest_period(policy_login: DataFrame) -> int:
    """Minutes of the longest window of any login, one number."""
    return int(policy_login.agg(F.max("monitoring_period_minutes")).first()[0] or 0)


def totals_of_minutes(minutes: DataFrame, policy_login: DataFrame) -> DataFrame:
    """`login_totals` from failures counted per minute of age: (instance, login_key, age, n)."""
    default = policy_login.filter(F.col("name") == DEFAULT).select(
        KEY,
        F.col("failed_login_threshold").alias("default_threshold"),
        F.col("monitoring_period_minutes").alias("default_period"),
        F.col("login_failure_alert").alias("default_alert"),
    )
    explicit = policy_login.filter(F.col("name") != DEFAULT)
    counted = minutes.join(default, KEY).join(
        explicit.withColumn("login_key", F.lower("name")), [KEY, "login_key"], "left"
    )
    threshold = F.coalesce("failed_login_threshold", "default_threshold")
    period = F.coalesce("monitoring_period_minutes", "default_period")
    watched = counted.filter((threshold != 0) & (period != 0))

    total = (
        watched.filter(F.col("age") <= F.col("default_period"))
        .groupBy(KEY, "default_threshold", "default_period", "default_alert")
        .agg(F.sum("n").alias("count"))
        .select(
            KEY, F.lit(TOTAL).alias("name"), "count",
            F.col("default_threshold").alias("failed_login_threshold"),
            F.col("default_period").alias("monitoring_period_minutes"),
            F.col("default_alert").alias("login_failure_alert"),
        )
    )
    single = (
        watched.filter(F.col("name").isNotNull() & (F.col("age") <= F.col("monitoring_period_minutes")))
        .groupBy(
            KEY, "name", "failed_login_threshold", "monitoring_period_minutes", "login_failure_alert"
        )
        .agg(F.sum("n").alias("count"))
    )
    return total.unionByName(single).select(
        KEY, "name", "count", "failed_login_threshold", "monitoring_period_minutes",
        F.when(F.col("count") >= F.col("failed_login_threshold"), F.col("login_failure_alert"))
        .otherwise("OK").alias("state"),
    )


def check_login_failures(
    login_events: DataFrame, policy_login: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """One line per instance: explicit login, then total, then OK, then NA."""
    totals = login_totals(login_events, policy_login, as_of=as_of)
    is_total = F.col("name") == TOTAL
    alarmed = F.col("state").isin("WARNING", "CRITICAL")
    precedence = F.when(alarmed & ~is_total, 0).when(is_total, 1)
    # CRITICAL sorts before WARNING, higher counts first; the name breaks ties
    best = (
        totals.withColumn("precedence", precedence)
        .filter(F.col("precedence").isNotNull())
        .groupBy(KEY)
        .agg(
            F.min(
                F.struct(
                    "precedence",
                    F.when(F.col("precedence") == 0, F.col("state")).alias("rank"),
                    (-F.col("count")).alias("fewest"),
                    "name", "state", "count", "failed_login_threshold", "monitoring_period_minutes",
                )
            ).alias("r")
        )
        .select(KEY, "r.*")
    )
    n, limit = _text(F.col("count")), _text(F.col("failed_login_threshold"))
    span = _text(F.col("monitoring_period_minutes"))
    head = F.lit("Total number of login failures ")
    message = (
        F.when(
            F.col("precedence") == 0,
            F.concat(head, F.lit("for a monitored login was "), n, F.lit(", exceeding threshold of "),
                     limit, F.lit(" per "), span, F.lit(" minute window.")),
        )
        .when(
            alarmed,
            F.concat(head, F.lit("in the last "), span, F.lit(" minutes was "), n,
                     F.lit(", exceeding threshold of "), limit),
        )
        .otherwise(
            F.concat(head, F.lit("in the last "), span, F.lit(" minutes was "), n,
                     F.lit(", below threshold of "), limit, F.lit(" per "), span,
                     F.lit(" minute window."))
        )
    )
    rows = best.select(KEY, F.col("name").alias("object"), message.alias("message"), "state")
    quiet = policy_login.filter(F.col("name") == DEFAULT).select(
        KEY,
        F.concat(
            head, F.lit("in the last "), _text(F.col("monitoring_period_minutes")),
            F.lit(" minutes was 0"),
        ).alias("message"),
    )
    return with_summary("check_login_failures", rows, quiet)


def check_login_failures_detail(
    login_events: DataFrame, policy_login: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """Every counted login and the total, with `section` 0 before 1.

    The reading order is (section, state, count descending, name); it is kept
    as columns, and a sink sorts by them.
    """
    totals = login_totals(login_events, policy_login, as_of=as_of)
    return totals.select(
        KEY, F.when(F.col("name") == TOTAL, 1).otherwise(0).alias("section"), "name", "count",
        "failed_login_threshold", "monitoring_period_minutes", "state",
    )


def check_logshipping(
    logship_primary: DataFrame, logship_secondary: DataFrame, policy_database: DataFrame,
    instances: DataFrame, *, as_of: datetime | str,
) -> DataFrame:
    """Backup lag on primaries and restore lag on secondaries."""
    now = instant(as_of)
    policy = policy_database.select(
        KEY, name_key(F.col("db_name")).alias("name_key"), "change_state_alert", "is_enabled"
    )

    def joined(side: DataFrame, database: str) -> DataFrame:
        return side.withColumn("name_key", name_key(F.col(database))).join(policy, [KEY, "name_key"])

    primary = joined(logship_primary, "primary_database")
    secondary = joined(logship_secondary, "secondary_database")
    p_lag = minutes_between(F.col("last_backup_date_utc"), now)
    s_lag = minutes_between(F.col("last_restored_date_utc"), now)
    late_primary = primary.filter(
        F.col("threshold_alert_enabled") & (p_lag > F.col("backup_threshold"))
    ).select(
        KEY,
        F.col("primary_database").alias("object"),
        F.concat(
            F.lit("database="), quote_name(F.col("primary_database")),
            F.lit("; role=PRIMARY; last_backup_minago="), _text(p_lag),
        ).alias("message"),
        F.col("change_state_alert").alias("state"),
    )
    late_secondary = secondary.filter(
        F.col("threshold_alert_enabled") & (s_lag > F.col("restore_threshold"))
    ).select(
        KEY,
        F.col("secondary_database").alias("object"),
        F.concat(
            F.lit("database="), quote_name(F.col("secondary_database")),
            F.lit("; role=SECONDARY; primary_source="), quote_name(F.col("primary_server")),
            F.lit("."), quote_name(F.col("primary_database")),
            F.lit("; last_restore_minago="), _text(s_lag),
        ).alias("message"),
        F.col("change_state_alert").alias("state"),
    )
    counts = (
        primary.filter("is_enabled").select(KEY, F.lit(1).alias("p"), F.lit(0).alias("s"))
        .unionByName(secondary.filter("is_enabled").select(KEY, F.lit(0).alias("p"), F.lit(1).alias("s")))
        .groupBy(KEY)
        .agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
    )
    summary = instances.select(KEY).join(counts, KEY, "left").select(
        KEY,
        F.when(
            F.col("p").isNull(), F.lit("Logshipping is currently not configured.")
        ).otherwise(
            F.concat(_text(F.col("p")), F.lit(" primary database(s), "), _text(F.col("s")),
                     F.lit(" secondary database(s), "))
        ).alias("message"),
    )
    return with_summary("check_logshipping", late_primary.unionByName(late_secondary), summary)


def check_mirroring(
    databases: DataFrame, mirror_state: DataFrame, policy_database: DataFrame, instances: DataFrame
) -> DataFrame:
    """State and role of every mirrored database.

    An unset expected role raises nothing by itself, and leaves no message.
    """
    rows = (
        mirror_state.filter(F.col("mirroring_guid").isNotNull())
        .drop("database_name")
        .join(databases.select(KEY, "database_id", "name"), [KEY, "database_id"])
        .join(
            policy_database.filter("is_enabled").select(
                KEY, "database_id", "mirroring_role", "change_state_alert"
            ),
            [KEY, "database_id"],
        )
        .select(
            KEY,
            F.col("name").alias("object"),
            F.concat(
                F.lit("database="), quote_name(F.col("name")),
                F.lit("; state="), F.upper("mirroring_state_desc"),
                F.lit("; expected_role="), F.upper("mirroring_role"),
                F.lit("; current_role="), F.upper("mirroring_role_desc"),
            ).alias("message"),
            F.when(
                ~F.col("mirroring_state").isin(2, 4)
                | (F.lower("mirroring_role") != F.lower("mirroring_role_desc")),
                F.col("change_state_alert"),
            ).otherwise("OK").alias("state"),
        )
    )
    summary = instances.select(KEY, F.lit("Mirroring is currently not configured.").alias("message"))
    return with_summary("check_mirroring", rows, summary)


def check_replica_group(
    replica_state: DataFrame, policy_replica_group: DataFrame, instances: DataFrame
) -> DataFrame:
    """Health before role; all non-OK rows if anything alerts, else one summary.

    `hadr_enabled`, where `instances` has it, separates estates without the
    feature.
    """
    judged = replica_state.join(
        policy_replica_group.drop("ag_name"), [KEY, "ag_id"]
    ).select(
        KEY,
        F.col("ag_name").alias("object"),
        F.concat(
            F.lit("ag="), F.col("ag_name"),
            F.lit("; sync="), F.col("synchronization_health_desc"),
            F.lit("; conn="), F.col("connected_state_desc"),
            F.lit("; exp_role="), F.col("ag_role"),
            F.lit("; curr_role="), F.col("role_desc"), F.lit("; "),
        ).alias("message"),
        F.when(
            F.col("ag_state_is_enabled")
            & ((F.col("synchronization_health") != 2) | (F.col("connected_state") != 1)),
            F.col("ag_state_alert"),
        )
        .when(
            F.col("ag_role_is_enabled") & (F.lower("ag_role") != F.lower("role_desc")),
            F.col("ag_role_alert"),
        )
        .otherwise("OK").alias("state"),
    )
    verdict = judged.groupBy(KEY).agg(
        F.count("*").alias("groups"),
        F.max(F.col("state").isin("WARNING", "CRITICAL")).alias("alarmed"),
    )
    problems = judged.filter(F.col("state") != "OK").join(
        verdict.filter("alarmed"), KEY, "left_semi"
    )
    healthy = verdict.filter(~F.col("alarmed")).select(
        KEY, F.lit(None).cast("string").alias("object"),
        F.concat(F.lit("Always-On ("), _text(F.col("groups")),
                 F.lit(") availability groups healthy.")).alias("message"),
        F.lit("OK").alias("state"),
    )
    absent = "Always-On is currently not configured."
    if "hadr_enabled" in instances.columns:
        text = F.when(F.col("hadr_enabled"), absent).otherwise("Always-On is not available.")
    else:
        text = F.lit(absent)
    summary = instances.select(KEY, text.alias("message"))
    return with_summary("check_replica_group", problems.unionByName(healthy), summary)


def check_rollup(checks: DataFrame) -> DataFrame:
    """Per instance and check: worst code and count without NA, with a row for each distinct line.

    Every row repeats the code and the count of the whole group; `copies` is how
    often the line occurs.
    """
    line = F.concat(F.upper("state"), F.lit(" - "), F.col("message"))
    told = F.substring_index("message", " - ", 1)
    return listed(
        checks.select(KEY, "check", line.alias("line")), [KEY, "check"], {"message": "line"},
        lambda n: [
            F.max(state_code(told)).alias("state_code"),
            F.sum(F.when(told != "NA", n).otherwise(0)).alias("count"),
        ],
    )
