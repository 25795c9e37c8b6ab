"""Every operator wired to the base tables, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics
from ..operators import (
    activity, advice, charts, checks, compliance, facts, history, policy, reports,
)
from ..sources.adapters import AS_OF, AS_OF_EVENTS, adapt
from ..sources.exchange import (
    read_collected, read_collected_xml, route_by_dataset, shred_events_xml, write_dataset, write_snapshots,
)
from ..sources.tables import prepare, stream_table
from ..streaming import streams
from .fixpoint import run_folder
from .run import run_checks


class Inputs:
    """Operator inputs by name, as tables or as streams."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._seen: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        return adapt(self.spark, self.folder, name, seen=self._seen)

    def stream(self, name: str) -> DataFrame:
        return adapt(self.spark, self.folder, name, read=stream_table)

    def scratch(self) -> str:
        """A new folder in this session's own one."""
        return f"{run_folder(self.spark)}/{uuid.uuid4().hex}"


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(name: str):
    def keep(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        return build

    return keep


def present(df: DataFrame) -> DataFrame:
    """Columns as plain values: decimals as double, instants and arrays as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        out.append(c.alias(field.name))
    return df.select(*out)


def runner(build: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return present(build(Inputs(spark, folder)))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(build) for name, build in QUERIES.items()}


# ---- policy ---------------------------------------------------------------

query("param_resolve")(lambda i: policy.param_resolve(i("parameters")))
query("policy_add_missing")(
    lambda i: policy.policy_add_missing(
        i("databases"), i("old_policy_database"), policy.param_resolve(i("parameters")),
        roles=i("mirror_state"),
    )
)
query("policy_add_missing_jobs")(
    lambda i: policy.policy_add_missing(
        i("jobs"), i("old_policy_job"), policy.param_resolve(i("parameters")), kind="job"
    )
)
query("policy_add_missing_groups")(
    lambda i: policy.policy_add_missing(
        i("replica_state"), i("old_policy_group"), policy.param_resolve(i("parameters")), kind="group"
    )
)
query("policy_refresh_names")(
    lambda i: policy.policy_refresh_names(i("live_databases"), i("old_policy_database"))
)
query("policy_backfill_role")(
    lambda i: policy.policy_backfill_role(i("mirror_state"), i("old_policy_database"))
)
query("policy_prune")(lambda i: policy.policy_prune(i("live_databases"), i("policy_database")))
query("policy_merge")(
    lambda i: policy.policy_merge(
        i("policy_counter"), i("saved_policy_counter"),
        ["instance_guid", "object_name", "counter_name", "instance_name"],
        ["warning_threshold", "critical_threshold"],
    )
)
query("role_change_stamp")(lambda i: policy.role_change_stamp(i("replica_snapshots")))


@query("eav_upsert")
def _(i: Inputs) -> DataFrame:
    eav = i("service_eav")
    cut = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    return policy.eav_upsert(
        eav.filter(F.col("lastseen") < cut), eav.filter(F.col("lastseen") >= cut),
        as_of="2024-02-10 00:00:00",
    )


query("retention_purge")(
    lambda i: policy.retention_purge(i("job_activity"), "start_execution_date", as_of=AS_OF, keep_days=92)
)
query("retention_purge_months")(
    lambda i: policy.retention_purge(i("backup_history"), "backup_finish_date", as_of=AS_OF, keep_months=3)
    .drop("encryptor_type")
)
query("policy_validate")(
    lambda i: policy.policy_validate(
        i("saved_policy_counter").withColumn("alert", F.col("object_name")),
        ["object_name", "counter_name", "instance_name"], ["alert"],
        [("warning_threshold", "critical_threshold")],
    )
)

# ---- checks ---------------------------------------------------------------


@query("check_backup")
def _check_backup(i: Inputs) -> DataFrame:
    return checks.check_backup(
        i("databases"), i("backup_history"), i("policy_database"), i("instances"), as_of=AS_OF
    )


@query("check_backup_replicated")
def _(i: Inputs) -> DataFrame:
    return checks.check_backup_replicated(
        i("databases"), i("backup_history"), i("policy_database"), i("instances"),
        i("replica_state"), i("group_databases"), i("policy_replica_group"), as_of=AS_OF,
    )


@query("check_integrity")
def _check_integrity(i: Inputs) -> DataFrame:
    return checks.check_integrity(i("db_info"), i("databases"), i("policy_database"), as_of=AS_OF)


@query("check_database_state")
def _check_database_state(i: Inputs) -> DataFrame:
    return checks.check_database_state(i("databases"), i("policy_database"))


query("check_inventory")(
    lambda i: checks.check_inventory(i("databases"), i("policy_database"), i("instances"))
)


@query("check_job")
def _check_job(i: Inputs) -> DataFrame:
    return checks.check_job(i("job_history"), i("policy_job"))


query("check_job_long_running")(
    lambda i: checks.check_job_long_running(
        i("job_activity"), i("policy_job"), i("instances"), as_of=AS_OF
    )
)
query("check_login_failures")(
    lambda i: checks.check_login_failures(i("login_events"), i("policy_login"), as_of=AS_OF_EVENTS)
)
query("check_login_failures_detail")(
    lambda i: checks.check_login_failures_detail(
        i("login_events"), i("policy_login"), as_of=AS_OF_EVENTS
    )
)
query("check_logshipping")(
    lambda i: checks.check_logshipping(
        i("logship_primary"), i("logship_secondary"), i("policy_database"), i("instances"), as_of=AS_OF
    )
)
query("check_mirroring")(
    lambda i: checks.check_mirroring(
        i("databases"), i("mirror_state"), i("policy_database"), i("instances")
    )
)
query("check_replica_group")(
    lambda i: checks.check_replica_group(i("replica_state"), i("policy_replica_group"), i("instances"))
)


@query("check_rollup")
def check_rollup(i: Inputs) -> DataFrame:
    """All state checks of the estate rolled up to one line per check."""
    found = (
        _check_backup(i)
        .unionByName(_check_integrity(i))
        .unionByName(_check_database_state(i))
        .unionByName(_check_job(i))
    )
    return checks.check_rollup(found)


query("run_checks")(lambda i: run_checks(i, as_of=AS_OF))

# ---- charts ---------------------------------------------------------------


def _files(i: Inputs) -> DataFrame:
    return charts.file_inventory(i("db_files"), i("databases"), i("policy_database"))


def _filegroups(i: Inputs) -> DataFrame:
    return charts.filegroup_headroom(charts.file_headroom(_files(i), i("drives")))


query("file_inventory")(_files)


@query("file_headroom")
def _(i: Inputs) -> DataFrame:
    return charts.file_headroom(_files(i), i("drives")).select(
        "instance_guid", "database_id", "file_id", "drive", "disk_free_mb", "headroom_mb"
    )


query("filegroup_headroom")(_filegroups)


@query("chart_capacity")
def _chart_capacity(i: Inputs) -> DataFrame:
    return charts.chart_capacity(_filegroups(i), i("policy_database"))


@query("chart_capacity_drive")
def _(i: Inputs) -> DataFrame:
    unreadable = i("group_databases").join(
        i("replica_state").filter((F.col("role_desc") == "SECONDARY") & F.col("secondary_unreadable")),
        ["instance_guid", "ag_id"], "left_semi",
    )
    return charts.chart_capacity_drive(i("db_files"), i("databases"), i("drives"), unreadable)


query("counter_match")(lambda i: charts.counter_match(i("counter_samples"), i("policy_counter")))


@query("counter_rate")
def _counter_rate(i: Inputs) -> DataFrame:
    return charts.counter_rate(i("counter_samples"))


@query("counter_uom")
def _(i: Inputs) -> DataFrame:
    return i("counter_samples").select(
        "instance_guid", "seq", "counter_name", "instance_name", "cntr_type",
        charts.counter_uom(F.col("counter_name"), F.col("instance_name"), F.col("cntr_type")).alias("uom"),
    )


@query("chart_counter")
def _chart_counter(i: Inputs) -> DataFrame:
    matched = charts.counter_match(_counter_rate(i), i("policy_counter"))
    return charts.chart_counter(matched)


@query("chart_evaluate")
def _(i: Inputs) -> DataFrame:
    return charts.chart_evaluate(_chart_capacity(i).withColumn("chart", F.lit("capacity")))


# ---- history --------------------------------------------------------------


def _windows(i: Inputs, dataset: str, as_of: str = AS_OF) -> DataFrame:
    return history.extract_window(i("marks"), dataset, as_of=as_of)[0]


query("extract_window")(lambda i: _windows(i, "log_backup"))
query("extract_window_marks")(
    lambda i: history.extract_window(i("marks"), "log_job", as_of=AS_OF, mark=True)[1]
)


@query("log_backup")
def _(i: Inputs) -> DataFrame:
    return history.log_backup(
        i("backup_history"), i("databases"), i("policy_database"), _windows(i, "log_backup")
    ).drop("encryptor_thumbprint")


@query("log_capacity")
def _log_capacity(i: Inputs) -> DataFrame:
    return history.log_capacity(i("db_files"), i("databases"), i("drives"), as_of=AS_OF)


query("drive_sizes")(lambda i: history.drive_sizes(i("volume_eav"), i("drive_free")))
@query("stage_capacity_append")
def _(i: Inputs) -> DataFrame:
    """The staged months are folders of one table; today's rows go to it, expired months from it."""
    folder = i.scratch()
    write_snapshots(i("stage_capacity"), folder, "check_date", period="month")
    return history.append_capacity(_log_capacity(i).select(*i("stage_capacity").columns), folder, as_of=AS_OF)



query("log_error_pairs")(
    lambda i: history.log_error_pairs(
        i("error_log"), i("messages"), _windows(i, "log_error", AS_OF_EVENTS), sanitize=False
    )
)
query("log_error_pairs_sanitized")(
    lambda i: history.log_error_pairs(
        i("error_log"), i("messages"), _windows(i, "log_error", AS_OF_EVENTS), sanitize=True
    )
)
query("log_error_integrity")(
    lambda i: history.log_error_integrity(
        i("error_log"), _windows(i, "log_error", AS_OF_EVENTS), sanitize=True
    )
)
query("log_job")(
    lambda i: history.log_job(i("job_history"), i("messages"), _windows(i, "log_job"), sanitize=False)
)
query("log_job_sanitized")(
    lambda i: history.log_job(i("job_history"), i("messages"), _windows(i, "log_job"), sanitize=True)
)
query("log_maintenance")(
    lambda i: history.log_maintenance(
        i("plans"), i("subplans"), i("plan_log"), i("jobs"), _windows(i, "log_maintenance")
    )
)


@query("sanitize_message")
def _(i: Inputs) -> DataFrame:
    return history.sanitize_message(
        i("job_history"), i("messages"), "message", "sql_message_id", sanitize=True
    ).select("instance_id", "sql_message_id", "message")


query("clean_text")(
    lambda i: i("texts").select("doc_id", semantics.clean_text(F.col("text")).alias("text"))
)
query("iso_with_offset")(
    lambda i: i("login_events").select(
        "event_id", "destination_code", semantics.iso_with_offset(F.col("event_ts")).alias("at")
    )
)

# ---- reports --------------------------------------------------------------

query("backup_status_report")(
    lambda i: reports.backup_status_report(
        i("live_databases"), i("backup_history"), i("restore_history"), i("logship_secondary_late"),
        i("report_params"), as_of=AS_OF, restored_within_days=30,
    )
)
query("database_size_report")(
    lambda i: reports.database_size_report(
        i("databases"), i("db_files"), i("policy_database"), "SQL_Latin1_General_CP1_CI_AS"
    )
)
query("error_keyword_report")(
    lambda i: reports.error_keyword_report(i("error_log"), i("instances"), as_of=AS_OF_EVENTS, days=40)
)
query("job_failure_report")(
    lambda i: reports.job_failure_report(i("job_history"), i("instances"), as_of=AS_OF, days=3000)
)
query("job_failure_report_daily")(
    lambda i: reports.job_failure_report(
        i("job_history"), i("instances"), as_of="2001-08-01 18:00:00", until_as_of=False
    )
)
query("version_report")(lambda i: reports.version_report(i("instances")))


# ---- facts ----------------------------------------------------------------

query("fact_job")(
    lambda i: facts.fact_job(
        i("jobs"), i("job_steps"), i("proxies"), i("operators"), i("schedules"), i("job_schedules")
    )
)
query("schedule_description")(
    lambda i: i("schedules").select(
        "instance_guid", "schedule_id", facts.schedule_description().alias("schedule_desc")
    )
)
query("fact_replica_group")(
    lambda i: facts.fact_replica_group(
        i("ag_groups"), i("ag_replicas"), i("ag_listeners"), i("ag_listener_ips"),
        i("group_databases"), i("policy_replica_group"),
    )
)
query("fact_database")(lambda i: facts.fact_database(i("databases")))
query("fact_database_file")(lambda i: facts.fact_database_file(i("db_files"), i("databases")))
query("fact_mail")(
    lambda i: facts.fact_mail(
        i("mail_profiles"), i("mail_profile_accounts"), i("mail_accounts"), i("mail_principals")
    )
)
query("fact_parameters")(
    lambda i: facts.fact_parameters(
        i("parameters"),
        {
            "config_database": (i("policy_database"), ["database_id", "db_name", "is_enabled"]),
            "config_job": (i("policy_job"), ["job_id", "job_name", "max_exec_time_min"]),
            "config_replica_group": (i("policy_replica_group"), ["ag_id", "ag_name", "ag_role"]),
        },
        ["DEFAULT_BACKUP_FREQ", "DEFAULT_DB_STATE", "SANITIZE_DATASET", "TENANT_NAME"],
    )
)
query("fact_instance_options")(lambda i: facts.fact_instance_options(i("instance_options")))
query("fact_logshipping_primary")(lambda i: facts.fact_logshipping_primary(i("logship_primary")))
query("fact_logshipping_secondary")(
    lambda i: facts.fact_logshipping_secondary(i("logship_secondary"), i("secondary_config"))
)
query("fact_maintenance_plan")(
    lambda i: facts.fact_maintenance_plan(i("plans"), i("subplans"), i("jobs"))
)
query("fact_mirroring")(lambda i: facts.fact_mirroring(i("mirror_state")))
query("fact_replication_publisher")(
    lambda i: facts.fact_replication_publisher(i("publications"), i("articles"), i("subscriptions"))
)
query("fact_replication_subscriber")(
    lambda i: facts.fact_replication_subscriber(i("replication_subscriptions"))
)
query("fact_resource_governor")(
    lambda i: facts.fact_resource_governor(
        i("governor_config"), i("resource_pools"), i("workload_groups")
    )
)
query("fact_security")(
    lambda i: facts.fact_security(
        i("principals"), i("server_role_members"), i("permissions"), i("group_members"),
        i("database_principals"), i("database_role_members"),
    )
)
query("role_membership_closure")(
    lambda i: facts.role_membership_closure(i("role_principals"), i("role_members"))
)
query("fact_server_object")(
    lambda i: facts.fact_server_object(
        i("linked_servers"), i("linked_logins"), i("principals"), i("server_triggers")
    )
)
query("fact_service")(
    lambda i: facts.fact_service(
        i("instance_properties"), i("service_eav"), i("trace_flags"), i("instances")
    )
)

# ---- compliance -----------------------------------------------------------


@query("cis_rules")
def _cis_rules(i: Inputs) -> DataFrame:
    return compliance.cis_rules(
        i("instances"), i("instance_options"), i("instance_properties"), i("service_accounts"),
        i("principals"), i("permissions"), i("server_role_members"), i("database_flags"),
        i("database_security"), i("assemblies"), i("audit_actions"), i("proxy_grants"),
    )


query("cis_admin_accounts")(lambda i: compliance.cis_admin_accounts(i("service_accounts")))
query("cis_score")(lambda i: compliance.cis_score(_cis_rules(i)))
query("cis_filter_failed")(lambda i: compliance.cis_filter(_cis_rules(i), "failed"))
query("cis_filter_notscored")(lambda i: compliance.cis_filter(_cis_rules(i), "notscored"))
query("cis_cross_db_evidence")(lambda i: compliance.cis_cross_db_evidence(i("database_security")))

# ---- activity -------------------------------------------------------------

query("session_filter")(
    lambda i: activity.session_filter(i("sessions"), "program", "app[_]1%", "host", "%7")
)
query("session_interest")(lambda i: activity.session_interest(i("sessions")))
query("session_delta")(
    lambda i: activity.session_delta(
        i("sessions"), from_ts="1998-06-01 00:00:00", to_ts="2000-06-01 00:00:00"
    )
)


@query("wait_rollup")
def _wait_rollup(i: Inputs) -> DataFrame:
    return activity.wait_rollup(i("waits"))


query("wait_format")(lambda i: activity.wait_format(_wait_rollup(i)))
query("block_leaders")(lambda i: activity.block_leaders(i("sessions")))
query("lock_rollup")(lambda i: activity.lock_rollup(i("locks")))
query("tran_log_rollup")(lambda i: activity.tran_log_rollup(i("tran_log")))
query("tran_log_format")(
    lambda i: activity.tran_log_format(activity.tran_log_rollup(i("tran_log")))
)
query("avg_elapsed")(
    lambda i: activity.avg_elapsed(i("requests"), i("statement_stats")).select(
        "instance_guid", "request_id", "statement_id", "avg_elapsed_ms"
    )
)
query("activity_view")(
    lambda i: activity.activity_view(
        i("sessions"), "[instance_guid][snapshot_ts][session%][no such][%name]", "[reads] DESC[session_id]"
    )
)
query("duration_format")(
    lambda i: i("requests").select(
        "request_id", activity.duration_format(F.col("total_elapsed_time") * 1009).alias("elapsed")
    )
)
query("running_requests")(
    lambda i: activity.running_requests(i("requests"), i("session_info"), i("connections"), own_id=7)
)

# ---- advice ---------------------------------------------------------------


@query("select_objects")
def _select_objects(i: Inputs) -> DataFrame:
    objects = advice.selectable_databases(i("databases"), i("group_databases"))
    return advice.select_objects(
        objects, "AVAILABILITY_GROUP_DATABASES, [Customer#000000%],-%7,-%_0,USER_DATABASES"
    )


def _ranked(i: Inputs, order: str | None) -> DataFrame:
    sizes = i("db_files").groupBy("instance_guid", "database_id").agg(F.sum("size_pages").alias("size_mb"))
    commands = advice.last_successful_command(i("command_log")).withColumnRenamed("database_name", "name")
    objects = (
        _select_objects(i)
        .join(sizes, ["instance_guid", "database_id"], "left")
        .join(commands, ["instance_guid", "name"], "left")
    )
    return advice.rank_objects(objects, order)


query("rank_objects")(lambda i: _ranked(i, None))
query("rank_objects_by_size")(lambda i: _ranked(i, "DATABASE_SIZE_DESC"))
query("rank_objects_by_command")(lambda i: _ranked(i, "REPLICA_LAST_GOOD_CHECK_ASC"))


@query("fragmentation_action")
def _fragmentation_action(i: Inputs) -> DataFrame:
    return advice.fragmentation_action(i("index_stats"), max_pages=4900)


query("stats_update_due")(lambda i: advice.stats_update_due(_fragmentation_action(i), "INDEX", level=5))
query("backup_type_choice")(lambda i: advice.backup_type_choice(i("db_stats"), "LOG", level=50))
query("log_backup_due")(lambda i: advice.log_backup_due(i("db_stats"), 40, 30000, as_of=AS_OF))
query("command_history_summary")(lambda i: advice.command_history_summary(i("command_log")).withColumn("day", F.col("day").cast("string")))
query("fact_diff")(
    lambda i: facts.fact_diff(i("fact_before"), i("fact_after"), ["instance_guid", "database_id"])
)
query("last_successful_command")(lambda i: advice.last_successful_command(i("command_log")))

# ---- exchange -------------------------------------------------------------


@query("read_collected")
def _(i: Inputs) -> DataFrame:
    """Written per instance and run, then read back."""
    rows = i("command_log").select("instance_guid", "database_name", "command_type", "start_time", "error_number")
    return read_collected(i.spark, write_dataset(rows, i.scratch(), "[log].[command]", "20010802000000"))


@query("read_collected_xml")
def _(i: Inputs) -> DataFrame:
    """Documents per instance and run, one of them broken off, read back; the broken record is counted apart."""
    rows = i("command_log").select("instance_guid", "database_name", "command_type", "start_time", "error_number")
    target = write_dataset(rows, i.scratch(), "[log].[command]", "20010802000000", format="xml")
    # the first document of one instance, cut in the middle of a row
    one = rows.filter(F.col("database_name").isNotNull()).orderBy(*rows.columns).limit(1)
    torn = one.select(F.concat(F.lit("<table><row><database_name>"), "database_name").alias("value"))
    torn.coalesce(1).write.text(f"{target}/drop=[torn]_logcommand_20010802000000")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "instance_guid")
    found = read_collected_xml(i.spark, target, schema)
    broken = found.broken.groupBy("instance_guid", "dataset").agg(F.count("*").alias("broken_records"))
    return found.rows.withColumn("broken_records", F.lit(0).cast("long")).unionByName(broken, allowMissingColumns=True)


@query("write_dataset")
def _(i: Inputs) -> DataFrame:
    """Folders a write leaves behind, with their rows."""
    target = write_dataset(i("job_activity"), i.scratch(), "log.job activity", "20010802000000")
    return i.spark.read.parquet(target).groupBy("drop").agg(F.count("*").alias("rows"))


query("route_by_dataset")(
    lambda i: route_by_dataset(
        i("file_names"), {"*_log_backup_*": "backup", "*_log_job_*": "job", "*_fact_*": "fact"}
    )
)
query("shred_events_xml")(lambda i: shred_events_xml(i("raw_events")))

# ---- streams --------------------------------------------------------------


def _drain(df: DataFrame, folder: str) -> DataFrame:
    started = streams.stream_extract(df, f"{folder}/out", f"{folder}/checkpoint")
    started.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def _drained(started, spark: SparkSession, folder: str) -> DataFrame:
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


query("stream_login_failures")(
    lambda i: _drain(streams.stream_login_failures(i.stream("login_events"), threshold=2), i.scratch())
)
query("stream_login_failures_minute")(
    lambda i: _drain(
        streams.stream_login_failures(
            i.stream("login_events"), threshold=1, window="1 minute", slide=None
        ),
        i.scratch(),
    )
)
query("stream_dedupe_events")(
    lambda i: _drain(
        streams.stream_dedupe_events(i.stream("login_events")).select(
            "instance_guid", "event_id", "event_ts", "login_name"
        ),
        i.scratch(),
    )
)
query("stream_extract")(lambda i: _drain(i.stream("backup_history"), i.scratch()))


@query("stream_login_totals")
def _(i: Inputs) -> DataFrame:
    """Of the newest batch: each watched login over its own window."""
    folder = i.scratch()
    streams.stream_login_totals(i.stream("login_events"), i("policy_login"), folder).awaitTermination()
    return streams.latest_totals(i.spark, folder)


@query("stream_counter_rate")
def _(i: Inputs) -> DataFrame:
    folder = i.scratch()
    return _drained(streams.stream_counter_rate(i.stream("counter_samples"), folder), i.spark, folder)


for _name, _sanitize in (("stream_error_pairs", False), ("stream_error_pairs_sanitized", True)):

    @query(_name)
    def _(i: Inputs, sanitize: bool = _sanitize) -> DataFrame:
        folder = i.scratch()
        return _drained(
            streams.stream_error_pairs(i.stream("error_log"), i("messages"), folder, sanitize=sanitize), i.spark, folder
        )


@query("stream_eav_upsert")
def _(i: Inputs) -> DataFrame:
    folder, as_of, rows = i.scratch(), "2024-02-10 00:00:00", i.stream("service_eav")
    streams.stream_eav_upsert(rows, folder, as_of=as_of).awaitTermination()
    return streams.current_inventory(i.spark, folder, rows.select(*streams._EAV_COLUMNS).schema, as_of=as_of)


@query("stream_alert_transitions")
def _(i: Inputs) -> DataFrame:
    folder = i.scratch()
    return _drained(streams.stream_alert_transitions(i.stream("check_results"), folder), i.spark, folder)
