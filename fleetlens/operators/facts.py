"""Configuration inventory: projections of catalogue tables, children as rows of their own kind."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import KEY, clean_text, pages_to_mb, quote_name
from ..plans.fixpoint import closure, reachable
from ..plans.nesting import nest

# fixed values: schedule vocabulary
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
RELATIVE = {1: "first ", 2: "second ", 4: "third ", 8: "fourth ", 16: "last "}
RELATIVE_DAYS = dict(enumerate([*WEEKDAYS, "day", "week day", "weekend day"], start=1))
SUBDAY_UNITS = {2: " second", 4: " minute", 8: " hour"}

# fixed values: replication codes
REPLICATION_FREQUENCY = {0: "Transactional", 1: "Snapshot"}
SYNC_METHOD = {
    0: "Native bulk copy program utility (BCP)",
    1: "Character BCP",
    3: "Concurrent, which means that native BCP is used but tables are not locked during the snapshot",
    4: "Concurrent_c, which means that character BCP is used but tables are not locked during the snapshot",
}
CONFLICT_POLICY = {
    1: "Publisher wins the conflict",
    2: "Subscriber wins the conflict",
    3: "Subscription is reinitialized",
}
PRE_CREATION = {0: "None", 1: "Drop", 2: "Delete", 3: "Truncate"}
SUBSCRIPTION_TYPE = {0: "Push", 1: "Pull"}

# fixed values: inventory properties that only add noise
NOISE = ("ProcessID", "SqlCharSetName", "SqlSortOrderName", "LicenseType", "NumLicenses")


def decoded(code: Column, names: Mapping[int, str]) -> Column:
    out = None
    for value, text in names.items():
        out = F.when(code == value, text) if out is None else out.when(code == value, text)
    return out


def _clock(hhmmss: Column) -> Column:
    """Integer hhmmss as `h:mm AM`."""
    at = F.make_timestamp(
        F.lit(2000), F.lit(1), F.lit(1), F.floor(hhmmss % 1000000 / 10000).cast("int"),
        F.floor(hhmmss % 10000 / 100).cast("int"), F.lit(0),
    )
    return F.date_format(at, "h:mm a")


def schedule_description() -> Column:
    """Text of a schedule from its frequency columns."""
    kind, interval = F.col("freq_type"), F.col("freq_interval")
    every = F.col("freq_recurrence_factor")

    def recurring(once: str, unit: str) -> Column:
        return F.when(every == 1, once).when(
            every > 1, F.concat(F.lit("Every "), every.cast("string"), F.lit(unit))
        )

    days = F.concat_ws(
        ", ", *[F.when(interval.bitwiseAND(1 << n) != 0, day) for n, day in enumerate(WEEKDAYS)]
    )
    ordinal = (
        F.when(interval.isin(1, 21, 31), "st").when(interval.isin(2, 22), "nd")
        .when(interval.isin(3, 23), "rd").otherwise("th")
    )
    base = (
        F.when(
            kind == 1,
            F.concat(
                F.lit("Once on "),
                F.date_format(F.to_date(F.col("active_start_date").cast("string"), "yyyyMMdd"), "yyyy.MM.dd"),
            ),
        )
        .when(kind == 4, "Daily")
        .when(kind == 8, F.concat(recurring("Weekly on ", " weeks on "), days))
        .when(
            kind == 16,
            F.concat(recurring("Monthly on the ", " months on the "), interval.cast("string"), ordinal),
        )
        .when(
            kind == 32,
            F.concat(
                recurring("Monthly on the ", " months on the "),
                decoded(F.col("freq_relative_interval"), RELATIVE), decoded(interval, RELATIVE_DAYS),
            ),
        )
        .when(kind == 64, "Automatically starts when SQLServerAgent starts.")
        .when(kind == 128, "Starts whenever the CPUs become idle")
        .otherwise("")
    )
    subday, n = F.col("freq_subday_type"), F.col("freq_subday_interval")
    start, end = _clock(F.col("active_start_time")), _clock(F.col("active_end_time"))
    repeats = subday.isin(2, 4, 8)
    cadence = F.when((subday == 1) | (kind == 1), F.concat(F.lit(" at "), start)).when(
        repeats,
        F.concat(
            F.lit(" every "), n.cast("string"), decoded(subday, SUBDAY_UNITS),
            F.when(n > 1, "s").otherwise(""),
        ),
    ).otherwise("")
    between = F.when(
        repeats, F.concat(F.lit(" between "), start, F.lit(" and "), end)
    ).otherwise("")
    return F.concat(base, cadence, between)


def fact_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two snapshots: keys, change, and both sides as JSON.

    `change` is added, removed or changed; NULL equals NULL.  Both have the same
    columns and one row per key, which may be NULL in part.
    """
    fields = [c for c in before.columns if c not in keys]
    pack = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in fields])
    b, a = before.withColumn("there", F.lit(True)).alias("b"), after.withColumn("there", F.lit(True)).alias("a")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    both = b.join(a, same, "full_outer")
    change = (
        F.when(F.col("b.there").isNull(), "added").when(F.col("a.there").isNull(), "removed")
        .when(~pack("b").eqNullSafe(pack("a")), "changed")
    )
    text = lambda side: F.when(F.col(f"{side}.there"), F.to_json(pack(side), {"ignoreNullFields": "false"}))
    return both.select(
        *[F.when(F.col("a.there"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys],
        change.alias("change"), text("b").alias("before"), text("a").alias("after"),
    ).filter(F.col("change").isNotNull())


def fact_job(
    jobs: DataFrame, job_steps: DataFrame, proxies: DataFrame, operators: DataFrame,
    schedules: DataFrame, job_schedules: DataFrame,
) -> DataFrame:
    """Jobs with their operators, ordered steps and described schedules."""
    steps = job_steps.join(
        proxies.select(
            KEY, "proxy_id", F.col("name").alias("proxy"), F.col("credential").alias("proxy_credential"),
            "credential_identity",
        ),
        [KEY, "proxy_id"], "left",
    ).select(
        KEY, "job_id", "step_id", "step_name", "subsystem", "database_name",
        F.when(F.col("subsystem") == "TSQL", F.col("database_user_name"))
        .otherwise(F.col("proxy")).alias("execute_as"),
        "proxy_credential", "credential_identity", F.col("command").alias("codeblock"),
    )
    described = schedules.select(
        KEY, "schedule_id", F.col("enabled").alias("schedule_enabled"),
        schedule_description().alias("schedule_desc"),
    )
    planned = (
        jobs.select(KEY, "job_id")
        .join(job_schedules, [KEY, "job_id"], "left")
        .join(described, [KEY, "schedule_id"], "left")
        .select(
            KEY, "job_id", "schedule_id", "schedule_enabled",
            F.coalesce("schedule_desc", F.lit("Unscheduled")).alias("schedule_desc"),
        )
    )
    out = jobs.select(
        KEY, "job_id", "job_name", "job_owner", F.col("enabled").alias("job_enabled"),
        clean_text(F.col("description")).alias("job_desc"),
        "notify_email_operator_id", "notify_netsend_operator_id", "notify_page_operator_id",
        F.col("date_created").alias("job_created"),
        F.when(F.col("date_created") != F.col("date_modified"), F.col("date_modified")).alias("job_modified"),
    )
    active = operators.filter("enabled")
    for channel in ("email", "netsend", "page"):
        named = active.select(
            KEY, F.col("operator_id").alias(f"notify_{channel}_operator_id"),
            F.col("name").alias(f"notify_{channel}_operator"),
        )
        out = out.join(named, [KEY, f"notify_{channel}_operator_id"], "left").drop(
            f"notify_{channel}_operator_id"
        )
    return nest(
        out, [KEY, "job_id"],
        {
            "steps": (
                steps,
                ["step_id", "step_name", "subsystem", "database_name", "execute_as", "proxy_credential",
                 "credential_identity", "codeblock"],
            ),
            "schedules": (planned, ["schedule_id", "schedule_enabled", "schedule_desc"]),
        },
    )


def fact_replica_group(
    groups: DataFrame, replicas: DataFrame, listeners: DataFrame, listener_ips: DataFrame,
    group_databases: DataFrame, policy_replica_group: DataFrame,
) -> DataFrame:
    """Groups with their databases, replicas and listener addresses."""
    preferred = replicas.join(
        policy_replica_group.select(KEY, "ag_id", F.col("ag_role").alias("preferred_role")), [KEY, "ag_id"]
    )
    addresses = listener_ips.join(listeners.select(KEY, "ag_id", "listener_id"), [KEY, "listener_id"])
    quoted = group_databases.select(KEY, "ag_id", quote_name(F.col("database_name")).alias("database"))
    parent = groups.join(
        listeners.select(
            KEY, "ag_id", F.col("dns_name").alias("listener_dns"), F.col("port").alias("listener_port")
        ),
        [KEY, "ag_id"], "left",
    )
    return nest(
        parent, [KEY, "ag_id"],
        {
            "ag_databases": (quoted, ["database"]),
            "availability_replicas": (
                preferred, ["replica_server_name", "preferred_role", "endpoint_url", "availability_mode_desc"],
            ),
            "listener_ip_addresses": (addresses, ["ip_address", "ip_subnet_mask"]),
        },
    )


def fact_database(databases: DataFrame) -> DataFrame:
    """All properties; ids dropped, codes replaced by their descriptions."""
    columns = [c for c in databases.columns if c != KEY]
    kept = [
        c for c in columns
        if not c.lower().endswith("_id") and not c.lower().startswith("log_reuse_wait")
    ]
    chosen = [F.col(KEY)]
    for c in kept:
        if f"{c}_desc" in kept:
            continue
        name = "owner" if c == "owner_sid" else c.removesuffix("_desc")
        chosen.append(F.col(c).alias(name))
    return databases.select(*chosen)


def fact_database_file(db_files: DataFrame, databases: DataFrame) -> DataFrame:
    """Files with size, limit and growth as text."""
    def megabytes(pages: str) -> Column:
        return F.concat(pages_to_mb(F.col(pages)).cast("string"), F.lit("MB"))

    return db_files.join(
        databases.select(KEY, "database_id", F.col("name").alias("database_name")), [KEY, "database_id"]
    ).select(
        KEY, "database_name", F.col("name").alias("file_name"), F.col("file_type").alias("type_desc"),
        "physical_name", pages_to_mb(F.col("size_pages")).alias("allocated_size_mb"),
        F.when(F.col("max_size_pages") < 0, "Unlimited")
        .when((F.col("max_size_pages") == 0) | (F.col("growth") == 0), "No Growth Allowed")
        .otherwise(megabytes("max_size_pages")).alias("max_size_mb"),
        F.when(
            F.col("growth") != 0,
            F.when(F.col("is_percent_growth"), F.concat(F.col("growth").cast("string"), F.lit("%")))
            .otherwise(megabytes("growth")),
        ).alias("auto_grow"),
    )


def fact_mail(
    profiles: DataFrame, profile_accounts: DataFrame, accounts: DataFrame, principals: DataFrame
) -> DataFrame:
    """Mail profiles with their principals and accounts in failover order."""
    used = profile_accounts.join(accounts, [KEY, "account_id"])
    return nest(
        profiles, [KEY, "profile_id"],
        {
            "principals": (principals, ["principal_name", "is_default"]),
            "accounts": (used, ["sequence_number", "account_id", "name", "email_address", "port"]),
        },
    )


def fact_parameters(parameters: DataFrame, policies: Mapping[str, tuple[DataFrame, list[str]]],
                    names: list[str]) -> DataFrame:
    """Parameters as one row per instance with the policy tables nested."""
    row = parameters.groupBy(KEY).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n.lower()) for n in names]
    )
    return nest(row, [KEY], policies)


def fact_instance_options(instance_options: DataFrame) -> DataFrame:
    return instance_options.select(KEY, "name", "value_in_use")


def fact_logshipping_primary(logship_primary: DataFrame) -> DataFrame:
    return logship_primary.select(
        KEY, "primary_id", "primary_server", "primary_database", "backup_threshold", "threshold_alert",
        "threshold_alert_enabled", "history_retention_period",
    )


def fact_logshipping_secondary(logship_secondary: DataFrame, secondary_config: DataFrame) -> DataFrame:
    """Secondaries of this server with their restore settings nested."""
    parent = logship_secondary.join(
        secondary_config.select(KEY, "secondary_id", "backup_source_directory"), [KEY, "secondary_id"], "left"
    ).select(
        KEY, "secondary_id", "secondary_server", "secondary_database", "primary_server", "primary_database",
        "restore_threshold", "threshold_alert", "threshold_alert_enabled", "history_retention_period",
        "backup_source_directory",
    )
    return nest(
        parent, [KEY, "secondary_id"],
        {"database_config": (secondary_config, ["restore_delay", "restore_all", "restore_mode", "disconnect_users"])},
    )


def fact_maintenance_plan(plans: DataFrame, subplans: DataFrame, jobs: DataFrame) -> DataFrame:
    return (
        plans.select(
            KEY, "plan_id", "plan_name", clean_text(F.col("description")).alias("plan_description"),
            "owner", "create_date",
        )
        .join(
            subplans.select(
                KEY, "plan_id", "subplan_name", clean_text(F.col("description")).alias("subplan_description"),
                "job_id",
            ),
            [KEY, "plan_id"],
        )
        .join(jobs.select(KEY, "job_id", "job_name"), [KEY, "job_id"])
        .drop("plan_id")
    )


def fact_mirroring(mirror_state: DataFrame) -> DataFrame:
    return mirror_state.filter(F.col("mirroring_guid").isNotNull()).select(
        KEY, "database_name", "mirroring_role_desc", "mirroring_safety_level_desc",
        "mirroring_partner_instance", "mirroring_partner_name", "mirroring_witness_name",
    )


#: Publication settings given as they are; passwords aren't collected.
PUBLICATION_SETTINGS = (
    "enabled_for_internet", "immediate_sync_ready", "allow_queued_tran", "allow_sync_tran", "autogen_sync_procs",
    "snapshot_in_defaultfolder", "alt_snapshot_folder", "pre_snapshot_script", "post_snapshot_script", "compress_snapshot",
    "ftp_address", "ftp_port", "ftp_subdirectory", "ftp_login", "allow_dts", "allow_anonymous", "centralized_conflicts",
    "conflict_retention", "backward_comp_level", "independent_agent", "immediate_sync", "allow_push", "allow_pull",
    "retention", "allow_subscription_copy", "allow_initialize_from_backup", "replicate_ddl",
)
ARTICLE_SETTINGS = (
    "dest_owner", "dest_object_name", "filter_clause", "ins_cmd", "upd_cmd", "del_cmd", "ins_scripting_proc",
    "upd_scripting_proc", "del_scripting_proc", "custom_script", "fire_triggers_on_snapshot",
)


def fact_replication_publisher(
    publications: DataFrame, articles: DataFrame, subscriptions: DataFrame
) -> DataFrame:
    """Publications with their settings, decoded codes, articles and distinct subscribers."""
    shipped = articles.select(
        KEY, "publication_id", "name", "article_type",
        decoded(F.col("pre_creation_cmd"), PRE_CREATION).alias("pre_creation_cmd"), *ARTICLE_SETTINGS,
    )
    subscribers = subscriptions.filter(F.col("srvid") >= 0).select(
        KEY, "publication_id", F.col("srvname").alias("dest_server"), "dest_db", "login_name",
        decoded(F.col("subscription_type"), SUBSCRIPTION_TYPE).alias("subscription_type"),
    ).distinct()
    parent = publications.select(
        KEY, "publication_id", "publication_db", "publication_name", "description",
        decoded(F.col("repl_freq"), REPLICATION_FREQUENCY).alias("repl_freq"),
        decoded(F.col("sync_method"), SYNC_METHOD).alias("sync_method"),
        decoded(F.col("conflict_policy"), CONFLICT_POLICY).alias("conflict_policy"), *PUBLICATION_SETTINGS,
    )
    return nest(
        parent, [KEY, "publication_id"],
        {
            "articles": (shipped, ["name", "article_type", "pre_creation_cmd", *ARTICLE_SETTINGS]),
            "subscribers": (subscribers, ["dest_server", "dest_db", "login_name", "subscription_type"]),
        },
    )


def fact_replication_subscriber(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.select(KEY, "publisher", "publisher_db", "subscriber_db", "publication")


def fact_resource_governor(config: DataFrame, pools: DataFrame, groups: DataFrame) -> DataFrame:
    """One document per instance: switch, classifier, pools and workload groups."""
    return nest(
        config, [KEY],
        {
            "resource_pools": (pools, ["pool_id", "name", "max_cpu_percent"]),
            "workload_groups": (groups, ["group_id", "name", "importance"]),
        },
    )


def role_membership_closure(principals: DataFrame, role_members: DataFrame) -> DataFrame:
    """Every role a user reaches, directly or through nested roles, and by how many steps at least.

    Roles are closed over roles first, once for all users; the users' own roles
    are joined to that.  Users without any role keep one row with a NULL role.
    `principals` has (principal_id, type), where type R marks roles.
    """
    roles = principals.filter(F.col("type") == "R").select(KEY, F.col("principal_id").alias("source"))
    users = principals.filter(F.col("type") != "R").select(KEY, F.col("principal_id").alias("source"))
    edges = role_members.select(KEY, F.col("member_id").alias("source"), F.col("role_id").alias("target"))
    between = edges.join(roles, [KEY, "source"], "left_semi")
    nested = closure(between, between, KEY)
    own = edges.join(users, [KEY, "source"], "left_semi").distinct()
    further = own.withColumnRenamed("target", "via").join(
        nested.select(KEY, F.col("source").alias("via"), "target", (F.col("depth") + 1).alias("depth")), [KEY, "via"]
    ).drop("via")
    reached = own.withColumn("depth", F.lit(1)).unionByName(further)
    reached = reached.groupBy(KEY, "source", "target").agg(F.min("depth").alias("depth"))
    return users.join(reached, [KEY, "source"], "left").select(
        KEY, F.col("source").alias("user_id"), F.col("target").alias("role_id"), "depth"
    )


SQL_LOGIN_PROPERTIES = (
    "is_policy_checked", "is_expiration_checked", "is_locked", "lockout_time", "is_expired", "is_must_change",
    "password_last_set_time", "bad_password_count",
)


def fact_security(
    principals: DataFrame, server_role_members: DataFrame, permissions: DataFrame,
    group_members: DataFrame, database_principals: DataFrame, database_role_members: DataFrame,
) -> DataFrame:
    """Logins with roles, permissions, members and database roles.

    Database users whose login is gone appear as `DB_ORPHANED`.  A user's database
    roles are those of `database_principals` and all that these are members of,
    directly or through others: `database_role_members` has (database_name, member_role,
    role_name), and roles are closed within each database once, for all users.
    """
    logins = principals.filter(F.col("type_desc") != "SERVER_ROLE")
    in_databases = database_principals.select(KEY, "sid").distinct().withColumn("in_database", F.lit(True))
    parent = logins.join(in_databases, [KEY, "sid"], "full_outer").select(
        KEY,
        F.coalesce(
            F.concat(F.lit("login:"), F.col("principal_id").cast("string")), F.concat(F.lit("sid:"), F.col("sid"))
        ).alias("entry"),
        F.col("name").alias("login_name"),
        F.coalesce("type_desc", F.lit("DB_ORPHANED")).alias("login_type"),
        "is_disabled",
        F.when(
            F.col("type_desc").isin("WINDOWS_LOGIN", "WINDOWS_GROUP"), F.col("is_invalid").cast("int")
        ).alias("is_ad_orphaned"),
        *[F.when(F.col("type_desc") == "SQL_LOGIN", F.col(c)).alias(c) for c in SQL_LOGIN_PROPERTIES],
    )
    by_id = F.concat(F.lit("login:"), F.col("principal_id").cast("string")).alias("entry")
    granted = F.concat(
        F.col("state_desc"), F.lit(" "), F.col("permission_name"),
        F.when(
            F.col("permission_name") == "IMPERSONATE", F.concat(F.lit(" "), quote_name(F.col("grantor")))
        ).otherwise(""),
    )
    known_sids = logins.filter(F.col("sid").isNotNull()).select(KEY, "sid", "principal_id")
    at = [KEY, "database_name"]
    nested = reachable(
        database_role_members.select(*at, F.col("member_role").alias("source"), F.col("role_name").alias("target")), at
    )
    further = database_principals.withColumnRenamed("role_name", "source").join(nested, [*at, "source"]).drop("source")
    held = database_principals.unionByName(further.withColumnRenamed("target", "role_name")).distinct()
    database_roles = held.join(known_sids, [KEY, "sid"], "left").select(
        KEY,
        F.coalesce(
            F.concat(F.lit("login:"), F.col("principal_id").cast("string")), F.concat(F.lit("sid:"), F.col("sid"))
        ).alias("entry"),
        "database_name", "user_name", "role_name",
    )
    return nest(
        parent, [KEY, "entry"],
        {
            "group_members": (group_members.select(KEY, by_id, "account_name"), ["account_name"]),
            "server_roles": (server_role_members.select(KEY, by_id, "role_name"), ["role_name"]),
            "server_permissions": (permissions.select(KEY, by_id, granted.alias("grant")).distinct(), ["grant"]),
            "database_roles": (database_roles, ["database_name", "user_name", "role_name"]),
        },
    )


def fact_server_object(
    servers: DataFrame, linked_logins: DataFrame, logins: DataFrame, triggers: DataFrame
) -> DataFrame:
    """Linked servers with their login mappings, and server triggers."""
    remote = F.coalesce(F.trim("remote_name"), F.lit(""))
    default = linked_logins.filter(F.col("local_principal_id") == 0).select(
        KEY, "server_id",
        F.when(~F.col("uses_self_credential") & (remote == ""), "Be made without using a security context")
        .when(F.col("uses_self_credential") & (remote == ""), "Be made using the logins current security context")
        .when(~F.col("uses_self_credential"), "Be made using remote security context")
        .otherwise("Not be made").alias("undefined_login_mapping"),
        F.col("remote_name").alias("remote_security_context"),
    )
    mapped = (
        linked_logins.filter(F.col("local_principal_id") != 0)
        .join(
            logins.select(
                KEY, F.col("principal_id").alias("local_principal_id"), F.col("name").alias("local_login")
            ),
            [KEY, "local_principal_id"], "left",
        )
        .select(
            KEY, "server_id", "local_principal_id", "local_login",
            F.col("uses_self_credential").alias("impersonate"), F.col("remote_name").alias("remote_login"),
        )
    )
    linked = nest(
        servers.filter("is_linked").join(default, [KEY, "server_id"], "left"), [KEY, "server_id"],
        {"login_mapping": (mapped, ["local_principal_id", "local_login", "impersonate", "remote_login"])},
    ).select(
        KEY, F.lit("LinkedServer").alias("type"), "server_id", "name", "product", "provider", "data_source",
        F.when(F.col("kind").isNull(), F.coalesce("undefined_login_mapping", F.lit("Not be made")))
        .alias("undefined_login_mapping"),
        "remote_security_context", "kind", "item",
    )
    fired = triggers.select(
        KEY, F.lit("ServerTrigger").alias("type"), "name", "is_disabled",
        F.coalesce("definition", F.lit("Encrypted")).alias("definition"),
    )
    return linked.unionByName(fired, allowMissingColumns=True)


def fact_service(
    instance_properties: DataFrame, service_eav: DataFrame, flags: DataFrame, instances: DataFrame
) -> DataFrame:
    """Inventory without its noise, and a row per enabled global trace flag, or one without a value."""
    columns = [KEY, "hierarchy", "property", "value"]
    inventory = instance_properties.select(*columns).unionByName(service_eav.select(*columns))
    active = flags.filter(F.col("is_global") & F.col("enabled")).withColumn("flag", F.col("flag").cast("string"))
    texts = active.select(KEY, F.col("flag").alias("value")).distinct()
    service = F.when(F.col("instance_name").isNull(), "MSSQLSERVER").otherwise(
        F.concat(F.lit("MSSQL$"), F.col("instance_name"))
    )
    traced = instances.join(texts, KEY, "left").select(
        KEY, F.concat(F.lit("SqlServiceInstanceProperty/"), service).alias("hierarchy"),
        F.lit("TraceFlags").alias("property"), "value",
    )
    return inventory.filter(~F.col("property").isin(*NOISE)).unionByName(traced)
