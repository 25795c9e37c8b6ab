"""Statements for configuration facts."""

from .common import clean, quoted, sql, ts


def children(name: str, table: str, keys: str, fields: str, where: str = "") -> str:
    """CTE `name`: (keys, item), `fields` as JSON, per row."""
    pack = ", ".join(f"'{f}': {f}" for f in fields.split(", "))
    return f""", {name} AS (SELECT {keys}, CAST(to_json({{{pack}}}) AS VARCHAR) AS item FROM {table} {where})"""


def of_kind(parent: str, keys: str, **kinds: str) -> str:
    """Rows of the children that have a parent, below the parent's."""
    return "".join(
        f" UNION ALL BY NAME SELECT c.*, '{kind}' AS kind FROM {name} c SEMI JOIN {parent} USING ({keys})" for kind, name in kinds.items()
    )


OWN = "CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS item"


CLOCK = "strftime(make_timestamp(2000, 1, 1, {0} // 10000, {0} % 10000 // 100, 0.0), '%-I:%M %p')"
SCHEDULE = f"""CASE WHEN freq_type = 1 THEN 'Once on ' || substr(CAST(active_start_date AS VARCHAR), 1, 4) || '.' || substr(CAST(active_start_date AS VARCHAR), 5, 2) || '.' || substr(CAST(active_start_date AS VARCHAR), 7, 2)
  WHEN freq_type = 4 THEN 'Daily'
  WHEN freq_type = 8 THEN CASE WHEN freq_recurrence_factor = 1 THEN 'Weekly on ' ELSE 'Every ' || freq_recurrence_factor || ' weeks on ' END
    || array_to_string(list_filter(['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'], lambda d, n: (freq_interval & (1 << CAST(n - 1 AS INT))) <> 0), ', ')
  WHEN freq_type = 16 THEN CASE WHEN freq_recurrence_factor = 1 THEN 'Monthly on the ' ELSE 'Every ' || freq_recurrence_factor || ' months on the ' END || freq_interval
    || CASE WHEN freq_interval IN (1, 21, 31) THEN 'st' WHEN freq_interval IN (2, 22) THEN 'nd' WHEN freq_interval IN (3, 23) THEN 'rd' ELSE 'th' END
  WHEN freq_type = 32 THEN CASE WHEN freq_recurrence_factor = 1 THEN 'Monthly on the ' ELSE 'Every ' || freq_recurrence_factor || ' months on the ' END
    || CASE freq_relative_interval WHEN 1 THEN 'first ' WHEN 2 THEN 'second ' WHEN 4 THEN 'third ' WHEN 8 THEN 'fourth ' WHEN 16 THEN 'last ' END
    || CASE freq_interval WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday' WHEN 4 THEN 'Wednesday' WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday' WHEN 7 THEN 'Saturday' WHEN 8 THEN 'day' WHEN 9 THEN 'week day' WHEN 10 THEN 'weekend day' END
  WHEN freq_type = 64 THEN 'Automatically starts when SQLServerAgent starts.' WHEN freq_type = 128 THEN 'Starts whenever the CPUs become idle' ELSE '' END
  || CASE WHEN freq_subday_type = 1 OR freq_type = 1 THEN ' at ' || {CLOCK.format('active_start_time')}
       WHEN freq_subday_type IN (2, 4, 8) THEN ' every ' || freq_subday_interval || CASE freq_subday_type WHEN 2 THEN ' second' WHEN 4 THEN ' minute' ELSE ' hour' END || CASE WHEN freq_subday_interval > 1 THEN 's' ELSE '' END ELSE '' END
  || CASE WHEN freq_subday_type IN (2, 4, 8) THEN ' between ' || {CLOCK.format('active_start_time')} || ' and ' || {CLOCK.format('active_end_time')} ELSE '' END"""

sql("schedule_description", "schedules", f" SELECT instance_guid, schedule_id, {SCHEDULE} AS schedule_desc FROM schedules")

sql("fact_job", "jobs job_steps proxies operators schedules job_schedules", f"""
, st AS (SELECT s.instance_guid, s.job_id, step_id, step_name, subsystem, database_name, CASE WHEN subsystem = 'TSQL' THEN database_user_name ELSE p.name END AS execute_as,
    p.credential AS proxy_credential, p.credential_identity, command AS codeblock FROM job_steps s LEFT JOIN proxies p USING (instance_guid, proxy_id)),
sc AS (SELECT j.instance_guid, j.job_id, js.schedule_id, s.enabled AS schedule_enabled, CASE WHEN s.schedule_id IS NULL THEN 'Unscheduled' ELSE {SCHEDULE} END AS schedule_desc
  FROM jobs j LEFT JOIN job_schedules js USING (instance_guid, job_id) LEFT JOIN schedules s ON s.instance_guid = j.instance_guid AND s.schedule_id = js.schedule_id)"""
    + children("a", "st", "instance_guid, job_id", "step_id, step_name, subsystem, database_name, execute_as, proxy_credential, credential_identity, codeblock")
    + children("b", "sc", "instance_guid, job_id", "schedule_id, schedule_enabled, schedule_desc") + f"""
SELECT j.instance_guid, j.job_id, job_name, job_owner, enabled AS job_enabled, {clean('description')} AS job_desc, {ts('date_created')} AS job_created,
  {ts("CASE WHEN date_created <> date_modified THEN date_modified END")} AS job_modified, e.name AS notify_email_operator, n.name AS notify_netsend_operator, g.name AS notify_page_operator,
  {OWN}
FROM jobs j
  LEFT JOIN (SELECT * FROM operators WHERE enabled) e ON e.instance_guid = j.instance_guid AND e.operator_id = j.notify_email_operator_id
  LEFT JOIN (SELECT * FROM operators WHERE enabled) n ON n.instance_guid = j.instance_guid AND n.operator_id = j.notify_netsend_operator_id
  LEFT JOIN (SELECT * FROM operators WHERE enabled) g ON g.instance_guid = j.instance_guid AND g.operator_id = j.notify_page_operator_id""".replace("SELECT j.instance_guid, j.job_id, job_name, job_owner, enabled", "SELECT j.instance_guid, j.job_id, job_name, job_owner, j.enabled")
    + of_kind("jobs", "instance_guid, job_id", steps="a", schedules="b"))

sql("fact_replica_group", "ag_groups ag_replicas ag_listeners ag_listener_ips group_databases policy_replica_group", """
, r0 AS (SELECT r.*, p.ag_role AS preferred_role FROM ag_replicas r JOIN policy_replica_group p USING (instance_guid, ag_id)),
i0 AS (SELECT i.*, l.ag_id FROM ag_listener_ips i JOIN ag_listeners l USING (instance_guid, listener_id)),
d0 AS (SELECT instance_guid, ag_id, '[' || replace(database_name, ']', ']]') || ']' AS database FROM group_databases)"""
    + children("d", "d0", "instance_guid, ag_id", "database")
    + children("r", "r0", "instance_guid, ag_id", "replica_server_name, preferred_role, endpoint_url, availability_mode_desc")
    + children("i", "i0", "instance_guid, ag_id", "ip_address, ip_subnet_mask") + f"""
SELECT g.*, l.dns_name AS listener_dns, l.port AS listener_port, {OWN}
FROM ag_groups g LEFT JOIN ag_listeners l USING (instance_guid, ag_id)"""
    + of_kind("ag_groups", "instance_guid, ag_id", ag_databases="d", availability_replicas="r", listener_ip_addresses="i"))

sql("fact_database", "databases", f"""
SELECT instance_guid, name, state_desc AS state, {ts('create_date')} AS create_date, is_read_only, is_in_standby, recovery_model_desc AS recovery_model, collation_name, compatibility_level, owner FROM databases""")


def dec_text(pages: str) -> str:
    return f"CAST(CAST(floor(CAST({pages} AS DOUBLE) / 128 * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(CAST({pages} AS DOUBLE) / 128 * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0') || 'MB'"


sql("fact_database_file", "db_files databases", f"""
SELECT f.instance_guid, d.name AS database_name, f.name AS file_name, file_type AS type_desc, physical_name, floor(CAST(size_pages AS DOUBLE) / 128 * 100 + 0.5) / 100 AS allocated_size_mb,
  CASE WHEN max_size_pages < 0 THEN 'Unlimited' WHEN max_size_pages = 0 OR growth = 0 THEN 'No Growth Allowed' ELSE {dec_text('max_size_pages')} END AS max_size_mb,
  CASE WHEN growth = 0 THEN NULL WHEN is_percent_growth THEN growth || '%' ELSE {dec_text('growth')} END AS auto_grow
FROM db_files f JOIN databases d USING (instance_guid, database_id)""")

sql("fact_mail", "mail_profiles mail_profile_accounts mail_accounts mail_principals",
    ", u AS (SELECT * FROM mail_profile_accounts JOIN mail_accounts USING (instance_guid, account_id))"
    + children("p", "mail_principals", "instance_guid, profile_id", "principal_name, is_default")
    + children("a", "u", "instance_guid, profile_id", "sequence_number, account_id, name, email_address, port")
    + f" SELECT instance_guid, profile_id, profile_name, {OWN} FROM mail_profiles"
    + of_kind("mail_profiles", "instance_guid, profile_id", principals="p", accounts="a"))

sql("fact_parameters", "parameters policy_database policy_job policy_replica_group",
    children("d", "policy_database", "instance_guid", "database_id, db_name, is_enabled")
    + children("j", "policy_job", "instance_guid", "job_id, job_name, max_exec_time_min")
    + children("g", "policy_replica_group", "instance_guid", "ag_id, ag_name, ag_role") + f"""
, p AS (SELECT instance_guid, max(CASE WHEN name = 'DEFAULT_BACKUP_FREQ' THEN value END) AS default_backup_freq, max(CASE WHEN name = 'DEFAULT_DB_STATE' THEN value END) AS default_db_state,
  max(CASE WHEN name = 'SANITIZE_DATASET' THEN value END) AS sanitize_dataset, max(CASE WHEN name = 'TENANT_NAME' THEN value END) AS tenant_name FROM parameters GROUP BY 1)
SELECT p.*, {OWN} FROM p""" + of_kind("p", "instance_guid", config_database="d", config_job="j", config_replica_group="g"))

sql("fact_instance_options", "instance_options", " SELECT instance_guid, name, value_in_use FROM instance_options")
sql("fact_logshipping_primary", "logship_primary", " SELECT * EXCLUDE (last_backup_date_utc) FROM logship_primary")
sql("fact_logshipping_secondary", "logship_secondary secondary_config",
    children("c", "secondary_config", "instance_guid, secondary_id", "restore_delay, restore_all, restore_mode, disconnect_users") + f"""
SELECT l.* EXCLUDE (last_restored_date_utc), s.backup_source_directory, {OWN}
FROM logship_secondary l LEFT JOIN secondary_config s USING (instance_guid, secondary_id)"""
    + of_kind("logship_secondary", "instance_guid, secondary_id", database_config="c"))

sql("fact_maintenance_plan", "plans subplans jobs", f"""
SELECT p.instance_guid, p.plan_name, {clean('p.description')} AS plan_description, p.owner, {ts('p.create_date')} AS create_date, s.subplan_name, {clean('s.description')} AS subplan_description, j.job_id, j.job_name
FROM plans p JOIN subplans s USING (instance_guid, plan_id) JOIN jobs j ON j.instance_guid = p.instance_guid AND j.job_id = s.job_id""")

sql("fact_mirroring", "mirror_state", """
SELECT instance_guid, database_name, mirroring_role_desc, mirroring_safety_level_desc, mirroring_partner_instance, mirroring_partner_name, mirroring_witness_name FROM mirror_state WHERE mirroring_guid IS NOT NULL""")

sql("fact_replication_publisher", "publications articles subscriptions", """
, a0 AS (SELECT instance_guid, publication_id, name, article_type, CASE pre_creation_cmd WHEN 0 THEN 'None' WHEN 1 THEN 'Drop' WHEN 2 THEN 'Delete' WHEN 3 THEN 'Truncate' END AS pre_creation_cmd,
  dest_owner, dest_object_name, filter_clause, ins_cmd, upd_cmd, del_cmd, ins_scripting_proc, upd_scripting_proc, del_scripting_proc, custom_script, fire_triggers_on_snapshot FROM articles),
s0 AS (SELECT DISTINCT instance_guid, publication_id, srvname AS dest_server, dest_db, login_name, CASE subscription_type WHEN 0 THEN 'Push' WHEN 1 THEN 'Pull' END AS subscription_type FROM subscriptions WHERE srvid >= 0)"""
    + children("a", "a0", "instance_guid, publication_id", "name, article_type, pre_creation_cmd, dest_owner, dest_object_name, filter_clause, ins_cmd, upd_cmd, del_cmd, ins_scripting_proc, upd_scripting_proc, del_scripting_proc, custom_script, fire_triggers_on_snapshot")
    + children("s", "s0", "instance_guid, publication_id", "dest_server, dest_db, login_name, subscription_type") + f"""
SELECT p.instance_guid, p.publication_id, publication_db, publication_name, description, CASE repl_freq WHEN 0 THEN 'Transactional' WHEN 1 THEN 'Snapshot' END AS repl_freq,
  CASE sync_method WHEN 0 THEN 'Native bulk copy program utility (BCP)' WHEN 1 THEN 'Character BCP' WHEN 3 THEN 'Concurrent, which means that native BCP is used but tables are not locked during the snapshot'
    WHEN 4 THEN 'Concurrent_c, which means that character BCP is used but tables are not locked during the snapshot' END AS sync_method,
  CASE conflict_policy WHEN 1 THEN 'Publisher wins the conflict' WHEN 2 THEN 'Subscriber wins the conflict' WHEN 3 THEN 'Subscription is reinitialized' END AS conflict_policy,
  enabled_for_internet, immediate_sync_ready, allow_queued_tran, allow_sync_tran, autogen_sync_procs, snapshot_in_defaultfolder, alt_snapshot_folder, pre_snapshot_script, post_snapshot_script, compress_snapshot, ftp_address, ftp_port, ftp_subdirectory, ftp_login, allow_dts, allow_anonymous, centralized_conflicts, conflict_retention, backward_comp_level, independent_agent, immediate_sync, allow_push, allow_pull, retention, allow_subscription_copy, allow_initialize_from_backup, replicate_ddl, {OWN}
FROM publications p""" + of_kind("publications", "instance_guid, publication_id", articles="a", subscribers="s"))
sql("fact_replication_subscriber", "replication_subscriptions", " SELECT * FROM replication_subscriptions")

sql("fact_resource_governor", "governor_config resource_pools workload_groups",
    children("p", "resource_pools", "instance_guid", "pool_id, name, max_cpu_percent")
    + children("g", "workload_groups", "instance_guid", "group_id, name, importance")
    + f" SELECT *, {OWN} FROM governor_config" + of_kind("governor_config", "instance_guid", resource_pools="p", workload_groups="g"))

sql("fact_security", "principals server_role_members permissions group_members database_principals database_role_members", f"""
, RECURSIVE_MARK up AS (SELECT instance_guid, database_name, sid, user_name, role_name FROM database_principals
  UNION SELECT u.instance_guid, u.database_name, u.sid, u.user_name, m.role_name FROM up u JOIN database_role_members m ON m.instance_guid = u.instance_guid AND m.database_name = u.database_name AND m.member_role = u.role_name)
, l AS (SELECT * FROM principals WHERE type_desc <> 'SERVER_ROLE'),
gm AS (SELECT instance_guid, 'login:' || principal_id AS entry, account_name FROM group_members),
dr AS (SELECT d.instance_guid, coalesce('login:' || l.principal_id, 'sid:' || d.sid) AS entry, database_name, user_name, role_name FROM up d LEFT JOIN l ON l.instance_guid = d.instance_guid AND l.sid = d.sid),
par AS (SELECT coalesce(l.instance_guid, d.instance_guid) AS instance_guid, coalesce('login:' || l.principal_id, 'sid:' || d.sid) AS entry, l.* EXCLUDE (instance_guid)
  FROM l FULL JOIN (SELECT DISTINCT instance_guid, sid FROM database_principals) d ON d.instance_guid = l.instance_guid AND d.sid = l.sid),
ro0 AS (SELECT instance_guid, 'login:' || principal_id AS entry, role_name FROM server_role_members),
pe0 AS (SELECT DISTINCT instance_guid, 'login:' || principal_id AS entry, state_desc || ' ' || permission_name || CASE WHEN permission_name = 'IMPERSONATE' THEN ' ' || {quoted('grantor')} ELSE '' END AS "grant" FROM permissions)"""
    + children("g", "gm", "instance_guid, entry", "account_name") + children("d", "dr", "instance_guid, entry", "database_name, user_name, role_name")
    + children("ro", "ro0", "instance_guid, entry", "role_name") + children("pe", "pe0", "instance_guid, entry", "grant").replace("'grant': grant", "'grant': \"grant\"") + f"""
SELECT p.instance_guid, p.entry, p.name AS login_name, coalesce(type_desc, 'DB_ORPHANED') AS login_type, is_disabled,
  CASE WHEN type_desc IN ('WINDOWS_LOGIN','WINDOWS_GROUP') THEN CAST(is_invalid AS INT) END AS is_ad_orphaned, CASE WHEN type_desc = 'SQL_LOGIN' THEN is_policy_checked END AS is_policy_checked,
  CASE WHEN type_desc = 'SQL_LOGIN' THEN is_expiration_checked END AS is_expiration_checked, CASE WHEN type_desc = 'SQL_LOGIN' THEN is_locked END AS is_locked,
  {ts("CASE WHEN type_desc = 'SQL_LOGIN' THEN lockout_time END")} AS lockout_time, CASE WHEN type_desc = 'SQL_LOGIN' THEN is_expired END AS is_expired,
  CASE WHEN type_desc = 'SQL_LOGIN' THEN is_must_change END AS is_must_change, {ts("CASE WHEN type_desc = 'SQL_LOGIN' THEN password_last_set_time END")} AS password_last_set_time,
  CASE WHEN type_desc = 'SQL_LOGIN' THEN bad_password_count END AS bad_password_count, {OWN}
FROM par p""" + of_kind("par", "instance_guid, entry", group_members="g", server_roles="ro", server_permissions="pe", database_roles="d"))

sql("role_membership_closure", "role_principals role_members", """
, RECURSIVE_MARK walk AS (SELECT u.instance_guid, u.principal_id AS user_id, m.role_id, 1 AS depth, [m.role_id] AS path FROM role_principals u JOIN role_members m ON m.instance_guid = u.instance_guid AND m.member_id = u.principal_id WHERE u.type <> 'R'
  UNION SELECT w.instance_guid, w.user_id, m.role_id, w.depth + 1, list_append(w.path, m.role_id) FROM walk w JOIN role_principals r ON r.instance_guid = w.instance_guid AND r.principal_id = w.role_id AND r.type = 'R'
    JOIN role_members m ON m.instance_guid = w.instance_guid AND m.member_id = w.role_id WHERE NOT list_contains(w.path, m.role_id))
SELECT u.instance_guid, u.principal_id AS user_id, w.role_id, min(w.depth) AS depth FROM role_principals u LEFT JOIN walk w ON w.instance_guid = u.instance_guid AND w.user_id = u.principal_id
WHERE u.type <> 'R' GROUP BY 1, 2, 3""")

sql("fact_server_object", "linked_servers linked_logins principals server_triggers", """
, m0 AS (SELECT l.instance_guid, l.server_id, l.local_principal_id, p.name AS local_login, uses_self_credential AS impersonate, remote_name AS remote_login
   FROM linked_logins l LEFT JOIN principals p ON p.instance_guid = l.instance_guid AND p.principal_id = l.local_principal_id WHERE l.local_principal_id <> 0)"""
    + children("m", "m0", "instance_guid, server_id", "local_principal_id, local_login, impersonate, remote_login") + """
SELECT s.instance_guid, 'LinkedServer' AS type, s.server_id, s.name, product, provider, data_source,
  CASE WHEN d.server_id IS NULL THEN 'Not be made' WHEN NOT uses_self_credential AND trim(coalesce(remote_name, '')) = '' THEN 'Be made without using a security context'
    WHEN uses_self_credential AND trim(coalesce(remote_name, '')) = '' THEN 'Be made using the logins current security context' WHEN NOT uses_self_credential THEN 'Be made using remote security context' ELSE 'Not be made' END AS undefined_login_mapping,
  remote_name AS remote_security_context, CAST(NULL AS BOOLEAN) AS is_disabled, CAST(NULL AS VARCHAR) AS definition, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS item
FROM linked_servers s LEFT JOIN (SELECT * FROM linked_logins WHERE local_principal_id = 0) d ON d.instance_guid = s.instance_guid AND d.server_id = s.server_id
  WHERE s.is_linked
UNION ALL BY NAME SELECT m.*, 'LinkedServer' AS type, 'login_mapping' AS kind FROM m SEMI JOIN (SELECT * FROM linked_servers WHERE is_linked) USING (instance_guid, server_id)
UNION ALL BY NAME SELECT instance_guid, 'ServerTrigger' AS type, name, is_disabled, coalesce(definition, 'Encrypted') AS definition FROM server_triggers""")

sql("fact_service", "instance_properties service_eav trace_flags instances", """
, u AS (SELECT instance_guid, hierarchy, property, value FROM instance_properties UNION ALL SELECT instance_guid, hierarchy, property, value FROM service_eav)
SELECT * FROM u WHERE property NOT IN ('ProcessID', 'SqlCharSetName', 'SqlSortOrderName', 'LicenseType', 'NumLicenses')
UNION ALL
SELECT i.instance_guid, 'SqlServiceInstanceProperty/' || coalesce('MSSQL$' || instance_name, 'MSSQLSERVER'), 'TraceFlags', CAST(t.flag AS VARCHAR)
FROM instances i LEFT JOIN (SELECT DISTINCT instance_guid, flag FROM trace_flags WHERE enabled AND is_global) t USING (instance_guid)""")

sql("fact_diff", "fact_before fact_after", """
, d AS (SELECT coalesce(a.instance_guid, b.instance_guid) AS instance_guid, coalesce(a.database_id, b.database_id) AS database_id, b.database_id IS NULL AS is_new, a.database_id IS NULL AS is_gone,
  CASE WHEN b.database_id IS NOT NULL THEN CAST(to_json({'name': b.name, 'state_desc': b.state_desc, 'collation_name': b.collation_name, 'compatibility_level': b.compatibility_level}) AS VARCHAR) END AS "before",
  CASE WHEN a.database_id IS NOT NULL THEN CAST(to_json({'name': a.name, 'state_desc': a.state_desc, 'collation_name': a.collation_name, 'compatibility_level': a.compatibility_level}) AS VARCHAR) END AS "after"
  FROM fact_before b FULL JOIN fact_after a ON a.instance_guid = b.instance_guid AND a.database_id = b.database_id)
SELECT instance_guid, database_id, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'changed' END AS "change", "before", "after"
FROM d WHERE is_new OR is_gone OR d."before" <> d."after" """)
