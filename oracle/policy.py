"""Statements for the policy operators."""

from .common import sql, ts

sql("param_resolve", "parameters", """
SELECT instance_guid,
  CAST(max(value) FILTER (WHERE name='DEFAULT_CAP_WARN_PERCENT') AS INT) AS default_cap_warn_percent,
  CAST(max(value) FILTER (WHERE name='DEFAULT_CAP_CRIT_PERCENT') AS INT) AS default_cap_crit_percent,
  CAST(max(value) FILTER (WHERE name='DEFAULT_BACKUP_FREQ') AS INT) AS default_backup_freq,
  max(value) FILTER (WHERE name='DEFAULT_BACKUP_STATE') AS default_backup_state,
  CAST(max(value) FILTER (WHERE name='DEFAULT_CHECKDB_FREQ') AS INT) AS default_checkdb_freq,
  max(value) FILTER (WHERE name='DEFAULT_CHECKDB_STATE') AS default_checkdb_state,
  max(value) FILTER (WHERE name='DEFAULT_DB_STATE') AS default_db_state,
  CAST(max(value) FILTER (WHERE name='DEFAULT_JOB_MAX_MIN') AS INT) AS default_job_max_min,
  max(value) FILTER (WHERE name='DEFAULT_JOB_STATE') AS default_job_state,
  CAST(max(value) FILTER (WHERE name='DEFAULT_JOB_ENABLED') AS BOOLEAN) AS default_job_enabled,
  max(value) FILTER (WHERE name='DEFAULT_ALWAYSON_STATE') AS default_alwayson_state,
  max(value) FILTER (WHERE name='DEFAULT_ALWAYSON_ROLE') AS default_alwayson_role,
  CAST(max(value) FILTER (WHERE name='SANITIZE_DATASET') AS BOOLEAN) AS sanitize_dataset,
  max(value) FILTER (WHERE name='TENANT_NAME') AS tenant_name
FROM parameters GROUP BY instance_guid""")

sql("policy_add_missing", "databases old_policy_database parameters mirror_state", """
SELECT * FROM old_policy_database
UNION ALL
SELECT d.instance_guid, d.database_id, d.name, 20, 10, m.mirroring_role_desc,
  CASE WHEN lower(d.name) = 'tempdb' THEN 0 ELSE
    (SELECT CAST(value AS INT) FROM parameters p WHERE p.instance_guid = d.instance_guid AND p.name = 'DEFAULT_BACKUP_FREQ') END,
  'WARNING', CASE WHEN lower(d.name) = 'tempdb' THEN 0 ELSE 170 END, 'WARNING', 'CRITICAL', TRUE
FROM databases d LEFT JOIN mirror_state m USING (instance_guid, database_id)
WHERE d.source_database_id IS NULL
  AND NOT EXISTS (SELECT 1 FROM old_policy_database o WHERE o.instance_guid = d.instance_guid AND o.database_id = d.database_id)""")

sql("policy_add_missing_jobs", "jobs old_policy_job parameters", """
SELECT * FROM old_policy_job
UNION ALL
SELECT j.instance_guid, j.job_id, j.job_name, 120, 'WARNING',
  (SELECT value = '1' FROM parameters p WHERE p.instance_guid = j.instance_guid AND p.name = 'DEFAULT_JOB_ENABLED')
FROM jobs j WHERE (j.instance_guid, j.job_id) NOT IN (SELECT (instance_guid, job_id) FROM old_policy_job)""")

sql("policy_add_missing_groups", "replica_state old_policy_group", f"""
SELECT * REPLACE ({ts('ag_role_change_datetime')} AS ag_role_change_datetime) FROM old_policy_group
UNION ALL
SELECT instance_guid, ag_id, ag_name, 'CRITICAL', TRUE, role_desc, 'WARNING', TRUE, NULL FROM replica_state r
WHERE NOT EXISTS (SELECT 1 FROM old_policy_group o WHERE o.instance_guid = r.instance_guid AND o.ag_id = r.ag_id)""")

sql("policy_refresh_names", "live_databases old_policy_database", """
SELECT p.* REPLACE (coalesce(d.name, p.db_name) AS db_name)
FROM old_policy_database p LEFT JOIN live_databases d USING (instance_guid, database_id)""")

sql("policy_backfill_role", "mirror_state old_policy_database", """
SELECT p.* REPLACE (coalesce(p.mirroring_role, m.mirroring_role_desc) AS mirroring_role)
FROM old_policy_database p LEFT JOIN mirror_state m USING (instance_guid, database_id)""")

sql("policy_prune", "live_databases policy_database", """
SELECT * FROM policy_database p WHERE EXISTS
 (SELECT 1 FROM live_databases d WHERE d.instance_guid = p.instance_guid AND d.database_id = p.database_id)""")

sql("policy_merge", "policy_counter saved_policy_counter", """
SELECT instance_guid, object_name, counter_name, instance_name, CAST(warning_threshold AS DOUBLE) AS warning_threshold,
       CAST(critical_threshold AS DOUBLE) AS critical_threshold FROM saved_policy_counter
UNION ALL
SELECT instance_guid, object_name, counter_name, instance_name, CAST(warning_threshold AS DOUBLE), CAST(critical_threshold AS DOUBLE)
FROM policy_counter t WHERE NOT EXISTS (SELECT 1 FROM saved_policy_counter s WHERE s.instance_guid = t.instance_guid
  AND s.object_name = t.object_name AND s.counter_name = t.counter_name AND s.instance_name IS NOT DISTINCT FROM t.instance_name)""")

sql("role_change_stamp", "replica_snapshots", f"""
, stepped AS (SELECT *, lag(role) OVER w AS before, row_number() OVER (PARTITION BY instance_guid, ag_id ORDER BY snapshot_ts DESC, seq DESC) AS rn
  FROM replica_snapshots WINDOW w AS (PARTITION BY instance_guid, ag_id ORDER BY snapshot_ts, seq))
SELECT instance_guid, ag_id, max(role) FILTER (WHERE rn = 1) AS ag_role,
  {ts("max(CASE WHEN before <> role THEN snapshot_ts END)")} AS ag_role_change_datetime
FROM stepped GROUP BY instance_guid, ag_id""")

sql("eav_upsert", "service_eav", f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY instance_guid, hierarchy, property ORDER BY lastseen DESC, seq DESC) AS rn FROM service_eav)
SELECT instance_guid, hierarchy, property, value, {ts('lastseen')} AS lastseen, seq FROM ranked
WHERE rn = 1 AND lastseen >= TIMESTAMP '2024-02-10' - INTERVAL 1 MONTH
  AND NOT (hierarchy ILIKE '%Win32\\_GroupUser/Local\\_Admins%' ESCAPE '\\' AND lastseen < TIMESTAMP '2024-02-10' - INTERVAL 1 MINUTE)""")

sql("retention_purge", "job_activity", f"""
SELECT instance_guid, job_id, job_name, {ts('start_execution_date')} AS start_execution_date, {ts('stop_execution_date')} AS stop_execution_date
FROM job_activity WHERE start_execution_date >= TIMESTAMP '2001-08-02' - INTERVAL 92 DAY""")

sql("retention_purge_months", "backup_history", f"""
SELECT * EXCLUDE (encryptor_type) REPLACE ({ts('backup_start_date')} AS backup_start_date, {ts('backup_finish_date')} AS backup_finish_date)
FROM backup_history WHERE backup_finish_date >= TIMESTAMP '2001-05-02'""")

sql("policy_validate", "saved_policy_counter", """
, p AS (SELECT *, object_name || '/' || counter_name || '/' || coalesce(instance_name, '%') AS object FROM saved_policy_counter)
SELECT instance_guid, object, 'alert:alert' AS rule, object_name AS detail FROM p WHERE upper(object_name) NOT IN ('OK','WARNING','CRITICAL')
UNION ALL
SELECT instance_guid, object, 'pair:warning_threshold', CAST(coalesce(warning_threshold, critical_threshold) AS VARCHAR) FROM p
WHERE (warning_threshold IS NULL) <> (critical_threshold IS NULL)
UNION ALL
SELECT instance_guid, object, 'key', CAST(count(*) AS VARCHAR) FROM p GROUP BY instance_guid, object HAVING count(*) > 1""")
