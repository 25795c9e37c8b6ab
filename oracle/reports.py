"""Statements for the daily reports."""

from .common import NOW, NOW_EV, sql, ts

sql("backup_status_report", "live_databases backup_history restore_history logship_secondary_late report_params", f"""
, b AS (SELECT instance_guid, lower(database_name) AS k, max(backup_start_date) AS started, max(database_name) AS bname FROM backup_history WHERE type = 'D' GROUP BY 1, 2),
r AS (SELECT DISTINCT instance_guid, lower(destination_database_name) AS k FROM restore_history WHERE restore_type = 'D' AND restore_date >= {NOW} - INTERVAL 30 DAY),
j AS (SELECT coalesce(d.instance_guid, b.instance_guid) AS instance_guid, coalesce(lower(d.name), b.k) AS k, d.name, d.create_date, d.state_desc, d.is_read_only, d.is_in_standby, b.started, b.bname
  FROM live_databases d FULL JOIN b ON b.instance_guid = d.instance_guid AND b.k = lower(d.name)),
q AS (SELECT j.*, r.k IS NOT NULL AS res, l.secondary_database IS NOT NULL AS shipped, CAST(f.setting AS INT) AS freq, CAST(x.setting AS INT) AS hide, o.status AS off
  FROM j LEFT JOIN r USING (instance_guid, k)
  LEFT JOIN logship_secondary_late l ON l.instance_guid = j.instance_guid AND lower(l.secondary_database) = j.k
  LEFT JOIN report_params f ON f.instance_guid = j.instance_guid AND lower(f.parametername) = j.k AND f.comments = 'Database Backup Frequency (Days)'
  LEFT JOIN report_params x ON x.instance_guid = j.instance_guid AND lower(x.parametername) = j.k AND x.comments = 'Exclude from restored database report'
  LEFT JOIN report_params o ON o.instance_guid = j.instance_guid AND lower(o.setting) = j.k AND o.parametername = 'excluded_from_Monitoring_DBName')
SELECT instance_guid, coalesce(name, bname) AS database_name, {ts('started')} AS last_full_backup,
  CASE WHEN create_date > {NOW} - INTERVAL 1 DAY THEN 'New database' WHEN res AND hide IS NULL THEN 'Restored' WHEN res AND hide = 1 THEN 'Exclude from restored database report'
    WHEN freq = 0 OR shipped OR state_desc = 'RESTORING' THEN 'Backup not required' WHEN is_read_only THEN 'Read only database' WHEN is_in_standby THEN 'Standby database'
    WHEN state_desc = 'OFFLINE' AND (off <> 1 OR off IS NULL) THEN 'IsOffline database' WHEN state_desc = 'OFFLINE' AND off = 1 THEN 'OK'
    WHEN bname IS NULL AND create_date < {NOW} - INTERVAL 1 DAY THEN 'Never backed up' WHEN name IS NULL THEN 'Deleted'
    WHEN started >= {NOW} - coalesce(freq, 1) * INTERVAL 1 DAY THEN 'OK' WHEN started < {NOW} - coalesce(freq, 1) * INTERVAL 1 DAY THEN 'Backup Due' ELSE '****' END AS status
FROM q WHERE NOT (name IS NULL AND started < {NOW} - INTERVAL 2 DAY)""")

sql("database_size_report", "databases db_files policy_database", f"""
SELECT d.instance_guid, d.name, floor(CAST(sum(size_pages) AS DOUBLE) / 128 * 100 + 0.5) / 100 AS size_mb, coalesce(owner, '~~UNKNOWN~~') AS owner, d.database_id, {ts('create_date')} AS create_date,
  'Status =' || state_desc || '| Updateability=' || CASE WHEN is_read_only THEN 'READ_ONLY' ELSE 'READ_WRITE' END || '| Recovery=' || recovery_model_desc || '| Collation=' || coalesce(collation_name, 'SQL_Latin1_General_CP1_CI_AS') AS status,
  compatibility_level
FROM databases d JOIN db_files f USING (instance_guid, database_id) JOIN policy_database p USING (instance_guid, database_id)
WHERE state_desc <> 'OFFLINE' OR p.is_enabled
GROUP BY d.instance_guid, d.name, owner, d.database_id, create_date, state_desc, is_read_only, recovery_model_desc, collation_name, compatibility_level""")

sql("error_keyword_report", "error_log instances", f"""
, e AS (SELECT *, (message ILIKE '%error%' OR message ILIKE '%failed%') AS kw,
    message ILIKE '%found 0 errors and repaired 0 errors%' OR message ILIKE '%without errors%' AS benign FROM error_log WHERE log_date BETWEEN {NOW_EV} - INTERVAL 40 DAY AND {NOW_EV}),
w AS (SELECT *, lag(kw AND NOT benign AND message ILIKE '%Error:%Severity:%State:%') OVER (PARTITION BY instance_guid ORDER BY log_date, seq) AS after_header FROM e),
s AS (SELECT instance_guid, {ts('log_date')} AS log_date, source, replace(replace(replace(message, ',', ''), chr(10), '|'), chr(13), '') AS message FROM w
  WHERE (kw AND NOT benign) OR (coalesce(after_header, false) AND NOT kw))
SELECT * FROM s UNION ALL SELECT instance_guid, {ts(NOW_EV)}, '', 'There are no error log messages' FROM instances WHERE instance_guid NOT IN (SELECT instance_guid FROM s)""")


def failures(now: str, days: int, open_end: bool = False) -> str:
    until = "" if open_end else f" AND run_at <= {now}"
    return f"""
, t AS (SELECT *, make_timestamp(run_date // 10000, run_date // 100 % 100, run_date % 100, run_time // 10000, run_time // 100 % 100, CAST(run_time % 100 AS DOUBLE)) AS run_at FROM job_history),
a AS (SELECT *, message AS msg FROM t WHERE run_status NOT IN (1, 4) AND step_id <> 0 AND run_at >= date_trunc('day', {now}) + INTERVAL 6 HOUR - INTERVAL {days} DAY{until}),
b AS (SELECT *, message AS msg FROM t WHERE run_status <> 1 AND step_id = 0 AND run_at >= date_trunc('day', {now}) + INTERVAL 6 HOUR - INTERVAL {days + 1} DAY{until}
  AND NOT EXISTS (SELECT 1 FROM a WHERE a.instance_guid = t.instance_guid AND a.job_name = t.job_name)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT instance_guid, replace(job_name, '"', '''') AS job_name, step_id, replace(step_name, '"', '''') AS step_name,
  CASE run_status WHEN 0 THEN 'Failed' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Cancelled' ELSE 'In progress' END AS status,
  strftime(run_at, '%d/%m/%Y') AS date, strftime(run_at, '%H:%M:%S') AS time, replace(replace(replace(msg, '"', ''''), chr(13), '|'), chr(10), '') AS message FROM u
UNION ALL SELECT instance_guid, '', 0, '', '', strftime({now}, '%d/%m/%Y'), strftime({now}, '%H:%M:%S'), 'There are no failed jobs' FROM instances
WHERE instance_guid NOT IN (SELECT instance_guid FROM u)"""


sql("job_failure_report", "job_history instances", failures(NOW, 3000))
sql("job_failure_report_daily", "job_history instances", failures("TIMESTAMP '2001-08-01 18:00:00'", 0, open_end=True))

sql("version_report", "instances", """
, v AS (SELECT *, tenant || ',' || machine_name || '#' || coalesce(instance_name, 'MSSQLSERVER') || ',Microsoft SQL Server ' ||
  CASE substr(product_version, 1, 4) WHEN '16.0' THEN '2022' WHEN '15.0' THEN '2019' WHEN '14.0' THEN '2017' WHEN '13.0' THEN '2016' WHEN '12.0' THEN '2014' WHEN '11.0' THEN '2012'
    WHEN '10.5' THEN '2008 R2' WHEN '10.0' THEN '2008' WHEN '9.0.' THEN '2005' WHEN '8.00' THEN '2000' ELSE 'xxxx' END || ' ' ||
  rtrim(replace(replace(replace(edition, ': Core-based Licensing', ''), 'Edition', ''), '  ', ' ')) AS e FROM instances)
SELECT instance_guid, '0 mssql_' || coalesce(instance_name, 'MSSQLSERVER') || ' - ' || CASE WHEN e LIKE '%(64-bit)' THEN replace(e, ' (64-bit)', '') ELSE e || ' 32-bit' END || ',' ||
  product_level || coalesce('-' || product_update_level, '') || coalesce('-' || product_build_type, '') || ',' || product_version AS version FROM v""")
