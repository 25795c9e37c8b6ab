"""Statements for the alert checks."""

from fleetlens.sources.adapters import duckdb_ctes

from .common import CODE, NOW, NOW_EV, ORACLE, check, quoted, sql

LABEL = "i.tenant || ',' || i.machine_name || '#' || coalesce(i.instance_name, 'MSSQLSERVER') || '#' || "

_LATEST = """, latest AS (
  SELECT instance_guid, lower(database_name) AS k, backup_finish_date AS chk_at, type,
    row_number() OVER (PARTITION BY instance_guid, lower(database_name) ORDER BY backup_finish_date DESC, type) AS rn
  FROM backup_history WHERE type IN ('D','I') AND NOT is_copy_only)"""

_BACKUP_ROWS = f"""SELECT d.instance_guid, p.db_name AS object,
    {LABEL} p.db_name || ',' || coalesce(strftime(l.chk_at, '%Y-%m-%d'), '1900-01-01') || ',' ||
      CASE l.type WHEN 'D' THEN 'FULL' WHEN 'I' THEN 'DIFFERENTIAL' ELSE 'UNKNOWN' END AS message,
    CASE WHEN l.chk_at IS NULL OR date_diff('hour', l.chk_at, {NOW}) > p.backup_frequency_hours THEN p.backup_state_alert ELSE 'OK' END AS state
  FROM databases d JOIN policy_database p USING (instance_guid, database_id) JOIN instances i USING (instance_guid)
  LEFT JOIN latest l ON l.instance_guid = d.instance_guid AND l.k = lower(d.name) AND l.rn = 1
  {{joins}}
  WHERE d.state = 0 AND NOT d.is_in_standby AND p.backup_frequency_hours > 0 AND lower(p.db_name) <> 'tempdb' AND p.is_enabled {{where}}"""


def opted(freq: str) -> str:
    return f"""SELECT instance_guid,
      count(*) FILTER (WHERE {freq} > 0 AND lower(db_name) <> 'tempdb' AND is_enabled) || ' database(s) monitored, ' ||
      count(*) FILTER (WHERE ({freq} = 0 AND lower(db_name) <> 'tempdb') OR NOT is_enabled) || ' database(s) opted-out' AS message
    FROM policy_database GROUP BY instance_guid"""


BACKUP = (_BACKUP_ROWS.format(joins="", where=""), opted("backup_frequency_hours"), _LATEST)
check("check_backup", "databases backup_history policy_database instances", *BACKUP)

check(
    "check_backup_replicated",
    "databases backup_history policy_database instances replica_state group_databases policy_replica_group",
    _BACKUP_ROWS.format(
        joins="LEFT JOIN placed g ON g.instance_guid = d.instance_guid AND g.database_id = d.database_id",
        where=f"""AND coalesce(g.automated_backup_preference, 0) = 0 AND coalesce(g.role, 1) = 1
          AND (g.ag_role_change_datetime IS NULL OR date_diff('hour', g.ag_role_change_datetime, {NOW}) > p.backup_frequency_hours)""",
    ),
    """SELECT instance_guid, w || ' database(s) monitored, ' || (k - w) || ' database(s) opted-out' AS message FROM (
      SELECT p.instance_guid, count(*) FILTER (WHERE backup_frequency_hours > 0 AND lower(db_name) <> 'tempdb' AND is_enabled
               AND coalesce(g.automated_backup_preference, 0) = 0 AND coalesce(g.role, 1) = 1) AS w,
             count(*) FILTER (WHERE lower(db_name) <> 'tempdb' OR NOT is_enabled) AS k
      FROM policy_database p LEFT JOIN placed g USING (instance_guid, database_id) GROUP BY p.instance_guid)""",
    _LATEST + """, placed AS (SELECT g.instance_guid, g.database_id, r.automated_backup_preference, r.role, c.ag_role_change_datetime
      FROM group_databases g JOIN replica_state r USING (instance_guid, ag_id) LEFT JOIN policy_replica_group c USING (instance_guid, ag_id))""",
)

INTEGRITY = (
    f"""SELECT g.instance_guid, d.name AS object,
      'database=' || {quoted('d.name')} || '; last_checkdb=' || CASE WHEN g.chk_at = TIMESTAMP '1900-01-01' THEN 'NEVER' ELSE strftime(g.chk_at, '%Y-%m-%dT%H:%M:%S') END
      || '; checkdb_missed=' || CASE WHEN g.chk_at = TIMESTAMP '1900-01-01' THEN 'ALL' ELSE CAST(date_diff('hour', g.chk_at, {NOW}) // p.checkdb_frequency_hours AS VARCHAR) END AS message,
      p.checkdb_state_alert AS state
    FROM good g JOIN policy_database p ON p.instance_guid = g.instance_guid AND lower(p.db_name) = g.k
      JOIN databases d ON d.instance_guid = g.instance_guid AND lower(d.name) = g.k
    WHERE p.checkdb_frequency_hours > 0 AND p.is_enabled AND date_diff('hour', d.create_date, {NOW}) > p.checkdb_frequency_hours
      AND date_diff('hour', g.chk_at, {NOW}) > p.checkdb_frequency_hours""",
    opted("checkdb_frequency_hours"),
    """, good AS (SELECT instance_guid, lower(database_name) AS k, max(value) AS chk_at FROM db_info
       WHERE field = 'dbi_dbccLastKnownGood' GROUP BY 1, 2)""",
)
check("check_integrity", "db_info databases policy_database", *INTEGRITY)

STATE = (
    f"""SELECT instance_guid, name AS object, {quoted('name')} || '=' || upper(state_desc) AS message, change_state_alert AS state
    FROM databases JOIN policy_database USING (instance_guid, database_id) WHERE is_enabled AND state NOT IN (0, 1, 2)""",
    """SELECT instance_guid, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) || ' online, ' || sum(CASE WHEN state = 1 THEN 1 ELSE 0 END) || ' restoring, '
       || sum(CASE WHEN state = 2 THEN 1 ELSE 0 END) || ' recovering.' AS message
    FROM databases JOIN policy_database USING (instance_guid, database_id) WHERE is_enabled GROUP BY instance_guid""",
)
check("check_database_state", "databases policy_database", *STATE)

check(
    "check_inventory", "databases policy_database instances",
    f"""SELECT d.instance_guid, d.name AS object, {LABEL} d.name AS message, 'OK' AS state
    FROM databases d JOIN policy_database p USING (instance_guid, database_id) JOIN instances i USING (instance_guid)
    WHERE lower(d.name) NOT IN ('master','model','msdb','tempdb') AND (d.state_desc <> 'OFFLINE' OR p.is_enabled)""",
    "SELECT instance_guid, 'No user databases found.' AS message FROM instances",
)


def jobs(yes: str, no: str) -> str:
    return f"""SELECT instance_guid, count(*) FILTER (WHERE {yes}) || ' job(s) monitored; ' || count(*) FILTER (WHERE {no}) || ' job(s) not monitored; ' AS message
      FROM policy_job GROUP BY instance_guid"""


JOB = (
    f"""SELECT n.instance_guid, n.job_name AS object, 'job=' || {quoted('n.job_name')} || '; state=FAIL' AS message, p.change_state_alert AS state
    FROM newest n JOIN policy_job p USING (instance_guid, job_id) WHERE rn = 1 AND run_status = 0 AND p.is_enabled""",
    jobs("is_enabled", "NOT is_enabled"),
    """, newest AS (SELECT *, row_number() OVER (PARTITION BY instance_guid, job_name ORDER BY run_date DESC, run_time DESC, instance_id DESC) AS rn FROM job_history)""",
)
check("check_job", "job_history policy_job", *JOB)

check(
    "check_job_long_running", "job_activity policy_job instances",
    f"""SELECT a.instance_guid, a.job_name AS object, 'job=' || {quoted('a.job_name')} || '; run_duration_min=' || date_diff('minute', a.start_execution_date, {NOW})
      || '; max_threshold_min=' || p.max_exec_time_min AS message, p.change_state_alert AS state
    FROM job_activity a JOIN policy_job p USING (instance_guid, job_id) JOIN instances i USING (instance_guid)
    WHERE p.is_enabled AND p.max_exec_time_min > 0 AND a.stop_execution_date IS NULL AND i.edition NOT ILIKE '%express%'
      AND date_diff('minute', a.start_execution_date, {NOW}) > p.max_exec_time_min""",
    f"""SELECT s.instance_guid, CASE WHEN edition ILIKE '%express%' THEN 'Express Edition Detected. No SQL Agent.' ELSE s.message END AS message
      FROM ({jobs("is_enabled AND max_exec_time_min > 0", "NOT is_enabled OR max_exec_time_min <= 0")}) s JOIN instances i USING (instance_guid)""",
)

_TOTALS = f""", d AS (SELECT * FROM policy_login WHERE name = '_default'), x AS (SELECT * FROM policy_login WHERE name <> '_default'),
f AS (SELECT e.instance_guid, e.event_ts, x.name, d.failed_login_threshold AS dt, d.monitoring_period_minutes AS dp, d.login_failure_alert AS da,
        x.failed_login_threshold AS xt, x.monitoring_period_minutes AS xp, x.login_failure_alert AS xa
      FROM login_events e JOIN d USING (instance_guid) LEFT JOIN x ON x.instance_guid = e.instance_guid AND lower(x.name) = lower(e.login_name)
      WHERE e.destination_code = '0x0000001c' AND coalesce(x.failed_login_threshold, d.failed_login_threshold) <> 0
        AND coalesce(x.monitoring_period_minutes, d.monitoring_period_minutes) <> 0),
totals AS (
  SELECT instance_guid, '_Total' AS name, count(*) AS n, dt AS failed_login_threshold, dp AS monitoring_period_minutes,
    CASE WHEN count(*) >= dt THEN da ELSE 'OK' END AS state
  FROM f WHERE event_ts >= {NOW_EV} - dp * INTERVAL 1 MINUTE GROUP BY instance_guid, dt, dp, da
  UNION ALL
  SELECT instance_guid, name, count(*), xt, xp, CASE WHEN count(*) >= xt THEN xa ELSE 'OK' END
  FROM f WHERE name IS NOT NULL AND event_ts >= {NOW_EV} - xp * INTERVAL 1 MINUTE GROUP BY instance_guid, name, xt, xp, xa)"""

check(
    "check_login_failures", "login_events policy_login",
    """SELECT instance_guid, name AS object,
      CASE WHEN name <> '_Total' THEN 'Total number of login failures for a monitored login was ' || n || ', exceeding threshold of ' || failed_login_threshold || ' per ' || monitoring_period_minutes || ' minute window.'
           WHEN state <> 'OK' THEN 'Total number of login failures in the last ' || monitoring_period_minutes || ' minutes was ' || n || ', exceeding threshold of ' || failed_login_threshold
           ELSE 'Total number of login failures in the last ' || monitoring_period_minutes || ' minutes was ' || n || ', below threshold of ' || failed_login_threshold || ' per ' || monitoring_period_minutes || ' minute window.' END AS message, state
    FROM (SELECT *, row_number() OVER (PARTITION BY instance_guid ORDER BY (name = '_Total'), state, n DESC, name) AS rn
          FROM totals WHERE name = '_Total' OR state <> 'OK') WHERE rn = 1""",
    """SELECT instance_guid, 'Total number of login failures in the last ' || monitoring_period_minutes || ' minutes was 0' AS message FROM policy_login WHERE name = '_default'""",
    _TOTALS,
)
sql("check_login_failures_detail", "login_events policy_login", _TOTALS + """
SELECT instance_guid, CASE WHEN name = '_Total' THEN 1 ELSE 0 END AS section, name, n AS "count", failed_login_threshold, monitoring_period_minutes, state FROM totals""")

check(
    "check_logshipping", "logship_primary logship_secondary policy_database instances",
    f"""SELECT l.instance_guid, primary_database AS object, 'database=' || {quoted('primary_database')} || '; role=PRIMARY; last_backup_minago=' || date_diff('minute', last_backup_date_utc, {NOW}) AS message,
      change_state_alert AS state
    FROM logship_primary l JOIN policy_database p ON p.instance_guid = l.instance_guid AND lower(p.db_name) = lower(primary_database)
    WHERE threshold_alert_enabled AND date_diff('minute', last_backup_date_utc, {NOW}) > backup_threshold
    UNION ALL
    SELECT l.instance_guid, secondary_database, 'database=' || {quoted('secondary_database')} || '; role=SECONDARY; primary_source=' || {quoted('primary_server')} || '.' || {quoted('primary_database')}
      || '; last_restore_minago=' || date_diff('minute', last_restored_date_utc, {NOW}), change_state_alert
    FROM logship_secondary l JOIN policy_database p ON p.instance_guid = l.instance_guid AND lower(p.db_name) = lower(secondary_database)
    WHERE threshold_alert_enabled AND date_diff('minute', last_restored_date_utc, {NOW}) > restore_threshold""",
    """SELECT i.instance_guid, CASE WHEN coalesce(pn, 0) + coalesce(sn, 0) = 0 THEN 'Logshipping is currently not configured.'
        ELSE coalesce(pn, 0) || ' primary database(s), ' || coalesce(sn, 0) || ' secondary database(s), ' END AS message
      FROM instances i
      LEFT JOIN (SELECT l.instance_guid, count(*) AS pn FROM logship_primary l JOIN policy_database p ON p.instance_guid = l.instance_guid AND lower(p.db_name) = lower(primary_database) WHERE is_enabled GROUP BY 1) USING (instance_guid)
      LEFT JOIN (SELECT l.instance_guid, count(*) AS sn FROM logship_secondary l JOIN policy_database p ON p.instance_guid = l.instance_guid AND lower(p.db_name) = lower(secondary_database) WHERE is_enabled GROUP BY 1) USING (instance_guid)""",
)

check(
    "check_mirroring", "databases mirror_state policy_database instances",
    f"""SELECT d.instance_guid, d.name AS object, 'database=' || {quoted('d.name')} || '; state=' || upper(mirroring_state_desc) || '; expected_role=' || upper(mirroring_role)
      || '; current_role=' || upper(mirroring_role_desc) AS message,
      CASE WHEN mirroring_state NOT IN (2, 4) OR mirroring_role <> mirroring_role_desc THEN change_state_alert ELSE 'OK' END AS state
    FROM databases d JOIN mirror_state m USING (instance_guid, database_id) JOIN policy_database p USING (instance_guid, database_id)
    WHERE p.is_enabled AND mirroring_guid IS NOT NULL""",
    "SELECT instance_guid, 'Mirroring is currently not configured.' AS message FROM instances",
)

check(
    "check_replica_group", "replica_state policy_replica_group instances",
    """SELECT instance_guid, object, message, state FROM judged WHERE state <> 'OK' AND instance_guid IN (SELECT instance_guid FROM judged WHERE state IN ('WARNING','CRITICAL'))
    UNION ALL
    SELECT instance_guid, NULL, 'Always-On (' || count(*) || ') availability groups healthy.', 'OK' FROM judged GROUP BY instance_guid
      HAVING count(*) FILTER (WHERE state IN ('WARNING','CRITICAL')) = 0""",
    "SELECT instance_guid, 'Always-On is currently not configured.' AS message FROM instances",
    """, judged AS (SELECT r.instance_guid, r.ag_name AS object, 'ag=' || r.ag_name || '; sync=' || synchronization_health_desc || '; conn=' || connected_state_desc
        || '; exp_role=' || p.ag_role || '; curr_role=' || r.role_desc || '; ' AS message,
      CASE WHEN p.ag_state_is_enabled AND (synchronization_health <> 2 OR connected_state <> 1) THEN ag_state_alert
           WHEN p.ag_role_is_enabled AND p.ag_role <> r.role_desc THEN ag_role_alert ELSE 'OK' END AS state
      FROM replica_state r JOIN policy_replica_group p USING (instance_guid, ag_id))""",
)

_PARTS = [("check_backup", BACKUP), ("check_integrity", INTEGRITY), ("check_database_state", STATE), ("check_job", JOB)]
_ctes, _unions = [], []
for _name, _p in _PARTS:
    if len(_p) > 2:
        _ctes.append(_p[2])
    _ctes.append(f", r_{_name} AS ({_p[0]}), s_{_name} AS ({_p[1]})")
    _unions.append(
        f"SELECT instance_guid, '{_name}' AS c, message, state FROM r_{_name} UNION ALL SELECT instance_guid, '{_name}', message, 'NA' FROM s_{_name} "
        f"WHERE instance_guid NOT IN (SELECT instance_guid FROM r_{_name})"
    )
ORACLE["check_rollup"] = (
    duckdb_ctes(*"databases backup_history policy_database instances db_info job_history policy_job".split())
    + "".join(_ctes)
    + f""", a AS ({' UNION ALL '.join(_unions)})
, g AS (SELECT instance_guid, c, max({CODE}) AS state_code, count(*) FILTER (WHERE state <> 'NA') AS "count" FROM a GROUP BY 1, 2),
t AS (SELECT instance_guid, c, upper(state) || ' - ' || message AS message, count(*) AS copies FROM a GROUP BY 1, 2, 3)
SELECT instance_guid, c AS "check", message, copies, state_code, "count" FROM t JOIN g USING (instance_guid, c)"""
)

ORACLE["run_checks"] = " UNION ALL ".join(
    f"SELECT * FROM ({ORACLE[n]})"
    for n in (
        "check_backup", "check_integrity", "check_database_state", "check_inventory", "check_job",
        "check_job_long_running", "check_logshipping", "check_mirroring", "check_replica_group",
    )
)
