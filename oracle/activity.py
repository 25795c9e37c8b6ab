"""Statements for session activity."""

from .common import sql, ts

_SESSION = f"SELECT * REPLACE ({ts('snapshot_ts')} AS snapshot_ts, {ts('start_time')} AS start_time) FROM sessions"
sql("session_filter", "sessions", f" {_SESSION} WHERE program_name LIKE 'app\\_1%' ESCAPE '\\' AND host_name NOT LIKE '%7'")
sql("session_interest", "sessions", f" {_SESSION} WHERE is_user_process AND (status <> 'sleeping' OR open_tran_count > 0)")

_M = "reads writes cpu tempdb_allocations used_memory physical_io physical_reads tempdb_current context_switches max_used_memory".split()
sql("session_delta", "sessions", f"""
, a AS (SELECT * FROM sessions WHERE snapshot_ts = TIMESTAMP '1998-06-01'), b AS (SELECT * FROM sessions WHERE snapshot_ts = TIMESTAMP '2000-06-01')
SELECT b.instance_guid, b.session_id, b.request_id, {ts('b.start_time')} AS start_time, {', '.join('b.' + m for m in _M)},
  {', '.join(f"CASE WHEN a.start_time = b.start_time AND b.{m} - a.{m} >= 0 THEN b.{m} - a.{m} END AS {m}_delta" for m in _M)}
FROM b LEFT JOIN a USING (instance_guid, session_id, request_id)""")

WAITS = """, w AS (SELECT instance_guid, snapshot_ts, session_id, request_id, wait_type, count(*) AS tasks, min(wait_ms) AS min_ms, CAST(sum(wait_ms) // count(*) AS BIGINT) AS avg_ms, max(wait_ms) AS max_ms,
    bool_or(blocking_session_id IS NOT NULL) AS is_blocked FROM waits WHERE wait_ms > 0 GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_guid, snapshot_ts, session_id, request_id ORDER BY is_blocked DESC, tasks DESC, wait_type) AS rank FROM w)"""
sql("wait_rollup", "waits", WAITS + f" SELECT * REPLACE ({ts('snapshot_ts')} AS snapshot_ts) FROM r")
sql("wait_format", "waits", WAITS + f"""
SELECT instance_guid, {ts('snapshot_ts')} AS snapshot_ts, session_id, request_id, string_agg('(' || tasks || 'x: ' || CASE WHEN tasks = 1 THEN CAST(min_ms AS VARCHAR) WHEN tasks = 2 THEN min_ms || '/' || max_ms ELSE min_ms || '/' || avg_ms || '/' || max_ms END
  || 'ms)' || wait_type, ', ' ORDER BY rank) AS wait_info FROM r GROUP BY 1, 2, 3, 4""")

sql("block_leaders", "sessions", f"""
, s AS (SELECT DISTINCT instance_guid, snapshot_ts, session_id, blocking_session_id FROM sessions),
RECURSIVE_MARK walk AS (SELECT instance_guid, snapshot_ts, session_id, session_id AS top FROM s
  UNION SELECT s.instance_guid, s.snapshot_ts, s.session_id, w.top FROM walk w JOIN s ON s.instance_guid = w.instance_guid AND s.snapshot_ts = w.snapshot_ts AND s.blocking_session_id = w.session_id)
SELECT instance_guid, {ts('snapshot_ts')} AS snapshot_ts, top AS session_id, count(*) - 1 AS blocked_session_count FROM walk GROUP BY ALL""")

sql("lock_rollup", "locks", """
, p AS (SELECT * REPLACE (CASE WHEN resource_type <> 'DATABASE' THEN coalesce(object_name, '(null)') END AS object_name, CASE WHEN resource_type <> 'DATABASE' THEN schema_name END AS schema_name) FROM locks),
c AS (SELECT instance_guid, snapshot_ts, session_id, request_id, database_name, resource_type, schema_name, object_name, request_mode, request_status, count(*) AS request_count FROM p GROUP BY ALL)
SELECT instance_guid, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S.%f') AS snapshot_ts, session_id, request_id, database_name, resource_type, schema_name, object_name, CAST(sum(request_count) AS BIGINT) AS request_count,
  CAST(to_json(list({'request_mode': c.request_mode, 'request_status': c.request_status, 'request_count': c.request_count} ORDER BY c.request_mode, c.request_status)) AS VARCHAR) AS locks
FROM c GROUP BY c.snapshot_ts, 1, 2, 3, 4, 5, 6, 7, 8""")

TRAN = """, t AS (SELECT instance_guid, snapshot_ts, session_id, request_id, database_name, CAST(sum(log_records) AS BIGINT) AS log_record_count, CAST(sum(log_bytes) // 1024 AS BIGINT) AS log_kb_used, min(begin_time) AS transaction_start_time,
  max(CASE WHEN name = 'implicit_transaction' THEN 1 ELSE 0 END) AS implicit_tran FROM tran_log GROUP BY 1, 2, 3, 4, 5)"""
sql("tran_log_rollup", "tran_log", TRAN + f" SELECT * REPLACE ({ts('transaction_start_time')} AS transaction_start_time, {ts('snapshot_ts')} AS snapshot_ts) FROM t")
sql("tran_log_format", "tran_log", TRAN + f"""
, l AS (SELECT *, database_name || ': ' || log_record_count || ' (' || log_kb_used || ' kB)' AS line FROM t)
SELECT instance_guid, {ts('snapshot_ts')} AS snapshot_ts, session_id, request_id, line AS tran_log_write, {ts('min(transaction_start_time) OVER r')} AS transaction_start_time, max(implicit_tran) OVER r AS implicit_tran FROM l
WINDOW r AS (PARTITION BY instance_guid, l.snapshot_ts, session_id, request_id)""")

sql("avg_elapsed", "requests statement_stats", """
SELECT r.instance_guid, r.request_id, r.statement_id, s.total_elapsed_ms // nullif(s.execution_count, 0) AS avg_elapsed_ms FROM requests r LEFT JOIN statement_stats s USING (instance_guid, statement_id)""")
sql("activity_view", "sessions", f" SELECT instance_guid, {ts('snapshot_ts')} AS snapshot_ts, session_id, login_name, host_name, program_name, database_name FROM sessions")
sql("duration_format", "requests", """
, m AS (SELECT request_id, total_elapsed_time * 1009 AS ms FROM requests)
SELECT request_id, CASE WHEN ms // 86400000 < 10 THEN '0' ELSE '' END || (ms // 86400000) || ' ' || lpad(CAST(ms // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS elapsed FROM m""")
sql("running_requests", "requests session_info connections", f"""
SELECT r.instance_guid, r.session_id, r.request_id, r.status, s.host_name, c.client_net_address, CASE WHEN s.login_name = s.original_login_name THEN s.login_name ELSE s.login_name || ' (' || s.original_login_name || ')' END AS login_name,
  s.program_name, r.command, substr(r.text, statement_start_offset // 2, (CASE WHEN statement_end_offset = -1 THEN length(rtrim(r.text)) * 2 ELSE statement_end_offset END - statement_start_offset) // 2) AS statement,
  {ts('r.start_time')} AS start_time, total_elapsed_time AS total_elapsed_time_ms,
  CASE transaction_isolation_level WHEN 0 THEN 'Unspecified' WHEN 1 THEN 'ReadUncomitted' WHEN 2 THEN 'ReadCommitted' WHEN 3 THEN 'Repeatable' WHEN 4 THEN 'Serializable' WHEN 5 THEN 'Snapshot' ELSE CAST(transaction_isolation_level AS VARCHAR) END AS transaction_isolation_level_name
FROM requests r LEFT JOIN session_info s USING (instance_guid, session_id) LEFT JOIN connections c ON c.instance_guid = r.instance_guid AND c.connection_id = r.connection_id
WHERE r.status NOT IN ('Background', 'Sleeping') AND r.session_id <> 7""")
