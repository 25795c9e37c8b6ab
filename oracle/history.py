"""Statements for incremental extracts."""

from .common import NOW, NOW_EV, clean, iso, sql, ts


def windows(dataset: str, now: str = NOW) -> str:
    return f""", win AS (SELECT instance_guid, coalesce(last_run, {now} - INTERVAL 1 DAY) AS s, {now} AS e FROM marks WHERE dataset = '{dataset}')"""


sql("extract_window", "marks", windows("log_backup") + f" SELECT instance_guid, {ts('s')} AS start_at, {ts('e')} AS end_at FROM win")
sql("extract_window_marks", "marks", f"""
SELECT instance_guid, dataset, {ts(f"CASE WHEN dataset = 'log_job' THEN {NOW} ELSE last_run END")} AS last_run FROM marks""")


def mb(expr: str, unit: int = 1048576) -> str:
    return f"floor(CAST({expr} AS DOUBLE) / {unit} * 100 + 0.5) / 100"


sql("log_backup", "backup_history databases policy_database marks", windows("log_backup") + f"""
SELECT b.instance_guid, {iso('backup_start_date')} AS backup_start_date, {iso('backup_finish_date')} AS backup_finish_date, d.name AS database_name, b.type AS backup_type,
  is_copy_only, software_name, user_name, physical_device_name, {mb('backup_size')} AS backup_size_mb, {mb('compressed_backup_size')} AS compressed_backup_size_mb,
  CAST((20000 * (backup_size - compressed_backup_size)::HUGEINT + backup_size) // (2 * backup_size::HUGEINT) AS BIGINT) / 100 AS compression_ratio,
  encryptor_type, is_password_protected, p.backup_frequency_hours
FROM backup_history b JOIN win w USING (instance_guid) JOIN databases d ON d.instance_guid = b.instance_guid AND lower(d.name) = lower(b.database_name)
  JOIN policy_database p ON p.instance_guid = d.instance_guid AND p.database_id = d.database_id
WHERE backup_start_date > w.s AND backup_start_date <= w.e AND lower(d.name) <> 'tempdb'""")

CAPACITY = f"""SELECT f.instance_guid, d.name AS database_name, f.physical_name, f.name AS logical_name, f.file_type AS type_desc,
  {mb('used_pages', 128)} AS used_mb, {mb('size_pages', 128)} AS reserved_mb, r.drive, CAST(r.free_mb AS DOUBLE) AS free_mb, CAST(r.capacity_mb AS DOUBLE) AS capacity_mb,
  {iso(NOW)} AS check_date
FROM db_files f JOIN databases d USING (instance_guid, database_id) JOIN drives r ON r.instance_guid = f.instance_guid AND r.drive = substr(f.physical_name, 1, 1)"""
sql("log_capacity", "db_files databases drives", " " + CAPACITY)
sql("stage_capacity_append", "db_files databases drives stage_capacity", f"""
, c AS ({CAPACITY})
SELECT * FROM c UNION ALL
SELECT instance_guid, database_name, physical_name, logical_name, type_desc, CAST(used_mb AS DOUBLE), CAST(reserved_mb AS DOUBLE), drive, CAST(free_mb AS DOUBLE), CAST(capacity_mb AS DOUBLE), check_date
FROM stage_capacity WHERE CAST(substr(check_date, 1, 19) AS TIMESTAMP) >= TIMESTAMP '2001-05-02'""")
sql("drive_sizes", "volume_eav drive_free", f"""
, v AS (SELECT instance_guid, upper(regexp_extract(hierarchy, 'Win32_Volume/(.)', 1)) AS drive, {mb('value')} AS capacity_mb FROM volume_eav WHERE lower(property) = 'capacity' AND hierarchy ILIKE '%Win32\\_Volume%' ESCAPE '\\')
SELECT v.instance_guid, v.drive, v.capacity_mb, CAST(f.free_mb AS DOUBLE) AS free_mb FROM v JOIN drive_free f USING (instance_guid, drive)""")

_PAIRS = windows("log_error", NOW_EV) + """
, e AS (SELECT l.* FROM error_log l JOIN win w USING (instance_guid) WHERE log_date > w.s AND log_date <= w.e),
n AS (SELECT *, lead(message) OVER (PARTITION BY instance_guid ORDER BY log_date, source, seq) AS nxt, lead(seq) OVER (PARTITION BY instance_guid ORDER BY log_date, source, seq) AS nseq FROM e),
h AS (SELECT *, CAST(regexp_extract(message, '^Error: ([0-9]+),', 1) AS INT) AS mid FROM n WHERE message LIKE 'Error:%Severity:%State:%' AND nseq IS NOT NULL)"""

for _name, _text in (("log_error_pairs", "nxt"), ("log_error_pairs_sanitized", "m.text")):
    sql(_name, "error_log messages marks", _PAIRS + f"""
SELECT h.instance_guid, {iso('log_date')} AS log_date, CASE WHEN source LIKE 'spid%' THEN 'spid' ELSE source END AS source, message AS message_header, {clean(_text)} AS message
FROM h JOIN messages m ON m.message_id = h.mid""")

sql("log_error_integrity", "error_log marks", windows("log_error", NOW_EV) + f"""
, t AS (SELECT l.*, {clean('message')} AS c FROM error_log l JOIN win w USING (instance_guid) WHERE log_date > w.s AND log_date <= w.e
  AND message LIKE '%found % errors and repaired % errors%' AND message NOT LIKE '%found 0 errors and repaired 0 errors%')
SELECT instance_guid, {iso('log_date')} AS log_date, source, 'Error: dbcc' AS message_header, substr(c, instr(c, ' found ')) AS message FROM t""")

_JOBS = windows("log_job") + """
, j AS (SELECT *, make_timestamp(run_date // 10000, run_date // 100 % 100, run_date % 100, run_time // 10000, run_time // 100 % 100, CAST(run_time % 100 AS DOUBLE)) AS run_at FROM job_history WHERE run_status NOT IN (1, 4))"""
for _name, _text in (
    ("log_job", "CASE WHEN run_status = 0 THEN message END"),
    ("log_job_sanitized", "coalesce(m.text, 'SANITIZE_DATASET is enabled. Please investigate on the SQL Instance.')"),
):
    sql(_name, "job_history messages marks", _JOBS + f"""
SELECT j.instance_guid, {iso('run_at')} AS run_datetime, job_name, step_id, step_name, {clean(_text)} AS error_message,
  CASE run_status WHEN 0 THEN 'Failed' WHEN 2 THEN 'Retry (step only)' WHEN 3 THEN 'Canceled' ELSE 'Unknown' END AS run_status,
  run_duration // 10000 * 3600 + run_duration // 100 % 100 * 60 + run_duration % 100 AS run_duration_sec
FROM j JOIN win w USING (instance_guid) LEFT JOIN messages m ON m.message_id = j.sql_message_id WHERE run_at > w.s AND run_at <= w.e""")

sql("log_maintenance", "plans subplans plan_log jobs marks", windows("log_maintenance") + f"""
SELECT l.instance_guid, {iso('l.start_time')} AS start_time, {iso('l.end_time')} AS end_time, p.plan_name, j.job_name,
  {clean("line1 || CASE WHEN line2 <> '' THEN ' | ' || line2 ELSE '' END || CASE WHEN line3 <> '' THEN ' | ' || line3 ELSE '' END || CASE WHEN line4 <> '' THEN ' | ' || line4 ELSE '' END || CASE WHEN line5 <> '' THEN ' | ' || line5 ELSE '' END")} AS description,
  succeeded, error_number, {clean('error_message')} AS error_message
FROM plan_log l JOIN win w USING (instance_guid) JOIN subplans s USING (instance_guid, plan_id, subplan_id) JOIN plans p USING (instance_guid, plan_id) LEFT JOIN jobs j USING (instance_guid, job_id)
WHERE l.start_time > w.s AND l.start_time <= w.e""")

sql("sanitize_message", "job_history messages", """
SELECT instance_id, sql_message_id, coalesce(m.text, 'SANITIZE_DATASET is enabled. Please investigate on the SQL Instance.') AS message
FROM job_history LEFT JOIN messages m ON m.message_id = sql_message_id""")
sql("clean_text", "texts", f" SELECT doc_id, {clean('text')} AS text FROM texts")
sql("iso_with_offset", "login_events", f" SELECT event_id, destination_code, {iso('event_ts')} AS at FROM login_events".replace(" AS at", ' AS "at"'))
