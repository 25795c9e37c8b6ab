"""Statements for maintenance advice."""

from .common import NOW, sql, ts

SELECTED = """, o AS (SELECT d.instance_guid, d.database_id, d.name, lower(d.name) IN ('master','msdb','model') AS is_system,
    EXISTS (SELECT 1 FROM group_databases g WHERE g.instance_guid = d.instance_guid AND g.database_id = d.database_id) AS in_availability_group
  FROM databases d WHERE lower(d.name) <> 'tempdb' AND source_database_id IS NULL),
sel AS (SELECT *, CASE WHEN in_availability_group THEN 1 WHEN name ILIKE 'Customer#000000%' THEN 2 WHEN NOT is_system THEN 5 END AS position
  FROM o WHERE name NOT ILIKE '%7' AND name NOT ILIKE '%\\_0' ESCAPE '\\')"""
sql("select_objects", "databases group_databases", SELECTED + " SELECT * FROM sel WHERE position IS NOT NULL")

RANKED = SELECTED + """, z AS (SELECT instance_guid, database_id, CAST(sum(size_pages) AS BIGINT) AS size_mb FROM db_files GROUP BY 1, 2),
c AS (SELECT instance_guid, database_name AS name, max(start_time) AS last_command_time FROM command_log WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0 GROUP BY 1, 2),
j AS (SELECT sel.*, z.size_mb, c.last_command_time FROM sel LEFT JOIN z USING (instance_guid, database_id) LEFT JOIN c USING (instance_guid, name) WHERE position IS NOT NULL)"""
for _name, _order in (
    ("rank_objects", "position, name"), ("rank_objects_by_size", "size_mb DESC NULLS LAST, name"),
    ("rank_objects_by_command", "last_command_time ASC NULLS FIRST, name"),
):
    sql(_name, "databases group_databases db_files command_log", RANKED + f"""
SELECT * REPLACE ({ts('last_command_time')} AS last_command_time), row_number() OVER (PARTITION BY instance_guid ORDER BY {_order}) AS object_order FROM j""")

FRAG = """, a AS (SELECT *, CASE WHEN NOT on_read_only_filegroup THEN CASE WHEN fragmentation >= 30 THEN 'High' WHEN fragmentation >= 5 THEN 'Medium' ELSE 'Low' END END AS fragmentation_group,
   NOT on_read_only_filegroup AND index_type IN (1,2,3,4,5) AND (allow_page_locks OR index_type = 5) AS a_reorg, NOT on_read_only_filegroup AND index_type IN (1,2,3,4,5) AS a_off,
   NOT on_read_only_filegroup AND index_type IN (1, 2) AND allow_online AS a_on FROM index_stats),
fr AS (SELECT * EXCLUDE (a_reorg, a_off, a_on), CASE WHEN page_count >= 1000 AND page_count <= 4900 THEN CASE fragmentation_group
   WHEN 'Medium' THEN CASE WHEN a_reorg THEN 'INDEX_REORGANIZE' WHEN a_on THEN 'INDEX_REBUILD_ONLINE' WHEN a_off THEN 'INDEX_REBUILD_OFFLINE' END
   WHEN 'High' THEN CASE WHEN a_on THEN 'INDEX_REBUILD_ONLINE' WHEN a_off THEN 'INDEX_REBUILD_OFFLINE' END END END AS action FROM a)"""
sql("fragmentation_action", "index_stats", FRAG + " SELECT * FROM fr")
sql("stats_update_due", "index_stats", FRAG + """
SELECT *, index_id IS NOT NULL AND index_type IN (1,2,3,4,7) AND (modification_counter * 100.0 / row_count >= 5 OR (modification_counter > 0 AND CAST(modification_counter AS HUGEINT) * modification_counter >= CAST(row_count AS HUGEINT) * 1000))
  AND coalesce(action, '') NOT LIKE 'INDEX_REBUILD%' AS update_due FROM fr""")

_STATS = f"* REPLACE ({ts('last_log_backup')} AS last_log_backup)"
sql("backup_type_choice", "db_stats", f"""
, k AS (SELECT *, CASE WHEN recovery_model_desc IN ('FULL','BULK_LOGGED') AND log_lsn IS NULL AND name <> 'master' THEN 'DIFF' ELSE 'LOG' END AS t FROM db_stats)
SELECT * EXCLUDE (t) REPLACE ({ts('last_log_backup')} AS last_log_backup), CASE WHEN t = 'DIFF' AND (name = 'master' OR differential_base_lsn IS NULL OR differential_base_is_snapshot OR modified_extent_pages * 100 >= 50 * allocated_extent_pages)
  THEN 'FULL' ELSE t END AS backup_type FROM k""")
sql("log_backup_due", "db_stats", f"""
SELECT {_STATS}, (log_mb_since_backup IS NULL OR last_log_backup IS NULL OR log_mb_since_backup >= 40 OR date_diff('second', last_log_backup, {NOW}) >= 30000) AS log_backup_due FROM db_stats""")
sql("last_successful_command", "command_log", f"""
SELECT instance_guid, database_name, {ts('max(start_time)')} AS last_command_time FROM command_log WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0 GROUP BY 1, 2""")

sql("command_history_summary", "command_log", """
SELECT instance_guid, command_type, database_name, CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, count(*) AS runs, count(*) FILTER (error_number <> 0) AS errors,
  sum((epoch_us(end_time) - epoch_us(start_time)) / 1000000) AS total_seconds, max((epoch_us(end_time) - epoch_us(start_time)) / 1000000) AS longest_seconds
FROM command_log GROUP BY ALL""")
