"""Statements for capacity and counter charts."""

from .common import sql

MB2 = "CAST(floor(({0}) * 100 + 0.5) AS BIGINT)"  # hundredths of a megabyte


def cents(expr: str) -> str:
    return MB2.format(expr)


FILES = f""", files AS (
  SELECT f.instance_guid, f.database_id, d.state, d.is_read_only AS database_is_read_only, f.file_id, f.name, f.file_type, f.physical_name,
    CASE WHEN d.state = 0 THEN coalesce(f.filegroup_id, 0) END AS filegroup_id,
    CASE WHEN d.state = 0 THEN f.filegroup_name END AS filegroup_name,
    CASE WHEN d.state = 0 THEN f.filegroup_is_readonly END AS filegroup_is_readonly,
    upper(substr(f.physical_name, 1, 1)) AS drive,
    CASE WHEN d.state = 0 THEN f.used_pages ELSE 0 END AS used_pages,
    CASE WHEN d.state = 0 THEN {cents('f.used_pages / 128')} ELSE 0 END AS used, {cents('f.size_pages / 128')} AS reserved,
    size_pages, max_size_pages, growth, is_percent_growth
  FROM db_files f JOIN databases d USING (instance_guid, database_id)
  WHERE d.state = 0 OR EXISTS (SELECT 1 FROM policy_database p WHERE p.instance_guid = f.instance_guid AND p.database_id = f.database_id))"""

# hundredths of a megabyte throughout; 100/128 page is exact in a double
ROOM = FILES + f""", sp AS (
  SELECT f.*, CAST(r.free_mb * 100 AS BIGINT) AS free, reserved - used AS slack, size_pages * 0.78125::DOUBLE AS sz, max_size_pages * 0.78125::DOUBLE AS mx,
    CASE WHEN is_percent_growth THEN CAST(size_pages * growth AS DOUBLE) / 128 ELSE growth * 0.78125::DOUBLE END AS step
  FROM files f LEFT JOIN drives r ON r.instance_guid = f.instance_guid AND r.drive = f.drive),
room AS (SELECT *, CASE WHEN filegroup_is_readonly THEN slack
    WHEN max_size_pages = -1 THEN CASE WHEN growth = 0 OR step > free THEN slack ELSE free END
    WHEN max_size_pages > 0 THEN CASE WHEN growth = 0 THEN slack
      WHEN mx - reserved >= free THEN CASE WHEN step > free THEN slack ELSE free END
      WHEN (is_percent_growth AND step >= mx - sz) OR (NOT is_percent_growth AND step > mx - sz) THEN slack
      ELSE CAST(floor(mx - used + 0.5) AS BIGINT) END END AS headroom FROM sp)"""

GROUPS = ROOM + """, per_drive AS (
  SELECT instance_guid, database_id, state, database_is_read_only, filegroup_id, filegroup_name, filegroup_is_readonly, file_type, drive,
    sum(used) AS used, sum(reserved) AS reserved, max(free) AS free,
    sum(CASE WHEN max_size_pages = -1 AND growth = 0 THEN size_pages ELSE max_size_pages END) * 0.78125::DOUBLE AS lim, sum(growth) AS growth,
    min(CASE WHEN max_size_pages = -1 AND growth = 0 THEN size_pages ELSE max_size_pages END) AS lowest, sum(headroom) AS rooms
  FROM room GROUP BY ALL),
groups AS (SELECT instance_guid, database_id, state, database_is_read_only, filegroup_id, filegroup_name, filegroup_is_readonly, file_type,
    CAST(sum(used) AS BIGINT) AS used, CAST(sum(reserved) AS BIGINT) AS reserved,
    CAST(sum(CASE WHEN lim - reserved >= free OR (growth > 0 AND lowest < 0) THEN free + reserved - used ELSE rooms END) AS BIGINT) AS headroom
  FROM per_drive GROUP BY ALL)"""

INPUTS = "db_files databases policy_database"

sql("file_inventory", INPUTS, FILES + """
SELECT * EXCLUDE (used, reserved), used / 100 AS used_mb, reserved / 100 AS reserved_mb FROM files""")
sql("file_headroom", INPUTS + " drives", ROOM + """
SELECT instance_guid, database_id, file_id, drive, free / 100 AS disk_free_mb, headroom / 100 AS headroom_mb FROM room""")
sql("filegroup_headroom", INPUTS + " drives", GROUPS + """
SELECT * EXCLUDE (used, reserved, headroom), used / 100 AS used_mb, reserved / 100 AS reserved_mb, headroom / 100 AS headroom_mb FROM groups""")


def money(expr: str) -> str:
    """Hundredths of a megabyte as bytes with two decimals, as text."""
    return f"CAST(CAST({expr} AS DECIMAL(38,0)) * 1048576 / 100 AS DECIMAL(38,2))"


CHART = GROUPS + """, base AS (
  SELECT g.*, p.db_name, used + headroom AS total, coalesce(filegroup_is_readonly, false) OR database_is_read_only AS frozen,
    replace(p.db_name, ' ', '_') || '_' || replace(CASE WHEN filegroup_name IS NULL THEN file_type ELSE file_type || '_' || filegroup_name END, ' ', '_') AS label,
    (used + headroom) - (used + headroom) * capacity_warning_percent_free / 100 AS w0, (used + headroom) - (used + headroom) * capacity_critical_percent_free / 100 AS c0
  FROM groups g JOIN policy_database p USING (instance_guid, database_id) WHERE p.is_enabled),
lev AS (SELECT *, CASE WHEN NOT (frozen OR state <> 0) AND floor(w0 + 0.5) >= 100 THEN CAST(floor(w0 + 0.5) AS BIGINT) END AS w,
    CASE WHEN NOT (frozen OR state <> 0) AND floor(c0 + 0.5) >= 100 THEN CAST(floor(c0 + 0.5) AS BIGINT) END AS c, CASE WHEN frozen THEN reserved ELSE total END AS m FROM base),
bytes AS (SELECT instance_guid, database_id, label, used * 1048576 // 100 AS vi, used * 1048576 % 100 AS vf, w * 1048576 // 100 AS wi, w * 1048576 % 100 AS wf,
    c * 1048576 // 100 AS ci, c * 1048576 % 100 AS cf, m * 1048576 // 100 AS mi, m * 1048576 % 100 AS mf, reserved * 1048576 // 100 AS ri, reserved * 1048576 % 100 AS rf FROM lev),
chart AS (SELECT instance_guid, database_id, label, vi + vf / 100 AS val, wi + wf / 100 AS warn, ci + cf / 100 AS crit, mi + mf / 100 AS max, ri + rf / 100 AS reserved,
  '''' || label || '_used''=' || vi || '.' || lpad(CAST(vf AS VARCHAR), 2, '0') || ';' || coalesce(wi || '.' || lpad(CAST(wf AS VARCHAR), 2, '0'), '') || ';'
    || coalesce(ci || '.' || lpad(CAST(cf AS VARCHAR), 2, '0'), '') || ';0;' || mi || '.' || lpad(CAST(mf AS VARCHAR), 2, '0') || '|''' || label || '_reserved''='
    || ri || '.' || lpad(CAST(rf AS VARCHAR), 2, '0') || ';;;;' AS pnp FROM bytes)"""

sql("chart_capacity", INPUTS + " drives", CHART + " SELECT * FROM chart")

sql("chart_capacity_drive", "db_files databases drives group_databases replica_state", """
, dr AS (SELECT f.instance_guid, upper(substr(physical_name, 1, 1)) AS drive, CAST(sum(used_pages) * 8192 AS BIGINT) AS val, CAST(sum(size_pages) * 8192 AS BIGINT) AS warn
  FROM db_files f JOIN databases d USING (instance_guid, database_id)
  WHERE d.state_desc = 'ONLINE' AND NOT EXISTS (SELECT 1 FROM group_databases g JOIN replica_state r USING (instance_guid, ag_id)
    WHERE g.instance_guid = f.instance_guid AND g.database_id = f.database_id AND r.role_desc = 'SECONDARY' AND r.secondary_unreadable)
  GROUP BY 1, 2),
s AS (SELECT dr.*, CAST(capacity_mb * 1048576 AS BIGINT) AS crit, CAST(capacity_mb * 1048576 AS BIGINT) * 105 AS m FROM dr LEFT JOIN drives USING (instance_guid, drive))
SELECT instance_guid, drive, CAST(val AS DOUBLE) AS val, CAST(warn AS DOUBLE) AS warn, CAST(crit AS DOUBLE) AS crit, m / 100 AS max,
  '''' || drive || '''=' || val || '.00;' || warn || '.00;' || crit || '.00;0;' || (m // 100) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') AS pnp FROM s""")

MATCH = """rtrim(s.counter_name) ILIKE coalesce(p.counter_name, '%') AND rtrim(s.object_name) ILIKE p.object_name AND rtrim(s.instance_name) ILIKE coalesce(p.instance_name, '%')"""

sql("counter_match", "counter_samples policy_counter", f"""
SELECT s.* REPLACE (strftime(s.sample_ts, '%Y-%m-%d %H:%M:%S.%f') AS sample_ts), CAST(p.warning_threshold AS DOUBLE) AS warning_threshold, CAST(p.critical_threshold AS DOUBLE) AS critical_threshold
FROM counter_samples s JOIN policy_counter p ON p.instance_guid = s.instance_guid AND {MATCH}""")

RATE = """, b AS (SELECT instance_guid, object_name, instance_name, seq, cntr_value AS bv,
    lower(rtrim(replace(replace(replace(replace(counter_name, 'Ratio', ''), ' Base', ''), ' BS', ''), 'Avg ', ''))) AS bn FROM counter_samples WHERE cntr_type = 1073939712),
w AS (SELECT s.*, b.bv FROM counter_samples s LEFT JOIN b ON s.cntr_type IN (537003264, 1073874176) AND b.instance_guid = s.instance_guid AND b.object_name = s.object_name
    AND b.instance_name = s.instance_name AND b.seq = s.seq AND b.bn = lower(rtrim(replace(replace(replace(rtrim(s.counter_name), '(ms)', ''), 'Ratio', ''), 'Avg ', '')))
  WHERE cntr_type IN (537003264, 1073874176, 272696576, 65792)),
l AS (SELECT *, lag(seq) OVER q AS pseq, lag(cntr_value) OVER q AS pv, lag(ms_ticks) OVER q AS pt, lag(bv) OVER q AS pb FROM w
  WINDOW q AS (PARTITION BY instance_guid, object_name, counter_name, instance_name ORDER BY sample_ts, seq)),
nd AS (SELECT *, CAST(CASE cntr_type WHEN 537003264 THEN CASE WHEN cntr_value > 0 THEN cntr_value * 100 ELSE 0 END
      WHEN 1073874176 THEN greatest(cntr_value - pv, 0) WHEN 272696576 THEN greatest(cntr_value - pv, 0) * 1000 ELSE cntr_value END AS HUGEINT) AS num,
    CAST(CASE cntr_type WHEN 537003264 THEN CASE WHEN cntr_value > 0 THEN bv ELSE 1 END WHEN 1073874176 THEN CASE WHEN cntr_value > pv THEN bv - pb ELSE 1 END
      WHEN 272696576 THEN CASE WHEN cntr_value > pv THEN ms_ticks - pt ELSE 1 END ELSE 1 END AS HUGEINT) AS den FROM l WHERE pseq IS NOT NULL),
rate AS (SELECT * EXCLUDE (pseq, pv, pt, pb, bv, num, den), CASE WHEN den = 0 THEN NULL ELSE CAST((200 * num + den) // (2 * den) AS BIGINT) END AS hundredths FROM nd)"""

sql("counter_rate", "counter_samples", RATE + """
SELECT * EXCLUDE (hundredths) REPLACE (strftime(sample_ts, '%Y-%m-%d %H:%M:%S.%f') AS sample_ts), hundredths / 100 AS val FROM rate""")

UOM = """CASE WHEN cntr_type = 537003264 OR counter_name ILIKE '%\\%%' ESCAPE '\\' THEN '%' WHEN cntr_type = 65792 AND counter_name ILIKE 'Percent %' THEN '%'
  WHEN cntr_type = 65792 AND lower(rtrim(counter_name)) = 'usage' THEN 'c' WHEN counter_name ILIKE '%(ms)%' OR instance_name ILIKE '%(ms)%' THEN 'ms'
  WHEN counter_name ILIKE '%(KB)%' OR instance_name ILIKE '%(KB)%' THEN 'KB' WHEN counter_name ILIKE '%Byte%' AND counter_name NOT ILIKE '%/sec%' THEN 'B' END"""

sql("counter_uom", "counter_samples", f"""
SELECT instance_guid, seq, counter_name, instance_name, cntr_type, {UOM} AS uom FROM counter_samples""")

sql("chart_counter", "counter_samples policy_counter", RATE + f"""
, m AS (SELECT s.*, p.warning_threshold AS wt, p.critical_threshold AS ct, {UOM.replace('counter_name', 's.counter_name').replace('instance_name', 's.instance_name')} AS uom,
  replace(replace(lower(rtrim(s.object_name)), ' ', '_'), 'sqlserver:', '') || '_' || replace(lower(rtrim(s.counter_name)), ' ', '_') || '_' || replace(lower(rtrim(s.instance_name)), ' ', '_') AS label
  FROM rate s JOIN policy_counter p ON p.instance_guid = s.instance_guid AND {MATCH})
SELECT instance_guid, strftime(sample_ts, '%Y-%m-%d %H:%M:%S.%f') AS sample_ts, seq, label, hundredths / 100 AS val, CAST(wt AS DOUBLE) AS warn, CAST(ct AS DOUBLE) AS crit, uom,
  '''' || label || '''=' || (hundredths // 100) || '.' || lpad(CAST(hundredths % 100 AS VARCHAR), 2, '0') || coalesce(uom, '') || ';' || coalesce(CAST(wt AS VARCHAR), '') || ';' || coalesce(CAST(ct AS VARCHAR), '') || ';;' AS pnp
FROM m""")

sql("chart_evaluate", INPUTS + " drives", CHART + """
, j AS (SELECT *, CASE WHEN warn IS NULL OR crit IS NULL THEN 'OK' WHEN crit >= warn THEN CASE WHEN val >= crit THEN 'CRITICAL' WHEN val >= warn THEN 'WARNING' ELSE 'OK' END
    ELSE CASE WHEN val <= crit THEN 'CRITICAL' WHEN val <= warn THEN 'WARNING' ELSE 'OK' END END AS state, replace(split_part(pnp, '=', 1), '''', '') AS nm FROM chart WHERE val IS NOT NULL AND coalesce(pnp, '') <> ''),
g AS (SELECT instance_guid, max(CASE state WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS state_code, count(*) AS "rows" FROM j GROUP BY instance_guid),
t AS (SELECT instance_guid, CASE WHEN state <> 'OK' THEN state || ' - ' || nm END AS breach, pnp AS perf, count(*) AS copies FROM j GROUP BY ALL)
SELECT instance_guid, 'capacity' AS chart, breach, perf, copies, state_code, "rows" FROM t JOIN g USING (instance_guid)""")
