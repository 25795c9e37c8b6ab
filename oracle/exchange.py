"""Statements for exchange and the streams."""

from . import policy  # noqa: F401
from .charts import RATE
from .common import ORACLE, clean, iso, sql, ts

sql("read_collected", "command_log", f"""
SELECT instance_guid, database_name, command_type, {ts('start_time')} AS start_time, error_number, 'logcommand' AS dataset FROM command_log""")
sql("read_collected_xml", "command_log", f"""
SELECT instance_guid, database_name, command_type, {ts('start_time')} AS start_time, error_number, 'logcommand' AS dataset, 0 AS broken_records FROM command_log
UNION ALL SELECT 'torn', NULL, NULL, NULL, NULL, 'logcommand', 1""")
sql("write_dataset", "job_activity", """
SELECT '[' || instance_guid || ']_logjobactivity_20010802000000' AS "drop", count(*) AS "rows" FROM job_activity GROUP BY 1""")
sql("route_by_dataset", "file_names", """
SELECT *, CASE WHEN name ILIKE '%\\_log\\_backup\\_%' ESCAPE '\\' THEN 'backup' WHEN name ILIKE '%\\_log\\_job\\_%' ESCAPE '\\' THEN 'job' WHEN name ILIKE '%\\_fact\\_%' ESCAPE '\\' THEN 'fact' END AS target FROM file_names""")
sql("shred_events_xml", "raw_events", f"""
SELECT instance_guid, event_id, {ts("CAST(regexp_extract(event_xml, 'timestamp=\"([^\"]*)Z\"', 1) AS TIMESTAMP)")} AS event_ts, regexp_extract(event_xml, 'Login failed for user ''([^'']*)''', 1) AS login_name,
  '0x0000001c' AS destination_code FROM raw_events WHERE event_xml LIKE '%<value>0x0000001c</value>%'""")

_E = """, e AS (SELECT *, time_bucket(INTERVAL {slide}, event_ts, TIMESTAMP '1970-01-01') AS b FROM login_events WHERE destination_code = '0x0000001c'),
wm AS (SELECT date_trunc('milliseconds', max(event_ts)) - INTERVAL 10 MINUTE AS t FROM e),
w AS (SELECT e.instance_guid, login_name, b - k * INTERVAL {slide} AS s FROM e, range({n}) r(k)),
c AS (SELECT instance_guid, login_name, s, s + INTERVAL {width} AS x, count(*) AS n FROM w GROUP BY 1, 2, 3)
SELECT instance_guid, login_name, {s} AS window_start, {x} AS window_end, n AS "count", CASE WHEN n >= {limit} THEN 'WARNING' ELSE 'OK' END AS state FROM c, wm WHERE x <= wm.t"""
sql("stream_login_failures", "login_events", _E.format(slide="5 MINUTE", n=12, width="60 MINUTE", s=ts("s"), x=ts("x"), limit=2))
sql("stream_login_failures_minute", "login_events", _E.format(slide="1 MINUTE", n=1, width="1 MINUTE", s=ts("s"), x=ts("x"), limit=1))
sql("stream_dedupe_events", "login_events", f" SELECT DISTINCT instance_guid, event_id, {ts('event_ts')} AS event_ts, login_name FROM login_events")
sql("stream_extract", "backup_history", f"""
SELECT * REPLACE ({ts('backup_start_date')} AS backup_start_date, {ts('backup_finish_date')} AS backup_finish_date) FROM backup_history""")
sql("stream_counter_rate", "counter_samples", RATE + f"""
SELECT * EXCLUDE (hundredths) REPLACE ({ts('sample_ts')} AS sample_ts), hundredths / 100 AS val FROM rate""")
# as the batch pairs, over the slices the watermark has passed; a header left alone for an hour by then ends
_CLOSED = """, wm AS (SELECT date_trunc('milliseconds', max(log_date)) - INTERVAL 10 MINUTE AS t FROM error_log),
e AS (SELECT l.* FROM error_log l, wm WHERE date_trunc('minute', log_date) + INTERVAL 1 MINUTE <= wm.t),
n AS (SELECT *, lead(message) OVER w AS nxt, lead(seq) OVER w AS ns FROM e WINDOW w AS (PARTITION BY instance_guid ORDER BY log_date, source, seq)),
h AS (SELECT n.*, CAST(regexp_extract(message, '^Error: ([0-9]+),', 1) AS INT) AS mid FROM n, wm
      WHERE message LIKE 'Error:%Severity:%State:%' AND (ns IS NOT NULL OR log_date + INTERVAL 1 HOUR <= wm.t))"""
for _name, _text in (("stream_error_pairs", "nxt"), ("stream_error_pairs_sanitized", "m.text")):
    sql(_name, "error_log messages", _CLOSED + f"""
SELECT instance_guid, {iso('log_date')} AS log_date, CASE WHEN source LIKE 'spid%' THEN 'spid' ELSE source END AS source, message AS message_header,
  {clean(_text)} AS message, ns IS NOT NULL AS complete
FROM h JOIN messages m ON m.message_id = h.mid""")
sql("stream_login_totals", "login_events policy_login", f"""
, f AS (SELECT * FROM login_events WHERE destination_code = '0x0000001c'),
clock AS (SELECT date_trunc('minute', max(event_ts)) + INTERVAL 1 MINUTE AS t FROM f),
d AS (SELECT * FROM policy_login WHERE name = '_default'),
w AS (SELECT f.instance_guid, p.name, t, event_ts, p.failed_login_threshold AS own_limit, p.monitoring_period_minutes AS own_period, p.login_failure_alert AS own_alert,
        d.failed_login_threshold AS dt, d.monitoring_period_minutes AS dp, d.login_failure_alert AS da
      FROM f CROSS JOIN clock JOIN d USING (instance_guid)
        LEFT JOIN policy_login p ON p.instance_guid = f.instance_guid AND lower(p.name) = lower(f.login_name) AND p.name <> '_default'
      WHERE coalesce(p.failed_login_threshold, d.failed_login_threshold) <> 0 AND coalesce(p.monitoring_period_minutes, d.monitoring_period_minutes) <> 0),
a AS (SELECT instance_guid, '_Total' AS name, count(*) AS n, dt AS lim, dp AS per, da AS alert, t FROM w WHERE event_ts >= t - dp * INTERVAL 1 MINUTE GROUP BY ALL
      UNION ALL SELECT instance_guid, name, count(*), own_limit, own_period, own_alert, t FROM w WHERE name IS NOT NULL AND event_ts >= t - own_period * INTERVAL 1 MINUTE GROUP BY ALL)
SELECT instance_guid, name, n AS "count", lim AS failed_login_threshold, per AS monitoring_period_minutes,
  CASE WHEN n >= lim THEN alert ELSE 'OK' END AS state, {ts('t')} AS as_of FROM a""")
ORACLE["stream_eav_upsert"] = ORACLE["eav_upsert"]
sql("stream_alert_transitions", "check_results", f"""
, n AS (SELECT *, lag(state) OVER (PARTITION BY instance_guid, "check", object ORDER BY checked_at, seq) AS previous_state FROM check_results)
SELECT * REPLACE ({ts('checked_at')} AS checked_at) FROM n WHERE previous_state IS NULL OR previous_state <> state""")
