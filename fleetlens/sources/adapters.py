"""Operator inputs as projections of the base tables.

Every adapter is one SQL statement over base tables or other adapters, written
in the part of SQL that Spark and DuckDB share, so a query and the statement
that checks it start from the same rows.  `{name}` marks a table.  Values that
an estate would deliver (states, sizes, codes) are pure functions of the base
columns.  Rows that shall find no partner get a key the other side doesn't
have; no row of a base table is left out, but where a role is a type of event
(login events, base counters) or branches of a union share a table out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import TABLES, table

AS_OF = "2001-08-02 00:00:00"  # order-derived inputs
AS_OF_EVENTS = "2024-01-31 00:00:00"  # event-derived inputs

_CUST = "CONCAT('NATION_', CAST({k} % 25 AS STRING))"


def _guid(key: str) -> str:
    return _CUST.replace("{k}", key)


ADAPTERS: dict[str, str] = {
    "instances": """
        SELECT n_name AS instance_guid, r_name AS tenant,
               CONCAT('HOST', CAST(n_nationkey AS STRING)) AS machine_name,
               CASE WHEN n_regionkey = 0 THEN NULL ELSE CONCAT('INST', CAST(n_nationkey AS STRING)) END AS instance_name,
               CASE n_nationkey % 4 WHEN 0 THEN 'Enterprise Edition: Core-based Licensing (64-bit)' WHEN 1 THEN 'Standard Edition (64-bit)'
                    WHEN 2 THEN 'Express Edition (64-bit)' ELSE 'Developer Edition' END AS edition,
               CASE n_nationkey % 11 WHEN 0 THEN '16.0.1000.6' WHEN 1 THEN '15.0.2000.5' WHEN 2 THEN '14.0.1000.169' WHEN 3 THEN '13.0.5026.0'
                    WHEN 4 THEN '12.0.6024.0' WHEN 5 THEN '11.0.7001.0' WHEN 6 THEN '10.50.6000.34' WHEN 7 THEN '10.0.6000.29'
                    WHEN 8 THEN '9.0.5000.0' WHEN 9 THEN '8.00.2039' ELSE '17.0.1.1' END AS product_version,
               CASE WHEN n_nationkey % 2 = 0 THEN 'RTM' ELSE 'SP2' END AS product_level,
               CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CONCAT('CU', CAST(n_nationkey AS STRING)) END AS product_update_level,
               CASE WHEN n_nationkey % 5 = 0 THEN 'GDR' ELSE NULL END AS product_build_type
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "databases": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, CAST(c_custkey AS INT) AS database_id, c_name AS name,
               CAST(c_custkey % 7 AS INT) AS state,
               CASE c_custkey % 7 WHEN 0 THEN 'ONLINE' WHEN 1 THEN 'RESTORING' WHEN 2 THEN 'RECOVERING' WHEN 3 THEN 'RECOVERY_PENDING'
                    WHEN 4 THEN 'SUSPECT' WHEN 5 THEN 'EMERGENCY' ELSE 'OFFLINE' END AS state_desc,
               TIMESTAMP '1996-01-01 00:00:00' + (c_custkey % 2000) * INTERVAL '1' DAY AS create_date,
               c_custkey % 5 = 0 AS is_read_only, c_custkey % 11 = 0 AS is_in_standby,
               CASE WHEN c_custkey % 29 = 28 THEN CAST(c_custkey - 1 AS INT) ELSE NULL END AS source_database_id,
               CASE c_custkey % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'SIMPLE' ELSE 'BULK_LOGGED' END AS recovery_model_desc,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Latin1_General_CI_AS' END AS collation_name,
               CAST(100 + 10 * (c_custkey % 7) AS INT) AS compatibility_level,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE CONCAT('owner_', c_mktsegment) END AS owner
        FROM {{customer}}""",
    "policy_database": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, CAST(c_custkey AS INT) AS database_id, c_name AS db_name,
               20 AS capacity_warning_percent_free, 10 AS capacity_critical_percent_free,
               CASE c_custkey % 3 WHEN 0 THEN 'PRINCIPAL' WHEN 1 THEN 'MIRROR' ELSE NULL END AS mirroring_role,
               CAST(24 * (c_custkey % 90) AS INT) AS backup_frequency_hours,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CRITICAL' ELSE 'WARNING' END AS backup_state_alert,
               CAST(170 * (c_custkey % 31) AS INT) AS checkdb_frequency_hours,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'CRITICAL' ELSE 'WARNING' END AS checkdb_state_alert,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN 'WARNING' ELSE 'CRITICAL' END AS change_state_alert,
               c_custkey % 13 <> 0 AS is_enabled
        FROM {{customer}}""",
    "policy_job": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS job_id, CONCAT('job ', CAST(c_custkey AS STRING)) AS job_name,
               CAST(c_custkey % 9 * 100000 AS INT) AS max_exec_time_min,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CRITICAL' ELSE 'WARNING' END AS change_state_alert,
               c_custkey % 8 <> 0 AS is_enabled
        FROM {{customer}}""",
    "backup_history": f"""
        SELECT {_guid('o_custkey')} AS instance_guid,
               CONCAT('Customer#', LPAD(CAST(o_custkey AS STRING), 9, '0')) AS database_name,
               CASE WHEN o_custkey % 10 = 3 THEN 'L' WHEN o_orderstatus = 'F' THEN 'D' WHEN o_orderstatus = 'P' THEN 'I' ELSE 'L' END AS type,
               o_orderkey % 17 = 0 AS is_copy_only,
               o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR - INTERVAL '30' MINUTE AS backup_start_date,
               o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS backup_finish_date,
               CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS backup_size, CAST(FLOOR(o_totalprice * 400) AS BIGINT) AS compressed_backup_size,
               CONCAT('user ', o_orderpriority) AS user_name, 'Backup Agent' AS software_name,
               CONCAT('E:/backup/', CAST(o_orderkey AS STRING), '.bak') AS physical_device_name,
               CASE WHEN o_orderkey % 4 = 0 THEN 'CERTIFICATE' ELSE NULL END AS encryptor_type,
               o_orderkey % 9 = 0 AS is_password_protected, o_orderkey AS backup_set_id
        FROM {{orders}}""",
    "job_history": f"""
        SELECT o_orderkey AS instance_id, {_guid('o_custkey')} AS instance_guid, o_custkey AS job_id,
               CONCAT('job ', CAST(o_custkey AS STRING)) AS job_name, CAST(o_orderkey % 4 AS INT) AS step_id,
               CONCAT('step "', CAST(o_orderkey % 4 AS STRING), '"') AS step_name, CAST(o_orderkey % 3000 AS INT) AS sql_message_id,
               CONCAT('Executed as  user ', o_orderpriority, CHR(10), 'line "two",','"three"', CHR(13)) AS message,
               CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 1 END AS run_status,
               CAST(YEAR(o_orderdate) * 10000 + MONTH(o_orderdate) * 100 + DAY(o_orderdate) AS INT) AS run_date,
               CAST(o_orderkey % 24 * 10000 + o_orderkey % 60 * 100 + o_orderkey % 59 AS INT) AS run_time,
               CAST(o_orderkey % 30 * 10000 + o_orderkey % 60 * 100 + o_orderkey % 53 AS INT) AS run_duration
        FROM {{orders}}""",
    "job_activity": f"""
        SELECT {_guid('l_partkey')} AS instance_guid, l_partkey AS job_id, CONCAT('job ', CAST(l_partkey AS STRING)) AS job_name,
               l_shipdate AS start_execution_date,
               CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_shipdate + INTERVAL '2' HOUR END AS stop_execution_date
        FROM {{lineitem}}""",
    "login_events": f"""
        SELECT {_guid('user_id')} AS instance_guid, event_id, ts AS event_ts, CONCAT('user_', CAST(user_id AS STRING)) AS login_name,
               '0x0000001c' AS destination_code
        FROM {{events}} WHERE event_type = 'error'
        UNION ALL
        SELECT {_guid('user_id')} AS instance_guid, event_id, ts AS event_ts, CONCAT('user_', CAST(user_id AS STRING)) AS login_name,
               '0x00000002' AS destination_code
        FROM {{events}} WHERE event_type = 'error'""",
    "policy_login": f"""
        SELECT n_name AS instance_guid, '_default' AS name,
               CAST(5 + n_nationkey AS INT) AS failed_login_threshold, 7200 AS monitoring_period_minutes,
               CASE WHEN n_regionkey = 1 THEN 'CRITICAL' ELSE 'WARNING' END AS login_failure_alert
        FROM {{nation}}
        UNION ALL
        SELECT {_guid('c_custkey')} AS instance_guid, CONCAT(CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'user_' ELSE 'gone_' END, CAST(c_custkey AS STRING)) AS name,
               CAST(c_custkey % 7 AS INT) AS failed_login_threshold, CAST(20000 + c_custkey % 5 * 4000 AS INT) AS monitoring_period_minutes,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CRITICAL' ELSE 'WARNING' END AS login_failure_alert
        FROM {{customer}}""",
    "policy_replica_group": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS ag_id, CONCAT('ag ', CAST(s_suppkey AS STRING)) AS ag_name,
               CASE WHEN s_acctbal < 3000 THEN 'CRITICAL' ELSE 'WARNING' END AS ag_state_alert, s_suppkey % 5 <> 0 AS ag_state_is_enabled,
               CASE s_suppkey % 2 WHEN 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS ag_role,
               'WARNING' AS ag_role_alert, s_suppkey % 7 <> 0 AS ag_role_is_enabled,
               CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2001-07-20 00:00:00' + (s_suppkey % 12) * INTERVAL '1' DAY ELSE NULL END AS ag_role_change_datetime
        FROM {{supplier}}""",
    "replica_state": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS ag_id, CONCAT('ag ', CAST(s_suppkey AS STRING)) AS ag_name,
               CAST(s_suppkey % 4 AS INT) AS automated_backup_preference, CAST(1 + s_suppkey % 3 % 2 AS INT) AS role,
               CASE s_suppkey % 3 % 2 WHEN 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role_desc,
               CASE WHEN s_suppkey % 50 < 25 THEN 2 ELSE 1 END AS synchronization_health,
               CASE WHEN s_suppkey % 50 < 25 THEN 'HEALTHY' ELSE 'PARTIALLY_HEALTHY' END AS synchronization_health_desc,
               CASE WHEN s_suppkey % 9 = 8 THEN 0 ELSE 1 END AS connected_state,
               CASE WHEN s_suppkey % 9 = 8 THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS connected_state_desc,
               s_suppkey % 6 = 1 AS secondary_unreadable
        FROM {{supplier}}""",
    "group_databases": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, CAST(CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN c_custkey % 100 ELSE -1 - c_custkey % 100 END AS BIGINT) AS ag_id,
               CAST(CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN c_custkey ELSE -c_custkey END AS INT) AS database_id,
               CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN c_name ELSE CONCAT('gone ', c_name) END AS database_name
        FROM {{customer}}""",
    "replica_snapshots": f"""
        SELECT {_guid('l_suppkey')} AS instance_guid, l_suppkey AS ag_id, l_orderkey * 8 + l_linenumber AS seq, l_shipdate AS snapshot_ts,
               CASE WHEN MIN(l_quantity) < 25 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role
        FROM {{lineitem}} GROUP BY l_suppkey, l_orderkey, l_linenumber, l_shipdate""",
    "db_info": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CONCAT('CUSTOMER#', LPAD(CAST(o_custkey AS STRING), 9, '0')) AS database_name,
               CASE WHEN o_orderstatus = 'O' THEN 'dbi_dbccFlags' ELSE 'dbi_dbccLastKnownGood' END AS field,
               CASE WHEN o_custkey % 6 = 0 THEN TIMESTAMP '1900-01-01 00:00:00' ELSE o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR END AS value
        FROM {{orders}}""",
    "mirror_state": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, CAST(c_custkey AS INT) AS database_id, c_name AS database_name,
               CASE WHEN c_acctbal > 2500 THEN CONCAT('guid-', CAST(c_custkey AS STRING)) ELSE NULL END AS mirroring_guid,
               CAST(c_custkey % 6 AS INT) AS mirroring_state,
               CASE c_custkey % 6 WHEN 0 THEN 'suspended' WHEN 1 THEN 'disconnected' WHEN 2 THEN 'synchronizing' WHEN 3 THEN 'pending_failover'
                    WHEN 4 THEN 'synchronized' ELSE 'unsynchronized' END AS mirroring_state_desc,
               CASE c_custkey % 2 WHEN 0 THEN 'PRINCIPAL' ELSE 'MIRROR' END AS mirroring_role_desc,
               CASE c_custkey % 4 WHEN 0 THEN 'OFF' ELSE 'FULL' END AS mirroring_safety_level_desc,
               CONCAT('HOST', CAST(c_custkey % 24 AS STRING)) AS mirroring_partner_instance,
               CONCAT('TCP://HOST', CAST(c_custkey % 24 AS STRING), ':5022') AS mirroring_partner_name, '' AS mirroring_witness_name
        FROM {{customer}}""",
    "logship_primary": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, o_custkey * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS primary_id, CONCAT('HOST', CAST(o_custkey % 25 AS STRING)) AS primary_server,
               CONCAT(CASE WHEN o_orderstatus = 'F' THEN 'customer#' ELSE 'gone#' END, LPAD(CAST(o_custkey AS STRING), 9, '0')) AS primary_database, CAST(60 * 24 * (o_custkey % 200) AS INT) AS backup_threshold,
               14420 AS threshold_alert, o_custkey % 12 <> 0 AS threshold_alert_enabled, 5760 AS history_retention_period,
               MAX(o_orderdate) AS last_backup_date_utc
        FROM {{orders}} GROUP BY o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END, CASE WHEN o_orderstatus = 'F' THEN 'customer#' ELSE 'gone#' END""",
    "logship_secondary": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, o_custkey * CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END AS secondary_id, CONCAT('HOST', CAST(o_custkey % 25 AS STRING)) AS secondary_server,
               CONCAT(CASE WHEN o_orderstatus = 'P' THEN 'customer#' ELSE 'gone#' END, LPAD(CAST(o_custkey AS STRING), 9, '0')) AS secondary_database,
               CONCAT('HOST', CAST((o_custkey + 1) % 25 AS STRING)) AS primary_server, CONCAT('source]', CAST(o_custkey AS STRING)) AS primary_database,
               CAST(60 * 24 * (o_custkey % 150) AS INT) AS restore_threshold, 14421 AS threshold_alert, o_custkey % 14 <> 0 AS threshold_alert_enabled,
               5760 AS history_retention_period, MAX(o_orderdate) AS last_restored_date_utc
        FROM {{orders}} GROUP BY o_custkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END, CASE WHEN o_orderstatus = 'P' THEN 'customer#' ELSE 'gone#' END""",
    "secondary_config": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS secondary_id, CONCAT('//src/', c_mktsegment) AS backup_source_directory,
               CAST(c_custkey % 3 AS INT) AS restore_delay, c_custkey % 2 = 0 AS restore_all, CAST(c_custkey % 2 AS INT) AS restore_mode,
               c_custkey % 4 = 0 AS disconnect_users
        FROM {{customer}}""",
    "error_log": f"""
        SELECT {_guid('user_id')} AS instance_guid, ts AS log_date, event_id AS seq,
               CASE WHEN user_id % 3 = 0 THEN 'Logon' ELSE CONCAT('spid', CAST(user_id AS STRING)) END AS source,
               CASE event_type
                    WHEN 'error' THEN CONCAT('Error: ', CAST(event_id % 3000 AS STRING), ', Severity: ', CAST(event_id % 25 AS STRING), ', State: 1.')
                    WHEN 'signup' THEN CONCAT('DBCC CHECKDB (db', CAST(user_id AS STRING), ')  found ', CAST(event_id % 3 AS STRING), ' errors and repaired ',
                                              CAST(event_id % 2 AS STRING), ' errors.')
                    WHEN 'click' THEN CONCAT('Login failed, for user  u', CAST(user_id AS STRING), CHR(10), 'Reason: x')
                    WHEN 'view' THEN 'Log was backed up without errors'
                    ELSE CONCAT('Starting up database  ', CAST(user_id AS STRING), '.', CHR(13), CHR(10)) END AS message
        FROM {{events}}""",
    "messages": "SELECT CAST(p_partkey AS INT) AS message_id, CONCAT('Template for  ', p_name, ' %d.') AS text FROM {part}",
    "db_files": f"""
        SELECT {_guid('l_partkey')} AS instance_guid, CAST(l_partkey AS INT) AS database_id, CAST(l_suppkey * 8 + l_linenumber AS INT) AS file_id,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_linenumber % 4 AS INT) END AS filegroup_id,
               CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PRIMARY' WHEN 2 THEN 'DATA ONE' ELSE 'ARCHIVE' END AS filegroup_name,
               CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 3 THEN l_partkey % 2 = 0 ELSE FALSE END AS filegroup_is_readonly,
               CASE WHEN l_linenumber % 4 = 0 THEN 'LOG' ELSE 'ROWS' END AS file_type,
               CONCAT('file_', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS name,
               CONCAT(CASE l_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'E' ELSE 'F' END, ':/data/file_', CAST(l_suppkey AS STRING), '.mdf') AS physical_name,
               CAST(MAX(l_quantity) AS BIGINT) * 1000 AS size_pages, CAST(MAX(l_quantity) AS BIGINT) * (1000 - CAST(ROUND(MAX(l_discount) * 1000) AS BIGINT)) AS used_pages,
               CASE MAX(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) WHEN 2 THEN -1 WHEN 3 THEN CAST(MAX(l_quantity) AS BIGINT) * 1000 + CAST(MAX(l_quantity) AS BIGINT) * CAST(MAX(l_quantity) AS BIGINT) * 40
                    ELSE CAST(MAX(l_quantity) AS BIGINT) * 1500 END AS max_size_pages,
               CASE WHEN MAX(l_tax) < 0.02 THEN 0 WHEN MIN(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) = 1 THEN 10 + CAST(MAX(l_quantity) AS BIGINT) * 2 ELSE CAST(MAX(l_quantity) AS BIGINT) * 400 END AS growth,
               MIN(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) = 1 AS is_percent_growth
        FROM {{lineitem}} GROUP BY l_partkey, l_suppkey, l_linenumber""",
    "drives": """
        SELECT n_name AS instance_guid, 'D' AS drive, CAST(20 + n_nationkey * 4 AS DECIMAL(20,2)) AS free_mb, CAST(900000 AS DECIMAL(20,2)) AS capacity_mb FROM {nation}
        UNION ALL
        SELECT n_name, 'E', CAST(100 + n_nationkey * 10 AS DECIMAL(20,2)), CAST(800000 AS DECIMAL(20,2)) FROM {nation}
        UNION ALL
        SELECT n_name, 'F', CAST(50000 + n_nationkey AS DECIMAL(20,2)), CAST(700000 AS DECIMAL(20,2)) FROM {nation}""",
    "counter_samples": f"""
        SELECT {_guid('user_id')} AS instance_guid, event_id AS seq, ts AS sample_ts, 'SQLServer:Engine' AS object_name,
               CASE event_type WHEN 'click' THEN 'Cache Hit Ratio  ' WHEN 'view' THEN 'Requests/sec' WHEN 'signup' THEN 'Avg Wait Time (ms)'
                    WHEN 'error' THEN 'Page life expectancy' ELSE 'Percent Log Used' END AS counter_name,
               CONCAT('db', CAST(user_id AS STRING)) AS instance_name,
               CASE event_type WHEN 'click' THEN CAST(FLOOR(value * 100) AS BIGINT) WHEN 'view' THEN event_id * 20 + CAST(FLOOR(value) AS BIGINT)
                    WHEN 'signup' THEN event_id * 20 + CAST(FLOOR(value) AS BIGINT) ELSE CAST(FLOOR(value * 100) AS BIGINT) END AS cntr_value,
               CASE event_type WHEN 'click' THEN 537003264 WHEN 'view' THEN 272696576 WHEN 'signup' THEN 1073874176 ELSE 65792 END AS cntr_type,
               event_id * 1000 AS ms_ticks
        FROM {{events}}
        UNION ALL
        SELECT {_guid('user_id')}, event_id, ts, 'SQLServer:Engine',
               CASE event_type WHEN 'click' THEN 'Cache Hit Ratio Base' ELSE 'Avg Wait Time Base' END, CONCAT('db', CAST(user_id AS STRING)),
               CASE event_type WHEN 'click' THEN CAST(FLOOR(value * 200) AS BIGINT) ELSE event_id * 3 END, 1073939712, event_id * 1000
        FROM {{events}} WHERE event_type IN ('click', 'signup')""",
    "policy_counter": """
        SELECT n_name AS instance_guid, '%:Engine' AS object_name, 'Cache Hit%' AS counter_name, CAST(NULL AS STRING) AS instance_name,
               CAST(60 AS DECIMAL(20,2)) AS warning_threshold, CAST(40 AS DECIMAL(20,2)) AS critical_threshold FROM {nation}
        UNION ALL
        SELECT n_name, '%:Engine', 'requests/sec', 'db1%', CAST(10 AS DECIMAL(20,2)), CAST(20 AS DECIMAL(20,2)) FROM {nation}
        UNION ALL
        SELECT n_name, 'SQL%', CASE WHEN n_regionkey <> 2 THEN '%Wait%Time (ms)' ELSE '%Gone%Time (ms)' END, CAST(NULL AS STRING), CAST(5 AS DECIMAL(20,2)), CAST(8 AS DECIMAL(20,2)) FROM {nation}
        UNION ALL
        SELECT n_name, '%', 'Page life expectanc_', 'db_', CAST(NULL AS DECIMAL(20,2)), CAST(NULL AS DECIMAL(20,2)) FROM {nation}""",
    "saved_policy_counter": f"""
        SELECT n_name AS instance_guid, CASE WHEN n_regionkey < 3 THEN '%:Engine' ELSE '%:Gone' END AS object_name, 'Cache Hit%' AS counter_name, CAST(NULL AS STRING) AS instance_name,
               CAST(70 AS DECIMAL(20,2)) AS warning_threshold, CAST(NULL AS DECIMAL(20,2)) AS critical_threshold FROM {{nation}}
        UNION ALL
        SELECT {_guid('p_partkey')}, CASE p_size % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'OK' ELSE p_brand END, p_type, CONCAT('db', CAST(p_size AS STRING)),
               CAST(MIN(p_size) AS DECIMAL(20,2)), CASE WHEN MIN(p_size) > 45 THEN NULL ELSE CAST(MAX(p_size) + 5 AS DECIMAL(20,2)) END
        FROM {{part}} GROUP BY p_partkey % 25, {_guid('p_partkey')}, CASE p_size % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'OK' ELSE p_brand END, p_type, p_size""",
    "texts": "SELECT doc_id, text FROM {documents}",
    "logship_secondary_late": "SELECT * FROM {logship_secondary}",
    "marks": """
        SELECT n_name AS instance_guid, 'log_backup' AS dataset, CASE WHEN n_regionkey = 4 THEN NULL ELSE TIMESTAMP '1995-01-01 00:00:00' + n_nationkey * INTERVAL '1' DAY END AS last_run FROM {nation}
        UNION ALL SELECT n_name, 'log_job', TIMESTAMP '1995-01-01 00:00:00' + n_nationkey * INTERVAL '1' DAY FROM {nation}
        UNION ALL SELECT n_name, 'log_maintenance', TIMESTAMP '1995-01-01 00:00:00' + n_nationkey * INTERVAL '1' DAY FROM {nation}
        UNION ALL SELECT n_name, 'log_error', TIMESTAMP '2024-01-01 00:00:00' + n_nationkey * INTERVAL '1' HOUR FROM {nation}""",
    "stage_capacity": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CONCAT('Customer#', LPAD(CAST(o_custkey AS STRING), 9, '0')) AS database_name, '/old/file' AS physical_name,
               CONCAT('old_', CAST(o_orderkey AS STRING)) AS logical_name, 'ROWS' AS type_desc, CAST(o_orderkey % 500 AS DECIMAL(20,2)) AS used_mb,
               CAST(o_orderkey % 900 AS DECIMAL(20,2)) AS reserved_mb, 'D' AS drive, CAST(100 AS DECIMAL(20,2)) AS free_mb, CAST(900000 AS DECIMAL(20,2)) AS capacity_mb,
               CONCAT(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T00:00:00.000+00:00') AS check_date
        FROM {{orders}}""",
    "drive_free": "SELECT instance_guid, drive, free_mb FROM {drives}",
    "volume_eav": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, CONCAT('HOST/Win32_Volume/', CASE FLOOR(s_suppkey / 25) % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'E' ELSE 'F' END, ':') AS hierarchy,
               CASE WHEN s_acctbal > 0 THEN 'Capacity' ELSE 'Label' END AS property, CAST(1000000000 + s_suppkey * 7777777 AS STRING) AS value
        FROM {{supplier}}""",
    "parameters": f"""
        SELECT n_name AS instance_guid, 'DEFAULT_CAP_WARN_PERCENT' AS name, '20' AS value FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_CAP_CRIT_PERCENT', '10' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_BACKUP_FREQ', CAST(20 + n_nationkey AS STRING) FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_BACKUP_STATE', 'WARNING' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_CHECKDB_FREQ', '170' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_CHECKDB_STATE', 'WARNING' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_DB_STATE', 'CRITICAL' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_JOB_MAX_MIN', '120' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_JOB_STATE', 'WARNING' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_JOB_ENABLED', CASE WHEN n_regionkey = 0 THEN '0' ELSE '1' END FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_ALWAYSON_STATE', 'CRITICAL' FROM {{nation}}
        UNION ALL SELECT n_name, 'DEFAULT_ALWAYSON_ROLE', 'WARNING' FROM {{nation}}
        UNION ALL SELECT n_name, 'SANITIZE_DATASET', CAST(n_nationkey % 2 AS STRING) FROM {{nation}}
        UNION ALL SELECT n_name, 'TENANT_NAME', r_name FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey""",
    "old_policy_database": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CAST(CASE WHEN MIN(o_orderdate) < TIMESTAMP '1995-06-01 00:00:00' THEN o_custkey ELSE -o_custkey END AS INT) AS database_id,
               CONCAT('old name ', CAST(o_custkey AS STRING)) AS db_name, 20 AS capacity_warning_percent_free, 10 AS capacity_critical_percent_free,
               CASE o_custkey % 3 WHEN 0 THEN 'PRINCIPAL' ELSE NULL END AS mirroring_role, 26 AS backup_frequency_hours, 'WARNING' AS backup_state_alert,
               170 AS checkdb_frequency_hours, 'WARNING' AS checkdb_state_alert, 'CRITICAL' AS change_state_alert, TRUE AS is_enabled
        FROM {{orders}} GROUP BY o_custkey""",
    "old_policy_group": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, CASE WHEN s_acctbal < 2000 THEN s_suppkey ELSE -s_suppkey END AS ag_id, CONCAT('old ag ', CAST(s_suppkey AS STRING)) AS ag_name, 'WARNING' AS ag_state_alert, FALSE AS ag_state_is_enabled,
               'PRIMARY' AS ag_role, 'CRITICAL' AS ag_role_alert, TRUE AS ag_role_is_enabled, TIMESTAMP '2000-01-01 00:00:00' AS ag_role_change_datetime
        FROM {{supplier}}""",
    "old_policy_job": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CASE WHEN MIN(o_orderdate) < TIMESTAMP '1995-06-01 00:00:00' THEN o_custkey ELSE -o_custkey END AS job_id, CONCAT('old job ', CAST(o_custkey AS STRING)) AS job_name,
               120 AS max_exec_time_min, 'WARNING' AS change_state_alert, TRUE AS is_enabled
        FROM {{orders}} GROUP BY o_custkey""",
    "fact_before": """
        SELECT instance_guid, CASE WHEN database_id % 13 = 5 THEN -database_id ELSE database_id END AS database_id, name, state_desc, collation_name, compatibility_level
        FROM {databases}""",
    "fact_after": """
        SELECT instance_guid, database_id, name, CASE WHEN database_id % 11 = 2 THEN 'ONLINE' ELSE state_desc END AS state_desc,
               CASE WHEN database_id % 17 = 3 THEN NULL ELSE collation_name END AS collation_name, compatibility_level
        FROM {databases}""",
    "live_databases": """
        SELECT instance_guid, CASE WHEN owner IS NOT NULL THEN database_id ELSE -database_id END AS database_id,
               CASE WHEN owner IS NOT NULL THEN name ELSE CONCAT('gone ', name) END AS name, state, state_desc, create_date, is_read_only, is_in_standby,
               source_database_id, recovery_model_desc, collation_name, compatibility_level, owner
        FROM {databases}""",
    "jobs": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS job_id, CONCAT('job ', CAST(c_custkey AS STRING)) AS job_name,
               CONCAT('login_', c_mktsegment) AS job_owner, c_custkey % 10 <> 0 AS enabled,
               CONCAT(' Runs  for ', c_mktsegment, CHR(10)) AS description,
               CAST(c_custkey % 120 AS BIGINT) AS notify_email_operator_id, CAST(c_custkey % 90 AS BIGINT) AS notify_netsend_operator_id,
               CAST(0 AS BIGINT) AS notify_page_operator_id,
               TIMESTAMP '1996-01-01 00:00:00' + (c_custkey % 2000) * INTERVAL '1' DAY AS date_created,
               TIMESTAMP '1996-01-01 00:00:00' + (c_custkey % 2000 + c_custkey % 3) * INTERVAL '1' DAY AS date_modified
        FROM {{customer}}""",
    "job_steps": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, o_custkey AS job_id, CAST(o_orderkey AS INT) AS step_id, CONCAT('step ', o_orderpriority) AS step_name,
               CASE o_orderstatus WHEN 'F' THEN 'TSQL' ELSE 'CmdExec' END AS subsystem, 'db' AS database_name, 'dbo' AS database_user_name,
               CAST(o_orderkey % 40 AS BIGINT) AS proxy_id, CONCAT('EXEC p', CAST(o_orderkey AS STRING)) AS command
        FROM {{orders}}""",
    "proxies": f"""
        SELECT i.instance_guid, s_suppkey AS proxy_id, CONCAT('proxy ', s_name) AS name, CONCAT('cred ', CAST(s_nationkey AS STRING)) AS credential,
               CONCAT('DOM/', s_name) AS credential_identity
        FROM {{supplier}} JOIN (SELECT n_name AS instance_guid, n_nationkey FROM {{nation}}) i ON i.n_nationkey = s_suppkey % 25""",
    "operators": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS operator_id, CONCAT('op ', s_name) AS name, s_suppkey % 4 <> 0 AS enabled
        FROM {{supplier}}""",
    "schedules": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, p_partkey AS schedule_id, p_partkey % 2 = 0 AS enabled,
               CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 32 WHEN 5 THEN 64 ELSE 128 END AS freq_type,
               CASE WHEN p_partkey % 7 = 2 THEN CAST(1 + p_partkey % 127 AS INT) WHEN p_partkey % 7 = 4 THEN CAST(1 + p_partkey % 10 AS INT) ELSE CAST(1 + p_partkey % 31 AS INT) END AS freq_interval,
               CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS freq_subday_type, CAST(1 + p_partkey % 3 AS INT) AS freq_subday_interval,
               CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS freq_relative_interval,
               CAST(1 + p_partkey % 3 AS INT) AS freq_recurrence_factor, 20010115 AS active_start_date,
               CAST(p_partkey % 24 * 10000 + p_partkey % 60 * 100 AS INT) AS active_start_time, CAST((p_partkey + 7) % 24 * 10000 + p_partkey % 59 * 100 AS INT) AS active_end_time
        FROM {{part}}""",
    "job_schedules": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey ELSE -c_custkey END AS job_id, CAST(c_custkey % 200 AS BIGINT) AS schedule_id
        FROM {{customer}}""",
    "service_eav": f"""
        SELECT {_guid('user_id')} AS instance_guid, event_id AS seq,
               CASE WHEN user_id % 7 = 0 THEN CONCAT('H/Win32_GroupUser/Local_Admins/', CAST(user_id AS STRING)) ELSE CONCAT('H/', CAST(user_id AS STRING)) END AS hierarchy,
               event_type AS property, REGEXP_EXTRACT(props, '[0-9]+', 0) AS value, ts AS lastseen
        FROM {{events}}""",
    "sessions": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, TIMESTAMP '1998-06-01 00:00:00' AS snapshot_ts, o_custkey AS session_id, 0 AS request_id,
               CASE WHEN o_custkey < 25 THEN NULL ELSE CAST(FLOOR(FLOOR(o_custkey / 25) / 2) AS BIGINT) * 25 + o_custkey % 25 END AS blocking_session_id,
               CASE o_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'sleeping' ELSE 'suspended' END AS status,
               CONCAT('login', CAST(o_custkey % 40 AS STRING)) AS login_name, CONCAT('HOST', CAST(o_custkey % 30 AS STRING)) AS host_name,
               CONCAT('app_', CAST(o_custkey % 12 AS STRING)) AS program_name, CONCAT('db', CAST(o_custkey % 60 AS STRING)) AS database_name,
               CAST(o_custkey % 2 AS INT) AS open_tran_count, o_custkey % 17 <> 0 AS is_user_process, MIN(o_orderdate) AS start_time,
               CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '1998-06-01 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS reads,
               CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '1998-06-01 00:00:00' THEN 2 ELSE 0 END) AS BIGINT) AS writes,
               CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '1998-06-01 00:00:00' THEN o_orderkey ELSE 0 END) AS BIGINT) AS cpu,
               CAST(o_custkey % 9 AS BIGINT) AS tempdb_allocations, CAST(o_custkey % 90 AS BIGINT) AS used_memory,
               CAST(o_custkey % 70 AS BIGINT) AS physical_io, CAST(MIN(o_orderkey) % 50 AS BIGINT) AS physical_reads, CAST(o_custkey % 7 AS BIGINT) AS tempdb_current,
               CAST(MIN(o_orderkey) % 1000 AS BIGINT) AS context_switches, CAST(o_custkey % 95 AS BIGINT) AS max_used_memory
        FROM {{orders}} GROUP BY o_custkey
        UNION ALL
        SELECT {_guid('o_custkey')}, TIMESTAMP '2000-06-01 00:00:00', o_custkey, 0,
               CASE WHEN o_custkey < 25 THEN NULL ELSE CAST(FLOOR(FLOOR(o_custkey / 25) / 3) AS BIGINT) * 25 + o_custkey % 25 END,
               CASE o_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'sleeping' ELSE 'suspended' END,
               CONCAT('login', CAST(o_custkey % 40 AS STRING)), CONCAT('HOST', CAST(o_custkey % 30 AS STRING)),
               CONCAT('app_', CAST(o_custkey % 12 AS STRING)), CONCAT('db', CAST(o_custkey % 60 AS STRING)),
               CAST(o_custkey % 2 AS INT), o_custkey % 17 <> 0, CASE WHEN o_custkey % 5 = 0 THEN MAX(o_orderdate) ELSE MIN(o_orderdate) END,
               CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '2000-06-01 00:00:00' THEN 1 ELSE 0 END) AS BIGINT),
               CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '2000-06-01 00:00:00' THEN 2 ELSE 0 END) AS BIGINT),
               CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '2000-06-01 00:00:00' THEN o_orderkey ELSE 0 END) AS BIGINT),
               CAST(o_custkey % 8 AS BIGINT), CAST(o_custkey % 80 AS BIGINT), CAST(o_custkey % 90 AS BIGINT), CAST(MAX(o_orderkey) % 50 AS BIGINT),
               CAST(o_custkey % 5 AS BIGINT), CAST(MAX(o_orderkey) % 2000 AS BIGINT), CAST(o_custkey % 95 AS BIGINT)
        FROM {{orders}} GROUP BY o_custkey""",
    "waits": f"""
        SELECT {_guid('l_partkey')} AS instance_guid, CASE WHEN l_linenumber % 3 = 0 THEN TIMESTAMP '2000-06-01 00:00:00' ELSE TIMESTAMP '1998-06-01 00:00:00' END AS snapshot_ts,
               l_partkey AS session_id, CAST(l_linenumber % 2 AS INT) AS request_id,
               CASE WHEN l_tax < 0.01 THEN 'RUNNABLE' WHEN l_returnflag = 'A' THEN 'LCK_M_X' WHEN l_returnflag = 'N' THEN 'PAGEIOLATCH_SH' ELSE 'CXPACKET' END AS wait_type,
               CAST(l_quantity AS BIGINT) * 10 AS wait_ms,
               CASE WHEN l_returnflag = 'A' AND l_quantity > 40 THEN l_suppkey ELSE NULL END AS blocking_session_id
        FROM {{lineitem}}""",
    "locks": f"""
        SELECT {_guid('l_suppkey')} AS instance_guid, CASE WHEN l_linenumber % 3 = 0 THEN TIMESTAMP '2000-06-01 00:00:00' ELSE TIMESTAMP '1998-06-01 00:00:00' END AS snapshot_ts,
               l_suppkey AS session_id, 0 AS request_id, CONCAT('db', CAST(l_suppkey % 20 AS STRING)) AS database_name,
               CASE WHEN l_tax < 0.02 THEN 'DATABASE' ELSE 'OBJECT' END AS resource_type,
               CASE WHEN l_tax < 0.02 THEN NULL ELSE CONCAT('t', CAST(l_partkey % 50 AS STRING)) END AS object_name, 'dbo' AS schema_name,
               CASE l_returnflag WHEN 'A' THEN 'X' WHEN 'N' THEN 'S' ELSE 'IX' END AS request_mode, CASE l_linestatus WHEN 'O' THEN 'WAIT' ELSE 'GRANT' END AS request_status
        FROM {{lineitem}}""",
    "tran_log": f"""
        SELECT {_guid('l_orderkey')} AS instance_guid, CASE WHEN l_linenumber % 3 = 0 THEN TIMESTAMP '2000-06-01 00:00:00' ELSE TIMESTAMP '1998-06-01 00:00:00' END AS snapshot_ts,
               l_orderkey AS transaction_id, CAST(l_orderkey % 500 AS BIGINT) AS session_id, 0 AS request_id,
               CONCAT('db', CAST(l_suppkey % 20 AS STRING)) AS database_name, CAST(l_quantity AS BIGINT) AS log_records,
               CAST(FLOOR(l_extendedprice) AS BIGINT) AS log_bytes, l_shipdate AS begin_time,
               CASE l_returnflag WHEN 'A' THEN 'implicit_transaction' ELSE 'user_transaction' END AS name
        FROM {{lineitem}}""",
    "statement_stats": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CAST(o_custkey % 60 AS BIGINT) AS statement_id, COUNT(*) AS execution_count,
               CAST(SUM(o_orderkey) AS BIGINT) AS total_elapsed_ms
        FROM {{orders}} GROUP BY {_guid('o_custkey')}, o_custkey % 60""",
    "requests": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, o_orderkey AS request_id, o_custkey AS session_id, CAST(o_orderkey % 900 AS BIGINT) AS connection_id,
               CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'P' THEN 'Background' ELSE 'suspended' END AS status, 'SELECT' AS command,
               o_orderdate AS start_time, CAST(FLOOR(o_totalprice) AS BIGINT) AS total_elapsed_time, CAST(o_orderkey % 8 AS INT) AS transaction_isolation_level,
               CAST(o_custkey % 60 AS BIGINT) AS statement_id, CAST(2 * (1 + o_orderkey % 5) AS INT) AS statement_start_offset,
               CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 30 END AS INT) AS statement_end_offset,
               CONCAT('SELECT * FROM t', CAST(o_orderkey AS STRING), ' WHERE a = 1') AS text
        FROM {{orders}}""",
    "session_info": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS session_id, c_mktsegment AS host_name, c_name AS login_name,
               CASE WHEN c_acctbal < 1000 THEN 'sa_user' ELSE c_name END AS original_login_name, CONCAT('app_', CAST(c_custkey % 12 AS STRING)) AS program_name
        FROM {{customer}}""",
    "connections": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS connection_id, CONCAT('10.0.0.', CAST(s_suppkey AS STRING)) AS client_net_address
        FROM {{supplier}}""",
    "principals": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS principal_id, CASE c_custkey WHEN 1 THEN 'sa' WHEN 2 THEN 'BUILTIN/Users' ELSE c_name END AS name,
               CASE c_custkey % 5 WHEN 0 THEN 'SQL_LOGIN' WHEN 1 THEN 'WINDOWS_LOGIN' WHEN 2 THEN 'WINDOWS_GROUP' WHEN 3 THEN 'SQL_LOGIN' ELSE 'SERVER_ROLE' END AS type_desc,
               CASE WHEN c_acctbal < 100 THEN NULL ELSE CONCAT('sid', CAST(c_custkey AS STRING)) END AS sid, c_custkey < 25 AS is_builtin_admin,
               c_custkey % 6 = 0 AS is_disabled, c_custkey % 7 = 0 AS is_invalid, c_custkey % 4 <> 0 AS is_policy_checked, c_custkey % 3 <> 0 AS is_expiration_checked,
               c_custkey % 17 = 0 AS is_locked, CASE WHEN c_custkey % 17 = 0 THEN TIMESTAMP '2001-07-01 00:00:00' + (c_custkey % 30) * INTERVAL '1' DAY ELSE NULL END AS lockout_time,
               c_custkey % 19 = 0 AS is_expired, c_custkey % 23 = 0 AS is_must_change,
               TIMESTAMP '2000-01-01 00:00:00' + (c_custkey % 500) * INTERVAL '1' DAY AS password_last_set_time, CAST(c_custkey % 6 AS BIGINT) AS bad_password_count
        FROM {{customer}}""",
    "database_principals": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CONCAT('db', CAST(o_orderkey % 60 AS STRING)) AS database_name,
               CONCAT('sid', CAST(o_custkey * (1 + o_orderkey % 2 * 24) AS STRING)) AS sid, CONCAT('user_', CAST(o_custkey AS STRING)) AS user_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'db_owner' WHEN '2-HIGH' THEN 'db_datareader' ELSE 'db_datawriter' END AS role_name
        FROM {{orders}} GROUP BY o_custkey, o_orderkey % 60, o_orderkey % 2, o_orderpriority""",
    "database_role_members": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CONCAT('db', CAST(o_orderkey % 60 AS STRING)) AS database_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'db_owner' WHEN '2-HIGH' THEN 'nested_1' WHEN '3-MEDIUM' THEN 'nested_2' WHEN '5-LOW' THEN 'nested_3' ELSE 'db_datareader' END AS member_role,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'nested_1' WHEN '2-HIGH' THEN 'nested_2' WHEN '3-MEDIUM' THEN 'nested_3' WHEN '5-LOW' THEN 'nested_4' ELSE 'nested_2' END AS role_name
        FROM {{orders}} WHERE o_custkey % 2 = 0 GROUP BY {_guid('o_custkey')}, o_orderkey % 60, o_orderpriority""",
    "permissions": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, o_custkey AS principal_id, CASE o_orderstatus WHEN 'F' THEN 'GRANT' WHEN 'P' THEN 'DENY' ELSE 'GRANT_WITH_GRANT_OPTION' END AS state_desc,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'VIEW ANY DATABASE' WHEN '2-HIGH' THEN 'CONNECT' WHEN '3-MEDIUM' THEN 'CONTROL SERVER' ELSE 'IMPERSONATE' END AS permission_name,
               CASE WHEN o_orderkey % 2 = 0 THEN 'SERVER' ELSE 'ENDPOINT' END AS class_desc, CAST(o_orderkey % 7 AS INT) AS major_id,
               CASE WHEN o_custkey < 250 THEN 'public' ELSE CONCAT('grantee_', CAST(o_custkey AS STRING)) END AS grantee, CONCAT('grantor_', CAST(o_custkey % 5 AS STRING)) AS grantor
        FROM {{orders}} GROUP BY o_custkey, o_orderstatus, o_orderpriority, o_orderkey % 2, o_orderkey % 7""",
    "role_members": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS member_id, CAST(FLOOR(FLOOR(c_custkey / 25) / 3) AS BIGINT) * 25 + c_custkey % 25 AS role_id
        FROM {{customer}}""",
    "server_role_members": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, o_custkey AS principal_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'sysadmin' WHEN '2-HIGH' THEN 'securityadmin' ELSE 'public' END AS role_name
        FROM {{orders}} GROUP BY o_custkey, o_orderpriority""",
    "group_members": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END AS principal_id, CONCAT('member ', CAST(o_orderkey AS STRING)) AS account_name
        FROM {{orders}}""",
    "instance_options": f"""
        SELECT {_guid('o_custkey')} AS instance_guid,
               CASE o_orderkey % 10 WHEN 0 THEN 'Ad Hoc Distributed Queries' WHEN 1 THEN 'clr enabled' WHEN 2 THEN 'cross db ownership chaining' WHEN 3 THEN 'Database Mail XPs'
                    WHEN 4 THEN 'Ole Automation Procedures' WHEN 5 THEN 'remote access' WHEN 6 THEN 'remote admin connections' WHEN 7 THEN 'scan for startup procs'
                    WHEN 8 THEN 'clr strict security' ELSE 'default trace enabled' END AS name,
               CAST(FLOOR(MAX(o_orderkey) / 10) % 2 AS INT) AS value_in_use
        FROM {{orders}} GROUP BY o_custkey % 25, o_orderkey % 10""",
    "instance_properties": f"""
        SELECT {_guid('o_custkey')} AS instance_guid,
               CASE o_orderkey % 10 WHEN 9 THEN 'HOST/SQLService/SQLBrowser' ELSE 'SqlServiceInstanceProperty/MSSQLSERVER' END AS hierarchy,
               CASE o_orderkey % 10 WHEN 0 THEN 'Shared Memory' WHEN 1 THEN 'TcpPort' WHEN 2 THEN 'HideInstance' WHEN 3 THEN 'IsIntegratedSecurityOnly' WHEN 4 THEN 'NumErrorLogs'
                    WHEN 5 THEN 'audit level' WHEN 6 THEN 'LicenseType' WHEN 7 THEN 'ProcessID' WHEN 8 THEN 'Collation' ELSE 'StartMode' END AS property,
               CASE o_orderkey % 10 WHEN 0 THEN CASE WHEN FLOOR(MAX(o_orderkey) / 10) % 2 = 0 THEN 'True' ELSE 'False' END
                    WHEN 1 THEN CASE WHEN FLOOR(MAX(o_orderkey) / 10) % 2 = 0 THEN '1433' ELSE '50123' END
                    WHEN 2 THEN CASE WHEN FLOOR(MAX(o_orderkey) / 10) % 2 = 0 THEN 'True' ELSE 'False' END
                    WHEN 3 THEN CASE WHEN FLOOR(MAX(o_orderkey) / 10) % 2 = 0 THEN '0' ELSE '1' END
                    WHEN 4 THEN CASE WHEN FLOOR(MAX(o_orderkey) / 10) % 2 = 0 THEN '6' ELSE '12' END
                    WHEN 5 THEN CASE WHEN FLOOR(MAX(o_orderkey) / 10) % 2 = 0 THEN 'failure' ELSE 'none' END
                    WHEN 9 THEN CASE WHEN FLOOR(MAX(o_orderkey) / 10) % 2 = 0 THEN '4' ELSE '2' END
                    ELSE 'x' END AS value
        FROM {{orders}} GROUP BY o_custkey % 25, o_orderkey % 10, CASE WHEN o_orderkey % 10 IN (1, 5, 9) THEN FLOOR(o_orderkey / 10) % 2 ELSE 0 END""",
    "trace_flags": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, CAST(1000 + p_partkey AS INT) AS flag, p_size > 25 AS enabled, p_partkey % 3 <> 0 AS is_global
        FROM {{part}}""",
    "service_accounts": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid,
               CASE s_suppkey % 4 WHEN 0 THEN 'H/SQLService/MSSQLSERVER' WHEN 1 THEN 'H/SQLService/SQLSERVERAGENT' WHEN 2 THEN 'H/SQLService/MSSQLFDLauncher'
                    ELSE 'H/Other/Service' END AS hierarchy, 'StartName' AS property, CONCAT('DOM', CAST(s_nationkey % 3 AS STRING), CHR(92), 'svc', CAST(s_suppkey % 40 AS STRING)) AS value
        FROM {{supplier}}
        UNION ALL
        SELECT {_guid('c_custkey')} AS instance_guid, 'H/Win32_GroupUser/Local_Admins' AS hierarchy, CONCAT('Win32_Account.Name="svc', CAST(c_custkey % 50 AS STRING), '"') AS property,
               CONCAT('Domain="DOM', CAST(c_nationkey % 3 AS STRING), '"') AS value
        FROM {{customer}} GROUP BY c_custkey % 25, c_custkey % 50, c_nationkey % 3, {_guid('c_custkey')}""",
    "database_security": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CAST(o_custkey % 20 AS INT) AS database_id,
               CASE o_custkey % 20 WHEN 1 THEN 'master' WHEN 2 THEN 'tempdb' WHEN 3 THEN 'model' WHEN 4 THEN 'msdb' ELSE CONCAT('db', CAST(o_custkey % 20 AS STRING)) END AS database_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'orphan' WHEN '2-HIGH' THEN 'permission' WHEN '3-MEDIUM' THEN 'principal' WHEN '4-NOT SPECIFIED' THEN 'asymmetric' ELSE 'symmetric' END AS kind,
               CASE WHEN o_orderkey % 3 = 0 THEN 'guest' ELSE CONCAT('n', CAST(o_orderkey AS STRING)) END AS name,
               CASE o_orderkey % 4 WHEN 0 THEN 'CONNECT' ELSE 'SELECT' END AS permission_name, CASE o_orderkey % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'U' ELSE 'R' END AS principal_type,
               CAST(o_orderkey % 4 AS INT) AS authentication_type, CAST(1024 * (1 + o_orderkey % 3) AS INT) AS key_length,
               CASE o_orderkey % 6 WHEN 0 THEN 'AES_256' WHEN 1 THEN 'AES_128' WHEN 2 THEN 'DES' ELSE 'TRIPLE_DES' END AS algorithm_desc
        FROM {{orders}}""",
    "database_flags": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, CAST(c_custkey AS INT) AS database_id, c_name AS name, CAST(c_custkey % 7 AS INT) AS state,
               c_acctbal < 1500 AS is_trustworthy_on, CAST(c_custkey % 2 AS INT) AS containment, c_acctbal > 9900 AS is_auto_close_on
        FROM {{customer}}""",
    "assemblies": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, p_name AS name, p_partkey % 2 = 0 AS is_user_defined,
               CASE WHEN p_size > 48 THEN 'UNSAFE_ACCESS' ELSE 'SAFE_ACCESS' END AS permission_set_desc
        FROM {{part}}""",
    "audit_actions": f"""
        SELECT {_guid('l_suppkey')} AS instance_guid, CONCAT('audit ', CAST(l_suppkey % 3 AS STRING)) AS audit_name,
               CASE l_linenumber WHEN 1 THEN 'CNAU' WHEN 2 THEN 'LGFL' WHEN 3 THEN 'LGSD' ELSE 'DBCC' END AS audit_action_id,
               l_linestatus = 'O' AS specification_enabled, l_suppkey % 2 = 0 AS audit_enabled
        FROM {{lineitem}} GROUP BY l_suppkey, l_linenumber, l_linestatus""",
    "proxy_grants": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_name AS proxy_name, CASE WHEN s_acctbal < 4000 THEN 'public' ELSE 'dbo' END AS grantee FROM {{supplier}}""",
    "index_stats": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, 'db' AS database_name, p_brand AS schema_name, CONCAT('t', CAST(p_partkey AS STRING)) AS object_name, p_partkey AS index_id,
               CAST(p_size * 100 AS BIGINT) AS page_count, CAST(p_partkey % 100 AS DOUBLE) AS fragmentation, CAST(p_retailprice * 100 AS BIGINT) AS row_count,
               p_partkey % 997 * (p_partkey % 13) * 7 AS modification_counter, CAST(p_partkey % 8 AS INT) AS index_type, p_partkey % 10 = 0 AS on_read_only_filegroup,
               p_partkey % 4 <> 0 AS allow_page_locks, p_partkey % 3 <> 0 AS allow_online, p_partkey % 11 = 0 AS is_partition
        FROM {{part}}""",
    "db_stats": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS database_id, CASE c_custkey WHEN 7 THEN 'master' ELSE c_name END AS name,
               CASE c_custkey % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'SIMPLE' ELSE 'BULK_LOGGED' END AS recovery_model_desc,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey * 10 END AS log_lsn, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey * 7 END AS differential_base_lsn,
               c_custkey % 12 = 5 AS differential_base_is_snapshot, CAST(c_custkey % 100 * 10 AS BIGINT) AS modified_extent_pages, CAST(1000 AS BIGINT) AS allocated_extent_pages,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 70 AS DOUBLE) END AS log_mb_since_backup,
               CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE TIMESTAMP '2001-08-01 00:00:00' + (c_custkey % 24) * INTERVAL '1' HOUR END AS last_log_backup
        FROM {{customer}}""",
    "command_log": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CONCAT('Customer#', LPAD(CAST(o_custkey AS STRING), 9, '0')) AS database_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'DBCC_CHECKDB' WHEN '2-HIGH' THEN 'ALTER_INDEX' ELSE 'BACKUP_DATABASE' END AS command_type,
               o_orderdate AS start_time, o_orderdate + INTERVAL '10' MINUTE AS end_time, CASE o_orderstatus WHEN 'P' THEN 9002 ELSE 0 END AS error_number
        FROM {{orders}}""",
    "plans": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, p_partkey AS plan_id, CONCAT('plan ', p_name) AS plan_name, CONCAT(' For  ', p_type, ' ') AS description, p_brand AS owner,
               TIMESTAMP '1999-01-01 00:00:00' + (p_partkey % 500) * INTERVAL '1' DAY AS create_date
        FROM {{part}}""",
    "subplans": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, p_partkey + 1000000 AS subplan_id, p_partkey AS plan_id, 'Subplan_1' AS subplan_name, 'nightly  run' AS description,
               p_partkey AS job_id
        FROM {{part}}""",
    "plan_log": f"""
        SELECT {_guid('l_partkey')} AS instance_guid, l_partkey AS plan_id, l_partkey + 1000000 AS subplan_id, l_orderkey * 8 + l_linenumber AS task_id,
               l_shipdate AS start_time, l_shipdate + INTERVAL '5' MINUTE AS end_time, CONCAT('line one  ', l_returnflag) AS line1,
               CASE WHEN l_linenumber > 1 THEN 'line two' ELSE '' END AS line2, CASE WHEN l_linenumber > 2 THEN 'line three' ELSE '' END AS line3,
               '' AS line4, CASE WHEN l_linenumber > 4 THEN CONCAT('five', CHR(10)) ELSE '' END AS line5,
               l_linestatus = 'F' AS succeeded, CASE l_linestatus WHEN 'F' THEN 0 ELSE 208 END AS error_number,
               CASE l_linestatus WHEN 'F' THEN NULL ELSE 'Invalid  object "x","y"' END AS error_message
        FROM {{lineitem}}""",
    "restore_history": f"""
        SELECT {_guid('o_custkey')} AS instance_guid, CONCAT('CUSTOMER#', LPAD(CAST(o_custkey AS STRING), 9, '0')) AS destination_database_name, o_orderdate AS restore_date,
               CASE o_orderstatus WHEN 'F' THEN 'D' ELSE 'L' END AS restore_type
        FROM {{orders}}""",
    "report_params": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_name AS parametername, CAST(c_custkey % 400 AS STRING) AS setting, 'Database Backup Frequency (Days)' AS comments, CAST(NULL AS INT) AS status
        FROM {{customer}} WHERE c_mktsegment = 'BUILDING'
        UNION ALL
        SELECT {_guid('c_custkey')}, c_name, '1', 'Exclude from restored database report', CAST(NULL AS INT) FROM {{customer}} WHERE c_mktsegment = 'MACHINERY'
        UNION ALL
        SELECT {_guid('c_custkey')}, 'excluded_from_Monitoring_DBName', c_name, 'ignore', CAST(c_custkey % 2 AS INT) FROM {{customer}} WHERE c_mktsegment = 'AUTOMOBILE'
        UNION ALL
        SELECT {_guid('c_custkey')}, c_name, '1', 'No parameter of a report', CAST(NULL AS INT) FROM {{customer}} WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')""",
    "ag_listeners": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey END AS ag_id, s_suppkey + 500000 AS listener_id, CONCAT('lsn-', s_name) AS dns_name, 1433 AS port
        FROM {{supplier}}""",
    "ag_groups": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS ag_id, CONCAT('ag ', CAST(s_suppkey AS STRING)) AS ag_name, CAST(s_suppkey % 5 AS INT) AS failure_condition_level,
               30000 AS health_check_timeout, CASE s_suppkey % 2 WHEN 0 THEN 'primary' ELSE 'secondary' END AS automated_backup_preference
        FROM {{supplier}}""",
    "ag_replicas": f"""
        SELECT {_guid('l_suppkey')} AS instance_guid, l_suppkey AS ag_id, CONCAT('HOST', CAST(l_linenumber AS STRING)) AS replica_server_name,
               CONCAT('TCP://HOST', CAST(l_linenumber AS STRING), ':5022') AS endpoint_url, CASE l_linenumber % 2 WHEN 0 THEN 'SYNCHRONOUS_COMMIT' ELSE 'ASYNCHRONOUS_COMMIT' END AS availability_mode_desc
        FROM {{lineitem}} GROUP BY l_suppkey, l_linenumber""",
    "ag_listener_ips": f"""
        SELECT {_guid('l_suppkey')} AS instance_guid, l_suppkey + 500000 AS listener_id, CONCAT('10.1.', CAST(l_linenumber AS STRING), '.', CAST(l_suppkey % 250 AS STRING)) AS ip_address,
               '255.255.255.0' AS ip_subnet_mask
        FROM {{lineitem}} GROUP BY l_suppkey, l_linenumber""",
    "mail_profiles": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS profile_id, CONCAT('profile ', s_name) AS profile_name FROM {{supplier}}""",
    "mail_profile_accounts": f"""
        SELECT {_guid('l_suppkey')} AS instance_guid, l_suppkey AS profile_id, l_partkey * 25 + l_suppkey % 25 AS account_id, CAST(MIN(l_linenumber) AS INT) AS sequence_number
        FROM {{lineitem}} GROUP BY l_suppkey, l_partkey""",
    "mail_accounts": f"""
        SELECT {_guid('l_suppkey')} AS instance_guid, l_partkey * 25 + l_suppkey % 25 AS account_id, CONCAT('account ', CAST(l_partkey AS STRING)) AS name,
               CONCAT('a', CAST(l_partkey AS STRING), '@example.org') AS email_address, 25 AS port
        FROM {{lineitem}} GROUP BY l_suppkey % 25, l_partkey""",
    "mail_principals": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, CAST(c_custkey % 100 AS BIGINT) AS profile_id, c_name AS principal_name, c_custkey % 2 = 0 AS is_default FROM {{customer}}""",
    "linked_servers": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS server_id, s_name AS name, 'SQL Server' AS product, 'SQLNCLI' AS provider,
               CONCAT('HOST', CAST(s_nationkey AS STRING)) AS data_source, s_suppkey % 6 <> 0 AS is_linked
        FROM {{supplier}}""",
    "linked_logins": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, CASE WHEN s_acctbal > 1000 THEN s_suppkey ELSE -s_suppkey END AS server_id, CAST(0 AS BIGINT) AS local_principal_id, s_suppkey % 2 = 0 AS uses_self_credential,
               CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'remote_sa' END AS remote_name
        FROM {{supplier}}
        UNION ALL
        SELECT {_guid('c_custkey')}, CAST(c_custkey % 100 AS BIGINT), c_custkey + 25, c_custkey % 2 = 0, CONCAT('remote_', CAST(c_custkey AS STRING)) FROM {{customer}}""",
    "server_triggers": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, CONCAT('trg ', p_name, ' ', CAST(p_partkey AS STRING)) AS name, p_partkey % 2 = 0 AS is_disabled,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CONCAT('CREATE TRIGGER t', CAST(p_partkey AS STRING)) END AS definition
        FROM {{part}}""",
    "publications": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, CONCAT('db', CAST(p_partkey % 40 AS STRING)) AS publication_db, p_partkey AS publication_id, p_name AS publication_name, p_type AS description,
               CAST(p_partkey % 2 AS INT) AS repl_freq, CAST(p_partkey % 5 AS INT) AS sync_method, CAST(1 + p_partkey % 3 AS INT) AS conflict_policy, CAST(p_size AS INT) AS retention,
               p_partkey % 2 = 0 AS enabled_for_internet,
               p_partkey % 3 = 0 AS immediate_sync_ready,
               p_partkey % 4 = 0 AS allow_queued_tran,
               p_partkey % 5 = 0 AS allow_sync_tran,
               p_partkey % 6 = 0 AS autogen_sync_procs,
               p_partkey % 7 = 0 AS snapshot_in_defaultfolder,
               p_partkey % 8 = 0 AS compress_snapshot,
               p_partkey % 9 = 0 AS allow_dts,
               p_partkey % 10 = 0 AS allow_anonymous,
               p_partkey % 11 = 0 AS centralized_conflicts,
               p_partkey % 12 = 0 AS independent_agent,
               p_partkey % 13 = 0 AS immediate_sync,
               p_partkey % 14 = 0 AS allow_push,
               p_partkey % 15 = 0 AS allow_pull,
               p_partkey % 16 = 0 AS allow_subscription_copy,
               p_partkey % 17 = 0 AS allow_initialize_from_backup,
               p_partkey % 18 = 0 AS replicate_ddl,
               CONCAT('share', CAST(p_size AS STRING)) AS alt_snapshot_folder, CASE WHEN p_partkey % 4 = 0 THEN CONCAT('pre', CAST(p_partkey AS STRING)) ELSE NULL END AS pre_snapshot_script,
               CASE WHEN p_partkey % 6 = 0 THEN CONCAT('post', CAST(p_partkey AS STRING)) ELSE NULL END AS post_snapshot_script, p_brand AS ftp_address, CAST(21 + p_partkey % 3 AS INT) AS ftp_port,
               CONCAT('sub', CAST(p_size AS STRING)) AS ftp_subdirectory, CONCAT('login ', CAST(p_partkey % 9 AS STRING)) AS ftp_login, CAST(p_size * 2 AS INT) AS conflict_retention, CAST(10 + p_partkey % 9 AS INT) AS backward_comp_level
        FROM {{part}}""",
    "articles": f"""
        SELECT {_guid('l_partkey')} AS instance_guid, l_partkey AS publication_id, CONCAT('article ', CAST(l_suppkey AS STRING)) AS name, 'USER_TABLE' AS article_type,
               CAST(MIN(l_linenumber) % 4 AS INT) AS pre_creation_cmd, CASE WHEN l_suppkey % 2 = 0 THEN 'dbo' ELSE 'repl' END AS dest_owner, CONCAT('t', CAST(l_suppkey AS STRING)) AS dest_object_name,
               CASE WHEN l_suppkey % 5 = 0 THEN CONCAT('id > ', CAST(l_partkey AS STRING)) ELSE NULL END AS filter_clause, CONCAT('CALL ins_', CAST(l_suppkey AS STRING)) AS ins_cmd,
               CONCAT('CALL upd_', CAST(l_suppkey AS STRING)) AS upd_cmd, CASE WHEN l_suppkey % 3 = 0 THEN 'NONE' ELSE 'CALL del' END AS del_cmd, CASE WHEN l_suppkey % 7 = 0 THEN 'gen_ins' ELSE NULL END AS ins_scripting_proc,
               CASE WHEN l_suppkey % 8 = 0 THEN 'gen_upd' ELSE NULL END AS upd_scripting_proc, CASE WHEN l_suppkey % 9 = 0 THEN 'gen_del' ELSE NULL END AS del_scripting_proc,
               CASE WHEN l_suppkey % 4 = 0 THEN 'custom' ELSE NULL END AS custom_script, l_suppkey % 6 = 0 AS fire_triggers_on_snapshot
        FROM {{lineitem}} GROUP BY l_partkey, l_suppkey""",
    "subscriptions": f"""
        SELECT {_guid('l_partkey')} AS instance_guid, l_partkey AS publication_id, CAST(l_suppkey % 3 - 1 AS INT) AS srvid, CONCAT('SRV', CAST(l_suppkey % 3 AS STRING)) AS srvname,
               CONCAT('dest', CAST(l_linenumber % 2 AS STRING)) AS dest_db, CAST(l_linenumber % 2 AS INT) AS subscription_type, CONCAT('login', CAST(l_suppkey % 2 AS STRING)) AS login_name
        FROM {{lineitem}}""",
    "replication_subscriptions": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, CONCAT('HOST', CAST(s_nationkey AS STRING)) AS publisher, CONCAT('db', CAST(s_suppkey AS STRING)) AS publisher_db, s_name AS subscriber_db,
               CONCAT('pub ', CAST(s_suppkey AS STRING)) AS publication
        FROM {{supplier}}""",
    "resource_pools": f"""
        SELECT {_guid('s_suppkey')} AS instance_guid, s_suppkey AS pool_id, CONCAT('pool ', s_name) AS name, CAST(s_suppkey % 100 AS INT) AS max_cpu_percent FROM {{supplier}}""",
    "workload_groups": f"""
        SELECT {_guid('p_partkey')} AS instance_guid, p_partkey AS group_id, CONCAT('group ', CAST(p_partkey AS STRING)) AS name, p_brand AS importance FROM {{part}}""",
    "governor_config": """
        SELECT n_name AS instance_guid, n_regionkey <> 3 AS is_enabled, CASE WHEN n_regionkey = 1 THEN NULL ELSE CONCAT('CREATE FUNCTION ', n_name) END AS classifier FROM {nation}""",
    "role_principals": f"""
        SELECT {_guid('c_custkey')} AS instance_guid, c_custkey AS principal_id, CASE WHEN FLOOR(c_custkey / 25) < 20 THEN 'R' ELSE 'S' END AS type FROM {{customer}}""",
    "file_names": f"""
        SELECT o_orderkey AS file_id, CONCAT('[NATION_', CAST(o_custkey % 25 AS STRING), ']_', CASE o_orderpriority WHEN '1-URGENT' THEN 'log_backup' WHEN '2-HIGH' THEN 'LOG_JOB'
               WHEN '3-MEDIUM' THEN 'fact_security' ELSE 'health' END, '_', CAST(CAST(o_orderdate AS DATE) AS STRING), '.xml') AS name
        FROM {{orders}}""",
    "check_results": f"""
        SELECT {_guid('user_id')} AS instance_guid, event_type AS check, CONCAT('db', CAST(user_id AS STRING)) AS object, ts AS checked_at, event_id AS seq,
               CASE WHEN value < 20 THEN 'OK' WHEN value < 60 THEN 'WARNING' ELSE 'CRITICAL' END AS state
        FROM {{events}}""",
    "raw_events": f"""
        SELECT {_guid('user_id')} AS instance_guid, event_id,
               CONCAT('<event name="error_reported" timestamp="', CAST(CAST(ts AS DATE) AS STRING), 'T00:00:', LPAD(CAST(event_id % 60 AS STRING), 2, '0'), 'Z"><data name="destination"><type name="error_destination"/><value>',
                      CASE WHEN event_id % 2 = 0 THEN '0x0000001c' ELSE '0x00000002' END,
                      '</value></data><data name="message"><value>Login failed for user ''user_', CAST(user_id AS STRING), '''. Reason: no &lt;match&gt;.</value></data></event>') AS event_xml
        FROM {{events}}""",
}

_MARK = re.compile(r"\{(\w+)\}")


def needed(name: str) -> list[str]:
    """Adapters `name` reads, itself last."""
    out: list[str] = []
    for ref in _MARK.findall(ADAPTERS[name]):
        if ref in ADAPTERS:
            out += [n for n in needed(ref) if n not in out]
    return [*out, name]


def adapt(
    spark: SparkSession, folder: str, name: str, read=table, seen: dict[str, DataFrame] | None = None
) -> DataFrame:
    """An operator input built from the base tables in `folder`.

    `seen` keeps what has been built, so a table is opened once per query.
    """
    seen = {} if seen is None else seen
    if name not in seen:
        if name in TABLES:
            seen[name] = read(spark, folder, name)
        else:
            sql = ADAPTERS[name]
            refs = {ref: adapt(spark, folder, ref, read, seen) for ref in set(_MARK.findall(sql))}
            seen[name] = spark.sql(sql, **refs)
    return seen[name]


def duckdb_ctes(*names: str) -> str:
    """The same inputs as DuckDB common table expressions."""
    order: list[str] = []
    for name in names:
        order += [n for n in needed(name) if n not in order]
    parts = [f"{n} AS ({_MARK.sub(r'\1', ADAPTERS[n])})" for n in order]
    return "WITH " + ",\n".join(parts)
