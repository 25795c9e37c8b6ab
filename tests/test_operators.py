"""Golden rows for operators with many arms, and the decisions they rest on."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetlens.operators import (
    activity, advice, charts, checks, compliance, facts, history, policy, reports,
)
from fleetlens.sources import exchange

NOW = "2024-06-01 12:00:00"


def at(text):
    return datetime.fromisoformat(text)


def instances(spark, *guids, edition="Enterprise"):
    return spark.createDataFrame(
        [(g, "T", f"M{g}", None, edition) for g in guids],
        "instance_guid string, tenant string, machine_name string, instance_name string, edition string",
    )


# ---- policy

def test_added_defaults_and_pruning_are_idempotent(spark):
    objects = spark.createDataFrame(
        [("i", 1, "A", None), ("i", 2, "TempDB", None), ("i", 3, "snap", 1)],
        "instance_guid string, database_id int, name string, source_database_id int",
    )
    params = policy.param_resolve(spark.createDataFrame(
        [("i", "DEFAULT_BACKUP_FREQ", "26"), ("i", "DEFAULT_CHECKDB_FREQ", "170")],
        "instance_guid string, name string, value string",
    ))
    empty = policy.policy_add_missing(objects, objects.limit(0).select(
        "instance_guid", "database_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("db_name", "string"), ("capacity_warning_percent_free", "int"), ("capacity_critical_percent_free", "int"),
            ("mirroring_role", "string"), ("backup_frequency_hours", "int"), ("backup_state_alert", "string"),
            ("checkdb_frequency_hours", "int"), ("checkdb_state_alert", "string"), ("change_state_alert", "string"),
            ("is_enabled", "boolean"))]), params)
    assert rows(empty, "database_id", "backup_frequency_hours", "checkdb_frequency_hours") == [(1, 26, 170), (2, 0, 0)]
    again = policy.policy_add_missing(objects, empty, params)
    assert rows(again) == rows(empty)
    left = policy.policy_prune(objects.filter("database_id <> 1"), again)
    assert rows(policy.policy_prune(objects.filter("database_id <> 1"), left)) == rows(left)


def test_unknown_kind_is_refused(spark):
    with pytest.raises(ValueError):
        policy.policy_add_missing(spark.range(1), spark.range(1), spark.range(1), kind="table")


def test_merge_matches_null_keys(spark):
    schema = "instance_guid string, name string, v int"
    target = spark.createDataFrame([("i", None, 1), ("i", "keep", 2)], schema)
    source = spark.createDataFrame([("i", None, 9), ("i", "new", 3)], schema)
    merged = policy.policy_merge(target, source, ["instance_guid", "name"], ["v"])
    assert rows(merged) == sorted([("i", None, 9), ("i", "keep", 2), ("i", "new", 3)], key=repr)


def test_role_change(spark):
    t = at("2024-01-01")
    df = spark.createDataFrame(
        [("i", 1, n, t + timedelta(days=n), r) for n, r in enumerate("PPSSP")] + [("i", 2, 0, t, "P")],
        "instance_guid string, ag_id int, seq long, snapshot_ts timestamp, role string",
    )
    assert rows(policy.role_change_stamp(df), "ag_id", "ag_role", "ag_role_change_datetime") == [
        (1, "P", t + timedelta(days=4)), (2, "P", None),
    ]


def test_eav_expiry(spark):
    schema = "instance_guid string, hierarchy string, property string, value string, lastseen timestamp, seq long"
    old = spark.createDataFrame([
        ("i", "h", "p", "old", at("2024-05-20"), 1), ("i", "h", "gone", "x", at("2024-04-30"), 2),
        ("i", "a/Win32_GroupUser/Local_Admins/b", "q", "x", at("2024-06-01T11:58:00"), 3),
        ("i", "a/Win32xGroupUser/LocalxAdmins/b", "q", "kept", at("2024-06-01T11:00:00"), 4),
    ], schema)
    new = spark.createDataFrame([("i", "h", "p", "new", at("2024-06-01T12:00:00"), 5)], schema)
    assert rows(policy.eav_upsert(old, new, as_of=NOW), "property", "value") == [("p", "new"), ("q", "kept")]


def test_retention_sign_and_zero(spark):
    df = spark.createDataFrame([(at("2024-05-31"),), (at("2024-01-01"),), (at("2024-06-01T12:00:00"),)], "ts timestamp")
    keep = policy.retention_purge(df, "ts", as_of=NOW, keep_days=92)
    assert rows(keep) == rows(policy.retention_purge(df, "ts", as_of=NOW, keep_days=-92))
    assert keep.count() == 2
    assert policy.retention_purge(df, "ts", as_of=NOW, keep_months=0).count() == 1
    with pytest.raises(ValueError):
        policy.retention_purge(df, "ts", as_of=NOW)


# ---- checks

def backup_inputs(spark, history):
    databases = spark.createDataFrame(
        [("i", n, f"db{n}", 0, False) for n in (1, 2, 3)],
        "instance_guid string, database_id int, name string, state int, is_in_standby boolean",
    )
    rules = spark.createDataFrame(
        [("i", n, f"DB{n}", 24, "CRITICAL", True) for n in (1, 2, 3)],
        "instance_guid string, database_id int, db_name string, backup_frequency_hours int, backup_state_alert string, is_enabled boolean",
    )
    hist = spark.createDataFrame(
        history, "instance_guid string, database_name string, type string, is_copy_only boolean, backup_finish_date timestamp"
    )
    return databases, hist, rules


def test_backup_keeps_never_backed_up(spark):
    databases, hist, rules = backup_inputs(spark, [
        ("i", "Db1", "D", False, at("2024-06-01")), ("i", "db1", "I", False, at("2024-06-01T06:00:00")),
        ("i", "db2", "D", True, at("2024-06-01")), ("i", "db2", "L", False, at("2024-06-01")),
        ("i", "db3", "D", False, at("2024-05-31T11:59:00")),
    ])
    out = checks.check_backup(databases, hist, rules, instances(spark, "i"), as_of=NOW)
    assert rows(out, "object", "message", "state", "state_code") == [
        ("DB1", "T,Mi#MSSQLSERVER#DB1,2024-06-01,DIFFERENTIAL", "OK", 0),
        ("DB2", "T,Mi#MSSQLSERVER#DB2,1900-01-01,UNKNOWN", "CRITICAL", 2),
        ("DB3", "T,Mi#MSSQLSERVER#DB3,2024-05-31,FULL", "CRITICAL", 2),
    ]


def test_summary_only_without_rows(spark):
    databases, hist, rules = backup_inputs(spark, [])
    out = checks.check_backup(databases, hist, rules.withColumn("is_enabled", F.lit(False)), instances(spark, "i"), as_of=NOW)
    assert rows(out, "object", "message", "state") == [(None, "0 database(s) monitored, 3 database(s) opted-out", "NA")]


def test_replicated_backup_waits_after_a_role_change(spark):
    databases, hist, rules = backup_inputs(spark, [])
    placed = spark.createDataFrame([("i", 1, 1), ("i", 2, 2)], "instance_guid string, ag_id int, database_id int")
    state = spark.createDataFrame(
        [("i", 1, 0, 1), ("i", 2, 0, 2)], "instance_guid string, ag_id int, automated_backup_preference int, role int"
    )
    changed = spark.createDataFrame(
        [("i", 1, at("2024-06-01")), ("i", 2, None)], "instance_guid string, ag_id int, ag_role_change_datetime timestamp"
    )
    out = checks.check_backup_replicated(
        databases, hist, rules, instances(spark, "i"), state, placed, changed, as_of=NOW
    )
    assert [r[0] for r in rows(out, "object")] == ["DB3"]  # 1 is settling, 2 is not primary


def login_inputs(spark, counts, overrides):
    events = [
        ("i", login, at("2024-06-01T11:59:30") - timedelta(minutes=m), code)
        for login, n in counts.items() for m in range(n) for code in ("0x0000001c", "0x00000002")
    ]
    e = spark.createDataFrame(events, "instance_guid string, login_name string, event_ts timestamp, destination_code string")
    p = spark.createDataFrame(
        [("i", "_default", 60, 60, "WARNING"), *[("i", *o) for o in overrides]],
        "instance_guid string, name string, failed_login_threshold int, monitoring_period_minutes int, login_failure_alert string",
    )
    return e, p


def test_login_precedence(spark):
    e, p = login_inputs(spark, {"Bob": 10, "eve": 55}, [("bob", 5, 8, "CRITICAL")])
    out = checks.check_login_failures(e, p, as_of=NOW)
    assert rows(out, "object", "message", "state") == [(
        "bob", "Total number of login failures for a monitored login was 8, exceeding threshold of 5 per 8 minute window.", "CRITICAL",
    )]
    detail = checks.check_login_failures_detail(e, p, as_of=NOW)
    assert rows(detail, "section", "name", "count", "state") == [(0, "bob", 8, "CRITICAL"), (1, "_Total", 65, "WARNING")]


@pytest.mark.parametrize("override", [("bob", 0, 60, "CRITICAL"), ("bob", 5, 0, "CRITICAL")])
def test_zero_threshold_or_period_excludes_a_login(spark, override):
    e, p = login_inputs(spark, {"bob": 10, "eve": 3}, [override])
    out = checks.check_login_failures(e, p, as_of=NOW)
    assert rows(out, "message", "state") == [(
        "Total number of login failures in the last 60 minutes was 3, below threshold of 60 per 60 minute window.", "OK",
    )]


def test_login_window_is_inclusive_to_the_microsecond(spark):
    _, p = login_inputs(spark, {"x": 1}, [])
    edge = at("2024-06-01T11:00:00")
    e = spark.createDataFrame(
        [("i", "a", edge, "0x0000001c"), ("i", "a", edge - timedelta(microseconds=1), "0x0000001c")],
        "instance_guid string, login_name string, event_ts timestamp, destination_code string",
    )
    assert rows(checks.login_totals(e, p, as_of=NOW), "count") == [(1,)]


def test_no_login_events_give_na(spark):
    e, p = login_inputs(spark, {"x": 1}, [])
    out = checks.check_login_failures(e.limit(0), p, as_of=NOW)
    assert rows(out, "message", "state") == [("Total number of login failures in the last 60 minutes was 0", "NA")]


def test_mirroring_without_expected_role(spark):
    mirror = spark.createDataFrame(
        [("i", 1, "g", 4, "synchronized", "PRINCIPAL")],
        "instance_guid string, database_id int, mirroring_guid string, mirroring_state int, mirroring_state_desc string, mirroring_role_desc string",
    )
    db = spark.createDataFrame([("i", 1, "a")], "instance_guid string, database_id int, name string")
    rule = spark.createDataFrame(
        [("i", 1, None, "CRITICAL", True)],
        "instance_guid string, database_id int, mirroring_role string, change_state_alert string, is_enabled boolean",
    )
    out = checks.check_mirroring(db, mirror.withColumn("database_name", F.lit("a")), rule, instances(spark, "i", "j"))
    assert rows(out, "instance_guid", "message", "state") == [
        ("i", None, "OK"), ("j", "Mirroring is currently not configured.", "NA"),
    ]


def test_rollup_takes_the_worst_of_a_check_of_any_size(spark):
    data = [("i", "c", f"m{n}", "OK") for n in range(1500)] + [("i", "c", "bad", "CRITICAL"), ("i", "c", "odd", "FUNNY"), ("i", "n", "x", "NA")]
    df = spark.createDataFrame(data + data[:7], "instance_guid string, check string, message string, state string")
    out = checks.check_rollup(df).collect()
    hot = [r for r in out if r["check"] == "c"]
    assert len(hot) == 1502 and {(r["state_code"], r["count"]) for r in hot} == {(3, 1509)}
    assert sum(r["copies"] for r in hot) == 1509 and "FUNNY - odd" in {r["message"] for r in hot}
    assert [(r["state_code"], r["count"], r["message"], r["copies"]) for r in out if r["check"] == "n"] == [(0, 0, "NA - x", 1)]


# ---- charts

FILE = (
    "instance_guid string, database_id int, state int, database_is_read_only boolean, file_id int, file_type string, "
    "filegroup_id int, filegroup_name string, filegroup_is_readonly boolean, drive string, "
    "used_pages long, size_pages long, max_size_pages long, growth long, is_percent_growth boolean"
)


def a_file(readonly=False, limit=-1, growth=128, percent=False, used=40, size=100, drive="D"):
    return ("i", 1, 0, False, 1, "ROWS", 1, "PRIMARY", readonly, drive, used * 128, size * 128,
            limit if limit < 1 else limit * 128, growth, percent)


@pytest.mark.parametrize("kind, free, want", [
    (dict(readonly=True), 500, 60),                                   # read-only: slack
    (dict(growth=0), 500, 60),                                        # unlimited, no growth
    (dict(growth=128 * 600), 500, 60),                                # unlimited, step above disk
    (dict(growth=128 * 500), 500, 500),                               # unlimited, step equals disk
    (dict(growth=128), 500, 500),                                     # unlimited, fixed step
    (dict(growth=600, percent=True), 500, 60),                        # unlimited, 600 MB step
    (dict(growth=10, percent=True), 500, 500),                        # unlimited, 10 MB step
    (dict(limit=300, growth=0), 500, 60),                             # limited, no growth
    (dict(limit=900, growth=128 * 501), 500, 60),                     # disk-bound, step above disk
    (dict(limit=900, growth=128), 500, 500),                          # disk-bound
    (dict(limit=600, growth=128), 500, 500),                          # room equals disk: disk-bound
    (dict(limit=300, growth=128 * 201), 500, 60),                     # size-bound, step above room
    (dict(limit=300, growth=128 * 200), 500, 260),                    # size-bound, step equals room
    (dict(limit=900, growth=501, percent=True), 500, 60),             # disk-bound, percent above disk
    (dict(limit=900, growth=500, percent=True), 500, 500),            # disk-bound, percent equals disk
    (dict(limit=300, growth=200, percent=True), 500, 60),             # size-bound, percent reaches room
    (dict(limit=300, growth=199, percent=True), 500, 260),            # size-bound, percent below room
    (dict(limit=0), 500, None),                                       # no size allowed
])
def test_file_headroom_arms(spark, kind, free, want):
    files = spark.createDataFrame([a_file(**kind)], FILE)
    drives = spark.createDataFrame([("i", "D", Decimal(free))], "instance_guid string, drive string, free_mb decimal(20,2)")
    got = charts.file_headroom(files, drives).first()["headroom_mb"]
    assert got == (None if want is None else Decimal(want))


def test_disk_counts_once_per_drive(spark):
    files = spark.createDataFrame([a_file(), a_file(), a_file(drive="E", growth=0)], FILE)
    drives = spark.createDataFrame(
        [("i", "D", Decimal(500)), ("i", "E", Decimal(50))], "instance_guid string, drive string, free_mb decimal(20,2)"
    )
    got = charts.filegroup_headroom(charts.file_headroom(files, drives)).first()
    # D: disk once plus slack of both files; E cannot grow, 100 MB stays below its limit
    assert got["headroom_mb"] == Decimal(500 + 120 + 60)


def test_unreachable_files_show_no_use(spark):
    files = spark.createDataFrame(
        [("i", n, 1, 1, "PRIMARY", False, "ROWS", "f", "d:/f", 1280, 640, -1, 0, False) for n in (1, 2, 3)],
        "instance_guid string, database_id int, file_id int, filegroup_id int, filegroup_name string, filegroup_is_readonly boolean, "
        "file_type string, name string, physical_name string, size_pages long, used_pages long, max_size_pages long, growth long, is_percent_growth boolean",
    )
    db = spark.createDataFrame(
        [("i", 1, 0, False), ("i", 2, 6, False), ("i", 3, 6, False)],
        "instance_guid string, database_id int, state int, is_read_only boolean",
    )
    rule = spark.createDataFrame([("i", 2)], "instance_guid string, database_id int")
    out = charts.file_inventory(files, db, rule)
    assert rows(out, "database_id", "used_mb", "filegroup_name", "drive") == [
        (1, Decimal("5.00"), "PRIMARY", "D"), (2, Decimal("0.00"), None, "D"),
    ]


def test_counter_kinds(spark):
    t = at("2024-01-01")
    data = []

    def sample(name, kind, values):
        for n, v in enumerate(values):
            data.append(("i", n, t + timedelta(seconds=n), "SQLServer:X", name, "", v, kind, 1000 * n * 2))

    sample("Hit Ratio", charts.RATIO, [1, 1, 0])
    sample("Hit Ratio Base", charts.BASE, [2, 3, 5])
    sample("Avg Latency (ms)", charts.AVERAGE, [10, 20, 20])
    sample("Avg Latency Base", charts.BASE, [1, 5, 9])
    sample("Batches/sec", charts.PER_SECOND, [5, 12, 3])
    sample("Connections", charts.INSTANT, [7, -1, 9])
    df = spark.createDataFrame(
        data, "instance_guid string, seq long, sample_ts timestamp, object_name string, counter_name string, instance_name string, "
        "cntr_value long, cntr_type int, ms_ticks long",
    )
    got = {(r["counter_name"], r["seq"]): r["val"] for r in charts.counter_rate(df).collect()}
    want = {
        ("Hit Ratio", 1): "33.33", ("Hit Ratio", 2): "0.00", ("Avg Latency (ms)", 1): "2.50", ("Avg Latency (ms)", 2): "0.00",
        ("Batches/sec", 1): "3.50", ("Batches/sec", 2): "0.00", ("Connections", 1): "-1.00", ("Connections", 2): "9.00",
    }
    assert got == {k: Decimal(v) for k, v in want.items()}


def test_chart_evaluation(spark):
    df = spark.createDataFrame(
        [("i", "c", Decimal(5), Decimal(1), Decimal(9), "'a'=5"), ("i", "c", Decimal(-1), Decimal(3), Decimal(1), "'b'=-1"),
         ("i", "c", None, Decimal(3), Decimal(1), "'n'="), ("i", "d", Decimal(1), None, None, "'z'=1")],
        "instance_guid string, chart string, val decimal(20,2), warn decimal(20,2), crit decimal(20,2), pnp string",
    )
    assert rows(charts.chart_evaluate(df), "chart", "state_code", "breach", "perf", "rows", "copies") == [
        ("c", 2, "CRITICAL - b", "'b'=-1", 2, 1), ("c", 2, "WARNING - a", "'a'=5", 2, 1), ("d", 0, None, "'z'=1", 1, 1),
    ]


# ---- history

def test_windows_partition_history(spark):
    marks = spark.createDataFrame(
        [("i", "d", at("2024-05-30T12:00:00")), ("j", "d", None)], "instance_guid string, dataset string, last_run timestamp"
    )
    ticks = spark.createDataFrame(
        [(g, at("2024-05-30T12:00:00") + timedelta(hours=h)) for g in "ij" for h in range(0, 49)], "instance_guid string, ts timestamp"
    )
    first, moved = history.extract_window(marks, "d", as_of="2024-05-31 12:00:00", mark=True)
    second, unmoved = history.extract_window(moved, "d", as_of=NOW)
    a, b = history.in_window(ticks, "ts", first), history.in_window(ticks, "ts", second)
    assert a.intersect(b).count() == 0
    assert a.union(b).filter("instance_guid = 'i'").count() == 48
    assert rows(unmoved) == rows(moved)
    wide = history.in_window(ticks, "ts", first, inclusive=True)
    assert wide.count() == a.count() + 2


def test_missing_history_columns_become_null(spark):
    b = spark.createDataFrame(
        [("i", "A", "D", False, at("2024-06-01"), at("2024-06-01T01:00:00"), 0, "s", "u", "f")],
        "instance_guid string, database_name string, type string, is_copy_only boolean, backup_start_date timestamp, "
        "backup_finish_date timestamp, backup_size long, software_name string, user_name string, physical_device_name string",
    )
    db = spark.createDataFrame([("i", 1, "a")], "instance_guid string, database_id int, name string")
    rule = spark.createDataFrame([("i", 1, 26)], "instance_guid string, database_id int, backup_frequency_hours int")
    marks = spark.createDataFrame([("i", "log_backup", None)], "instance_guid string, dataset string, last_run timestamp")
    window, _ = history.extract_window(marks, "log_backup", as_of=NOW)
    got = history.log_backup(b, db, rule, window).first()
    assert got["compressed_backup_size_mb"] is None and got["compression_ratio"] is None and got["encryptor_type"] is None


def error_log(spark, *messages):
    return spark.createDataFrame(
        [("i", at("2024-06-01") + timedelta(minutes=n), "spid7", n, m) for n, m in enumerate(messages)],
        "instance_guid string, log_date timestamp, source string, seq long, message string",
    )


def test_error_pairs(spark):
    log = error_log(
        spark, "Error: 5, Severity: 1, State: 1.", "Error: 6, Severity: 1, State: 1.", "text  one", "Error: 99, Severity: 1, State: 2.", "x",
        "Error: 5, Severity: 1, State: 9.",
    )
    catalogue = spark.createDataFrame([(5, "five"), (6, "six")], "message_id int, text string")
    marks = spark.createDataFrame([("i", "log_error", None)], "instance_guid string, dataset string, last_run timestamp")
    window, _ = history.extract_window(marks, "log_error", as_of=NOW)
    raw = history.log_error_pairs(log, catalogue, window, sanitize=False)
    # a header may follow a header; ids without a template and a last header are left out
    assert [r[0] for r in rows(raw, "message")] == ["Error: 6, Severity: 1, State: 1.", "text one"]
    safe = history.log_error_pairs(log, catalogue, window, sanitize=True)
    assert [r[0] for r in rows(safe, "message")] == ["five", "six"]
    assert {r[0] for r in rows(safe, "source")} == {"spid"}


def test_integrity_lines(spark):
    log = error_log(
        spark, "DBCC (secret) found 0 errors and repaired 0 errors.", "DBCC (secret) found 2 errors and repaired 0 errors.",
    )
    marks = spark.createDataFrame([("i", "log_error", None)], "instance_guid string, dataset string, last_run timestamp")
    window, _ = history.extract_window(marks, "log_error", as_of=NOW)
    # trailing blank of the match is part of the text
    assert rows(history.log_error_integrity(log, window, sanitize=True), "message") == [(" found 2 errors and repaired 0 errors.",)]


# ---- reports

def test_backup_status_arms(spark):
    old, new = at("2024-01-01"), at("2024-06-01T06:00:00")
    names = {
        "new": dict(create_date=new), "restored": {}, "hidden": {}, "notreq": {}, "shipped": {}, "restoring": dict(state_desc="RESTORING"),
        "ro": dict(is_read_only=True), "standby": dict(is_in_standby=True), "off": dict(state_desc="OFFLINE"),
        "offok": dict(state_desc="OFFLINE"), "never": {}, "ok": {}, "due": {}, "weekly": {},
    }
    base = dict(create_date=old, state_desc="ONLINE", is_read_only=False, is_in_standby=False)
    databases = spark.createDataFrame(
        [("i", n, *{**base, **o}.values()) for n, o in names.items()],
        "instance_guid string, name string, create_date timestamp, state_desc string, is_read_only boolean, is_in_standby boolean",
    )
    done = {n: at("2024-06-01T01:00:00") for n in names if n not in ("never", "new")}
    done |= {"due": at("2024-05-30"), "weekly": at("2024-05-28"), "GoneNow": at("2024-05-31"), "gonelong": at("2024-05-01")}
    backups = spark.createDataFrame(
        [("i", n.upper() if n == "ok" else n, "D", t) for n, t in done.items()] + [("i", "never", "I", old)],
        "instance_guid string, database_name string, type string, backup_start_date timestamp",
    )
    restored = spark.createDataFrame(
        [("i", n, at("2024-06-01"), "D") for n in ("restored", "hidden")] + [("i", "ok", at("2024-06-01"), "L")],
        "instance_guid string, destination_database_name string, restore_date timestamp, restore_type string",
    )
    shipped = spark.createDataFrame([("i", "shipped")], "instance_guid string, secondary_database string")
    params = spark.createDataFrame(
        [("i", "notreq", "0", reports.FREQUENCY_MARK, None), ("i", "weekly", "7", reports.FREQUENCY_MARK, None),
         ("i", "hidden", "1", reports.RESTORED_MARK, None), ("i", reports.OFFLINE_MARK, "offok", "x", 1)],
        "instance_guid string, parametername string, setting string, comments string, status int",
    )
    out = reports.backup_status_report(databases, backups, restored, shipped, params, as_of=NOW)
    assert dict(rows(out, "database_name", "status")) == {
        "new": "New database", "restored": "Restored", "hidden": "Exclude from restored database report",
        "notreq": "Backup not required", "shipped": "Backup not required", "restoring": "Backup not required",
        "ro": "Read only database", "standby": "Standby database", "off": "IsOffline database", "offok": "OK",
        "never": "Never backed up", "ok": "OK", "due": "Backup Due", "weekly": "OK", "GoneNow": "Deleted",
    }


def test_keyword_report(spark):
    log = error_log(
        spark, "Error: 5, Severity: 1, State: 1.", "The details, here\r\nmore", "unrelated", "Backup FAILED", "done without errors",
        "found 0 errors and repaired 0 errors",
    )
    out = reports.error_keyword_report(log, instances(spark, "i", "j"), as_of=NOW)
    assert rows(out, "instance_guid", "message") == [
        ("i", "Backup FAILED"), ("i", "Error: 5 Severity: 1 State: 1."), ("i", "The details here|more"),
        ("j", "There are no error log messages"),
    ]


def test_job_failures_prefer_steps(spark):
    data = [
        ("a", 1, 0, 20240601, 70000), ("a", 0, 0, 20240601, 70000), ("b", 0, 3, 20240531, 70000), ("c", 1, 1, 20240601, 70000),
        ("d", 2, 0, 20240601, 50000), ("e", 0, 2, 20240531, 50000),
    ]
    df = spark.createDataFrame(
        [("i", j, s, 'st"ep', r, d, t, "m") for j, s, r, d, t in data],
        "instance_guid string, job_name string, step_id int, step_name string, run_status int, run_date int, run_time int, message string",
    )
    out = reports.job_failure_report(df, instances(spark, "i", "j"), as_of=NOW)
    assert rows(out, "job_name", "step_id", "status", "step_name") == [
        ("", 0, "", ""), ("a", 1, "Failed", "st'ep"), ("b", 0, "Cancelled", "st'ep"),
    ]


def test_the_daily_job_failures_have_no_end(spark, tmp_path):
    from datetime import datetime

    from fleetlens.plans.registry import all_queries

    spark.sql("select 0L as n_nationkey, 'NATION_0' as n_name, 0L as n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    spark.sql("select 0L as r_regionkey, 'R' as r_name").write.parquet(str(tmp_path / "region.parquet"))
    # steps of 17:17 and 21:21 of the report's day and one of the next day; a job's outcome at 20:20
    orders = [(17, 25, 1), (21, 50, 1), (45, 75, 2), (20, 100, 1)]
    spark.createDataFrame(
        [(k, c, datetime(2001, 8, d), "1-URGENT") for k, c, d in orders],
        "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    out = all_queries()["job_failure_report_daily"](spark, str(tmp_path))
    assert rows(out, "job_name", "step_id", "date", "time") == [
        ("job 100", 0, "01/08/2001", "20:20:20"), ("job 25", 1, "01/08/2001", "17:17:17"),
        ("job 50", 1, "01/08/2001", "21:21:21"), ("job 75", 1, "02/08/2001", "21:45:45"),
    ]


# ---- facts

SCHEDULE = (
    "freq_type int, freq_interval int, freq_subday_type int, freq_subday_interval int, freq_relative_interval int, "
    "freq_recurrence_factor int, active_start_date int, active_start_time int, active_end_time int"
)


@pytest.mark.parametrize("row, want", [
    ((1, 0, 2, 0, 0, 0, 20240131, 0, 0), "Once on 2024.01.31 at 12:00 AM between 12:00 AM and 12:00 AM"),
    ((4, 1, 1, 0, 0, 0, 0, 93000, 0), "Daily at 9:30 AM"),
    ((4, 1, 1, 0, 0, 0, 0, 120000, 0), "Daily at 12:00 PM"),
    ((4, 1, 1, 0, 0, 0, 0, 130500, 0), "Daily at 1:05 PM"),
    ((8, 65, 1, 0, 0, 1, 0, 220000, 0), "Weekly on Sunday, Saturday at 10:00 PM"),
    ((8, 2, 4, 15, 0, 3, 0, 0, 235959), "Every 3 weeks on Monday every 15 minutes between 12:00 AM and 11:59 PM"),
    ((16, 21, 8, 1, 0, 1, 0, 60000, 180000), "Monthly on the 21st every 1 hour between 6:00 AM and 6:00 PM"),
    ((16, 11, 1, 0, 0, 2, 0, 0, 0), "Every 2 months on the 11th at 12:00 AM"),
    ((16, 22, 2, 2, 0, 1, 0, 0, 0), "Monthly on the 22nd every 2 seconds between 12:00 AM and 12:00 AM"),
    ((32, 9, 1, 0, 16, 1, 0, 0, 0), "Monthly on the last week day at 12:00 AM"),
    ((32, 1, 1, 0, 4, 6, 0, 0, 0), "Every 6 months on the third Sunday at 12:00 AM"),
    ((64, 0, 0, 0, 0, 0, 0, 0, 0), "Automatically starts when SQLServerAgent starts."),
    ((128, 0, 0, 0, 0, 0, 0, 0, 0), "Starts whenever the CPUs become idle"),
])
def test_schedule_text(spark, row, want):
    df = spark.createDataFrame([row], SCHEDULE)
    assert df.select(facts.schedule_description().alias("d")).first()["d"] == want


def test_dynamic_projection(spark):
    df = spark.createDataFrame(
        [("i", 1, "n", 0, "ONLINE", "NOTHING", "me")],
        "instance_guid string, database_id int, name string, state int, state_desc string, log_reuse_wait_desc string, owner_sid string",
    )
    assert facts.fact_database(df).columns == ["instance_guid", "name", "state", "owner"]
    assert facts.fact_database(df).first()["state"] == "ONLINE"


def test_membership_with_a_cycle(spark):
    p = spark.createDataFrame(
        [("i", 1, "S"), ("i", 2, "S"), ("i", 10, "R"), ("i", 11, "R"), ("i", 12, "R")], "instance_guid string, principal_id int, type string"
    )
    m = spark.createDataFrame(
        [("i", 1, 10), ("i", 10, 11), ("i", 11, 12), ("i", 12, 10)], "instance_guid string, member_id int, role_id int"
    )
    got = rows(facts.role_membership_closure(p, m), "user_id", "role_id", "depth")
    assert got == [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, None, None)]


# ---- compliance

def test_score_and_filters(spark):
    df = spark.createDataFrame(
        [("i", "1", "t", True, True, "0"), ("i", "2", "t", True, False, "3"), ("i", "3", "t", False, False, "x")],
        "instance_guid string, rule_id string, title string, scored boolean, pass boolean, value string",
    )
    assert compliance.cis_score(df).first()["summary"] == "Total Score = 1/2  Failed = 1  Not Scored = 1"
    assert rows(compliance.cis_filter(df, "FAILED"), "rule_id") == [("2",)]
    assert rows(compliance.cis_filter(df, "notscored"), "rule_id") == [("3",)]
    assert compliance.cis_filter(df).count() == 3
    with pytest.raises(ValueError):
        compliance.cis_filter(df, "all")


def test_every_rule_has_an_id_once():
    ids = [r for r, _, _ in compliance.RULES]
    assert len(ids) == len(set(ids)) == 39


# ---- activity

def test_session_filters(spark):
    df = spark.createDataFrame(
        [("i", 1, "app_1", "running", 0, True), ("i", 2, "appX1", "sleeping", 1, True), ("i", 3, "app_2", "sleeping", 0, True), ("i", 4, "sys", "running", 0, False)],
        "instance_guid string, session_id int, program_name string, status string, open_tran_count int, is_user_process boolean",
    )
    assert rows(activity.session_filter(df, "program", "app[_]%"), "session_id") == [(1,), (3,)]
    assert rows(activity.session_filter(df, "session", "2"), "session_id") == [(2,)]
    assert activity.session_filter(df, "session", "0").count() == 4
    assert rows(activity.session_filter(df, not_type="program", not_pattern="APP%"), "session_id") == [(4,)]
    with pytest.raises(ValueError):
        activity.session_filter(df, "colour", "red")
    assert rows(activity.session_interest(df), "session_id") == [(1,), (2,)]
    assert rows(activity.session_interest(df, 2, True, own_id=1), "session_id") == [(2,), (3,), (4,)]
    assert rows(activity.session_interest(df, 0), "session_id") == [(1,)]


def test_wait_texts(spark):
    df = spark.createDataFrame(
        [("i", 1, 0, "ONE", 5, None), ("i", 1, 0, "TWO", 3, None), ("i", 1, 0, "TWO", 9, None),
         *[("i", 1, 0, "MANY", n, None) for n in (1, 2, 4)], ("i", 1, 0, "LCK", 7, 2), ("i", 1, 0, "ZERO", 0, None)],
        "instance_guid string, session_id int, request_id int, wait_type string, wait_ms long, blocking_session_id int",
    )
    df = df.withColumn("snapshot_ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    later = df.limit(1).withColumn("snapshot_ts", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    texts = rows(activity.wait_format(activity.wait_rollup(df.unionByName(later))), "snapshot_ts", "wait_info")
    assert len(texts) == 2  # collections aren't merged
    got = texts[0][1]
    assert got == "(1x: 7ms)LCK, (3x: 1/2/4ms)MANY, (2x: 3/9ms)TWO, (1x: 5ms)ONE"


def test_activity_view_order_and_unknown_names(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 9, 4)], "a int, cpu int, cpu_delta int")
    out = activity.activity_view(df, "[cpu%][nope][a]", "[cpu] DESC[a]")
    assert out.columns == ["cpu", "cpu_delta", "a"] and [r["cpu"] for r in out.collect()] == [9, 2]
    with pytest.raises(ValueError):
        activity.activity_view(df, "[nope]")


def test_mutual_blocking(spark):
    df = spark.createDataFrame(
        [("i", "t", 1, 2), ("i", "t", 2, 1), ("i", "t", 3, 1), ("i", "t", 4, 3), ("i", "t", 5, None), ("i", "t", 6, 99)],
        "instance_guid string, snapshot_ts string, session_id long, blocking_session_id long",
    )
    got = dict(rows(activity.block_leaders(df), "session_id", "blocked_session_count"))
    assert got == {1: 3, 2: 3, 3: 1, 4: 0, 5: 0, 6: 0}


def test_a_blocker_may_change_between_snapshots(spark):
    df = spark.createDataFrame(
        [("i", "t1", 1, None), ("i", "t1", 2, 1), ("i", "t1", 3, None), ("i", "t1", 4, 2),
         ("i", "t2", 1, None), ("i", "t2", 2, 3), ("i", "t2", 3, None), ("i", "t2", 4, None)],
        "instance_guid string, snapshot_ts string, session_id long, blocking_session_id long",
    )
    got = rows(activity.block_leaders(df), "snapshot_ts", "session_id", "blocked_session_count")
    assert got == [("t1", 1, 2), ("t1", 2, 1), ("t1", 3, 0), ("t1", 4, 0), ("t2", 1, 0), ("t2", 2, 0), ("t2", 3, 1), ("t2", 4, 0)]


def test_snapshots_differ_null_safely(spark):
    schema = "instance_guid string, id int, name string, n int"
    before = spark.createDataFrame([("i", 1, "a", None), ("i", 2, "b", 1), ("i", 3, None, 5), ("i", None, "z", 1)], schema)
    after = spark.createDataFrame([("i", 1, "a", None), ("i", 2, "b", 2), ("i", 4, "d", 5), ("i", None, "z", 1)], schema)
    got = rows(facts.fact_diff(before, after, ["instance_guid", "id"]), "id", "change", "before", "after")
    assert got == sorted([
        (2, "changed", '{"name":"b","n":1}', '{"name":"b","n":2}'),
        (3, "removed", '{"name":null,"n":5}', None), (4, "added", None, '{"name":"d","n":5}'),
    ], key=repr)


def test_roles_are_reached_at_any_depth(spark):
    principals = spark.createDataFrame([("i", 0, "U"), ("i", 99, "U")] + [("i", n, "R") for n in range(1, 71)], "instance_guid string, principal_id long, type string")
    members = spark.createDataFrame([("i", n + 1, n) for n in range(70)] + [("i", 3, 70)], "instance_guid string, role_id long, member_id long")
    got = rows(facts.role_membership_closure(principals, members), "user_id", "role_id", "depth")
    assert got == sorted([(0, n, n) for n in range(1, 71)] + [(99, None, None)], key=repr)


def test_history_windows_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.sql("select 'i' as instance_guid, timestamp_seconds(id * 3600) as ts from range(1000)").write.parquet(path)
    windows = spark.createDataFrame(
        [("i", at("1970-01-01T10:00:00"), at("1970-01-01T20:00:00"))], "instance_guid string, start_at timestamp, end_at timestamp"
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    found = history.in_window(spark.read.parquet(path), "ts", windows)
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


# ---- advice

def test_object_selection(spark):
    df = spark.createDataFrame(
        [("i", "master", True, False), ("i", "sales_1", False, True), ("i", "salesX1", False, False), ("i", "temp1", False, False)],
        "instance_guid string, name string, is_system boolean, in_availability_group boolean",
    )
    pick = lambda text, **k: [r[0] for r in rows(advice.select_objects(df, text, **k), "name")]
    assert pick("ALL_DATABASES,-temp%") == ["master", "salesX1", "sales_1"]
    assert pick("USER_DATABASES, -[sales_1]") == ["salesX1", "temp1"]
    assert pick("SYSTEM_DATABASES;sales_1", delimiter=";") == ["master", "sales_1"]
    assert pick("AVAILABILITY_GROUP_DATABASES") == ["sales_1"]
    assert pick("-temp1") == []
    assert rows(advice.select_objects(df, "temp%,ALL_DATABASES"), "name", "position")[-1] == ("temp1", 1)


@pytest.mark.parametrize("frag, kind, locks, online, readonly, pages, want", [
    (4.9, 1, True, True, False, 2000, ("Low", None)),
    (5.0, 1, True, True, False, 2000, ("Medium", "INDEX_REORGANIZE")),
    (29.9, 1, False, True, False, 2000, ("Medium", "INDEX_REBUILD_ONLINE")),
    (10.0, 1, False, False, False, 2000, ("Medium", "INDEX_REBUILD_OFFLINE")),
    (30.0, 1, True, True, False, 2000, ("High", "INDEX_REBUILD_ONLINE")),
    (30.0, 3, True, True, False, 2000, ("High", "INDEX_REBUILD_OFFLINE")),
    (10.0, 5, False, True, False, 2000, ("Medium", "INDEX_REORGANIZE")),
    (90.0, 7, True, True, False, 2000, ("High", None)),
    (90.0, 1, True, True, False, 999, ("High", None)),
    (90.0, 1, True, True, False, 1000, ("High", "INDEX_REBUILD_ONLINE")),
    (90.0, 1, True, True, True, 2000, (None, None)),
])
def test_fragmentation(spark, frag, kind, locks, online, readonly, pages, want):
    df = spark.createDataFrame(
        [("i", frag, kind, locks, online, readonly, pages)],
        "instance_guid string, fragmentation double, index_type int, allow_page_locks boolean, allow_online boolean, "
        "on_read_only_filegroup boolean, page_count long",
    )
    got = advice.fragmentation_action(df).first()
    assert (got["fragmentation_group"], got["action"]) == want


@pytest.mark.parametrize("changed, total, only, level, want", [
    (0, 100, False, None, True), (0, 100, True, None, False), (1, 100, True, None, True), (5, 100, False, 5, True),
    (4, 100, False, 5, False), (1000, 1000, False, 500, True), (999, 1000, False, 500, False), (5, 0, False, 5, True),
])
def test_statistics(spark, changed, total, only, level, want):
    df = spark.createDataFrame([(1, 1, changed, total)], "index_id int, index_type int, modification_counter long, row_count long")
    assert advice.stats_update_due(df, "ALL", only, level).first()["update_due"] is want


@pytest.mark.parametrize("name, model, log, base, snap, modified, asked, want", [
    ("a", "FULL", 1, 1, False, 0, "LOG", "LOG"), ("a", "FULL", None, 1, False, 0, "LOG", "DIFF"),
    ("a", "SIMPLE", None, 1, False, 0, "LOG", "LOG"), ("a", "FULL", None, None, False, 0, "LOG", "FULL"),
    ("master", "FULL", None, 1, False, 0, "LOG", "LOG"), ("master", "FULL", 1, 1, False, 0, "DIFF", "FULL"),
    ("a", "FULL", 1, 1, True, 0, "DIFF", "FULL"), ("a", "FULL", 1, 1, False, 50, "DIFF", "FULL"),
    ("a", "FULL", 1, 1, False, 49, "DIFF", "DIFF"), ("a", "FULL", 1, None, False, 0, "FULL", "FULL"),
])
def test_backup_type(spark, name, model, log, base, snap, modified, asked, want):
    df = spark.createDataFrame(
        [(name, model, log, base, snap, modified, 100)],
        "name string, recovery_model_desc string, log_lsn long, differential_base_lsn long, differential_base_is_snapshot boolean, "
        "modified_extent_pages long, allocated_extent_pages long",
    )
    assert advice.backup_type_choice(df, asked, 50).first()["backup_type"] == want
    assert advice.backup_type_choice(df, asked, 50, change=False).first()["backup_type"] == asked


@pytest.mark.parametrize("mb, last, want", [
    (10.0, "2024-06-01T11:59:00", False), (50.0, "2024-06-01T11:59:00", True), (10.0, "2024-06-01T11:00:00", True),
    (None, "2024-06-01T11:59:00", True), (10.0, None, True),
])
def test_log_backup(spark, mb, last, want):
    df = spark.createDataFrame([(mb, last and at(last))], "log_mb_since_backup double, last_log_backup timestamp")
    assert advice.log_backup_due(df, 50, 600, as_of=NOW).first()["log_backup_due"] is want
    assert advice.log_backup_due(df, None, 600, as_of=NOW).first()["log_backup_due"] is True


# ---- exchange

@pytest.mark.parametrize("tag, want", [
    ("[inst_1]_log_backup_20240601120000.xml", ("inst_1", "log_backup")), ("host_fact_security_20240601120000.xml", ("host", "fact_security")),
    ("[a]_log_job_20240601120000", ("a", "log_job")),
])
def test_tags(spark, tag, want):
    got = spark.range(1).select(exchange.instance_of(F.lit(tag)).alias("i"), exchange.dataset_of(F.lit(tag)).alias("d")).first()
    assert tuple(got) == want


def test_collected_xml_files(spark, tmp_path):
    for name, n in (("[inst_1]_log_job_20240601120000.xml", 1), ("host_log_job_20240601120000.xml", 2)):
        (tmp_path / name).write_text(f"<t><row><id>{n}</id><text>a &amp; b</text></row></t>")
    out = exchange.read_collected(spark, str(tmp_path), "xml", schema="id int, text string")
    assert rows(out, "instance_guid", "dataset", "id", "text") == [("host", "log_job", 2, "a & b"), ("inst_1", "log_job", 1, "a & b")]


def test_safe_names():
    assert exchange.safe_name("[log].[a b]-c_1") == "logab-c_1"


def test_routed_files(spark, tmp_path):
    df = spark.createDataFrame([("[a]_log_backup_1.xml",), ("x_LOG_JOB_2.xml",), ("y_other.xml",)], "name string")
    routed = exchange.route_by_dataset(df, {"*_log_backup_*": "backup", "*_log_*": "log"})
    exchange.write_routed(routed, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "target", "name") == [
        ("backup", "[a]_log_backup_1.xml"), ("log", "x_LOG_JOB_2.xml"),
    ]


def test_snapshots_prune_by_day(spark, tmp_path):
    path = str(tmp_path / "stage")
    for day in ("2024-05-30", "2024-05-31"):
        exchange.write_snapshots(spark.createDataFrame([("i", f"{day}T01:00:00.000+00:00")], "instance_guid string, check_date string"), path, "check_date")
    kept = spark.read.parquet(path).filter("snapshot_day >= '2024-05-31'")
    assert "PartitionFilters: [isnotnull(snapshot_day" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 1


def test_datasets_round_trip_with_a_hot_instance(spark, tmp_path):
    df = spark.range(300).selectExpr("IF(id < 200, 'hot_1', concat('i', id % 3)) AS instance_guid", "id")
    target = exchange.write_dataset(df, str(tmp_path), "log.x", "20240601120000")
    back = exchange.read_collected(spark, target)
    assert rows(back, "instance_guid", "id") == rows(df)
    assert rows(back.select("dataset").distinct()) == [("logx",)]


def test_event_documents(spark):
    xml = (
        '<event timestamp="2024-01-02T03:04:05.678Z"><data name="destination"><type name="error_destination"/><value>{}</value></data>'
        "<data name=\"message\"><value>Login failed for user 'a.b'c'. Reason: x.</value></data></event>"
    )
    raw = spark.createDataFrame([("i", xml.format("0x0000001c")), ("i", xml.format("0x00000002"))], "instance_guid string, event_xml string")
    assert rows(exchange.shred_events_xml(raw), "event_ts", "login_name") == [(datetime(2024, 1, 2, 3, 4, 5, 678000), "a.b'c")]


def test_a_task_reads_a_bounded_share_of_files_and_shuffles(spark, tmp_path):
    held = {"spark.sql.files.minPartitionNum": "1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k, None) for k in held}
    spark.range(0, 6_000_000, 1, 1).select(F.xxhash64("id").alias("x")).write.parquet(str(tmp_path / "t"))  # 48 MB
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        read = spark.read.parquet(str(tmp_path / "t"))
        assert read.rdd.getNumPartitions() >= 2
        told = read.distinct().groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert max(r["count"] for r in told) <= 2_500_000 and sum(r["count"] for r in told) == 6_000_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
