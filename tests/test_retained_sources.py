"""Snapshot folders, XML documents, nested roles and checks that scan their history once."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetlens.operators import facts, history, reports
from fleetlens.plans.fixpoint import reachable
from fleetlens.sources.exchange import (
    expire_snapshots, read_collected_xml, read_snapshots, write_dataset, write_snapshots,
)


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_expired_days_go_and_kept_files_stay_untouched(spark, tmp_path):
    path = tmp_path / "t"
    df = spark.createDataFrame([(n, f"2024-01-{n:02} 10:00:00") for n in range(1, 11)], "n int, at string")
    write_snapshots(df, str(path), "at")
    before = files_of(path)
    write_snapshots(spark.createDataFrame([(99, "2024-01-11 00:00:00")], df.schema), str(path), "at")
    assert expire_snapshots(f"file:{path}", date(2024, 1, 6)) == [f"snapshot_day=2024-01-{n:02}" for n in range(1, 6)]
    after = files_of(path)
    kept = {name: at for name, at in before.items() if name.split("=")[1][:10] >= "2024-01-06"}
    assert {name: after[name] for name in kept} == kept and len(after) == len(kept) + 1
    assert rows(read_snapshots(spark, str(path), df.schema, date(2024, 1, 9)), "n") == [(10,), (9,), (99,)]
    assert expire_snapshots(str(path), date(2024, 1, 6)) == []


def test_capacity_is_appended_and_cut_within_the_last_month(spark, tmp_path):
    days = ["2023-12-31", "2024-02-29", "2024-03-01", "2024-03-02", "2024-05-31"]
    stage = spark.createDataFrame([("i", f"{d}T12:00:00.000+00:00") for d in days], "instance_guid string, check_date string")
    write_snapshots(stage, str(tmp_path / "s"), "check_date", period="month")
    new = spark.createDataFrame([("i", "2024-06-01T12:00:00.000+00:00")], stage.schema)
    as_of = "2024-06-01 12:30:00"
    got = history.append_capacity(new, str(tmp_path / "s"), as_of=as_of)
    assert rows(got) == rows(history.stage_capacity_append(stage, new, as_of=as_of))
    assert [r[1][:10] for r in rows(got)] == ["2024-03-02", "2024-05-31", "2024-06-01"]


SCHEMA = "n long, t string, at timestamp"


def test_xml_documents_come_back_and_broken_ones_are_kept_apart(spark, tmp_path):
    at = datetime(2024, 1, 1, 2, 3, 4, 567890)
    df = spark.createDataFrame([("a b", 1, "x < y & \"z\"", at), ("a b", 2, None, None), ("c", 3, "é", at)], f"instance_guid string, {SCHEMA}")
    target = write_dataset(df, str(tmp_path), "log.job", "20240101000000", format="xml")
    for instance, text in (("torn", "<table><row><n>7</n></row><row><n>8"), ("odd", "<table><row><n>x</n></row></table>")):
        spark.createDataFrame([(text,)], "v string").coalesce(1).write.text(f"{target}/drop=[{instance}]_logjob_20240101000000")
    found = read_collected_xml(spark, target, SCHEMA)
    assert rows(found.rows, "instance_guid", "dataset", "n", "t", "at") == sorted(
        [("a b", "logjob", 1, "x < y & \"z\"", at), ("a b", "logjob", 2, None, None), ("c", "logjob", 3, "é", at), ("torn", "logjob", 7, None, None)], key=repr
    )
    assert rows(found.broken, "instance_guid", "dataset") == [("odd", "logjob"), ("torn", "logjob")]
    assert all("drop=" in f for (f,) in rows(found.broken, "file"))


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(9)],  # a chain
    [(0, 1), (1, 2), (2, 0), (2, 3), (5, 5)],  # rings
    [],
])
def test_reachable_by_doubling(spark, edges):
    df = spark.createDataFrame([(g, a, b) for g in ("x", "y") for a, b in edges if g == "x" or a], "g string, source int, target int")
    want = set()
    for g in ("x", "y"):
        own = {(a, b) for a, b in edges if g == "x" or a}
        closed = set(own)
        while more := {(a, d) for a, b in closed for c, d in own if b == c} - closed:
            closed |= more
        want |= {(g, *p) for p in closed}
    assert rows(reachable(df, ["g"])) == sorted(want, key=repr)


def test_database_roles_are_nested_within_their_database(spark):
    frame = spark.createDataFrame
    plain = ", ".join(f"{c} boolean" for c in ("is_policy_checked", "is_expiration_checked", "is_locked", "is_expired", "is_must_change"))
    principals = frame(
        [("i", 1, "bob", "SQL_LOGIN", "s1", False, False, *[True] * 5, None, None, 0)],
        f"instance_guid string, principal_id long, name string, type_desc string, sid string, is_disabled boolean, is_invalid boolean, {plain}, lockout_time timestamp, password_last_set_time timestamp, bad_password_count long",
    )
    users = frame(
        [("i", "d1", "s1", "u", "r0"), ("i", "d2", "s1", "u", "r0"), ("i", "d1", "gone", "v", "r3")],
        "instance_guid string, database_name string, sid string, user_name string, role_name string",
    )
    nested = frame(
        [("i", "d1", f"r{n}", f"r{n + 1}") for n in range(5)] + [("i", "d1", "r5", "r0"), ("i", "d3", "r0", "other"), ("j", "d2", "r0", "other")],
        "instance_guid string, database_name string, member_role string, role_name string",
    )
    none = frame([], "instance_guid string, principal_id long, role_name string")
    grants = frame([], "instance_guid string, principal_id long, state_desc string, permission_name string, grantor string")
    groups = frame([], "instance_guid string, principal_id long, account_name string")
    out = facts.fact_security(principals, none, grants, groups, users, nested)
    told = [F.get_json_object("item", f"$.{c}").alias(c) for c in ("database_name", "role_name")]
    got = rows(out.filter("kind = 'database_roles'").select("entry", *told))
    chain = [f"r{n}" for n in range(6)]
    assert got == sorted(
        [("login:1", "d1", r) for r in chain] + [("login:1", "d2", "r0")] + [("sid:gone", "d1", r) for r in chain], key=repr
    )




def test_the_job_history_is_scanned_once(spark, tmp_path):
    history_rows = [("i", "job", 1, "step", 0, 20240601, 70000, "x"), ("i", "job", 1, "step", 0, 20240602, 70000, "tomorrow"), ("i", "other", 0, "(Job outcome)", 0, 20240601, 80000, "y")]
    schema = "instance_guid string, job_name string, step_id int, step_name string, run_status int, run_date int, run_time int, message string"
    spark.createDataFrame(history_rows, schema).write.parquet(str(tmp_path / "job_history"))
    seen = spark.read.parquet(str(tmp_path / "job_history"))
    instances = spark.createDataFrame([("i",), ("j",)], "instance_guid string")
    out = reports.job_failure_report(seen, instances, as_of="2024-06-01 12:00:00")
    assert "job_history" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {f for f in out.inputFiles() if "job_history" in f} == set()
    assert rows(out, "instance_guid", "job_name", "message") == [("i", "job", "x"), ("i", "other", "y"), ("j", "", "There are no failed jobs")]

