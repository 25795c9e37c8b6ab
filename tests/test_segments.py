"""The row before, by a scan of range partitions, against plain windows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from fleetlens.operators import charts, policy, reports
from fleetlens.plans import adjacent
from fleetlens.plans.segments import row_before


def lines(spark, seed=1, n=500):
    """One key holds most rows; a key and values may be null; times repeat."""
    r = random.Random(seed)
    data, at = [], datetime(2024, 1, 1)
    for seq in range(n):
        at += r.choice([timedelta(0), timedelta(seconds=1), timedelta(days=2)])
        data.append((r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, 1]), at, seq, r.choice([None, 1, 2]), f"clash {seq}"))
    return spark.createDataFrame(data, "k string, j int, ts timestamp, seq long, v int, previous string").repartition(5)


def window(df):
    w = Window.partitionBy("k", "j").orderBy("ts", "seq")
    return df.select("seq", F.lag("v").over(w).alias("v"), F.lag("seq").over(w).alias("s"))


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_row_before_equals_a_window(spark, partitions, batch):
    df = lines(spark)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    for name, value in zip(kept, (partitions, batch, "false"), strict=True):
        spark.conf.set(name, value)
    try:
        found = row_before(df, ["k", "j"], ["ts", "seq"], ["v", F.col("seq").alias("s")])
        assert found.columns == ["k", "j", "ts", "seq", "v", "previous"]
        assert rows(found, "seq", "previous.v", "previous.s") == rows(window(df))
        assert found.filter("previous is null").count() == df.select("k", "j").distinct().count()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_a_hot_key_spans_several_partitions(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 500)) k", "timestamp_seconds(id) ts", "id seq")
    dealt = df.repartitionByRange(8, "k", "ts", "seq").withColumn("p", F.spark_partition_id())
    assert dealt.filter("k = 'hot'").select("p").distinct().count() >= 2


def test_no_rows_and_one_row(spark):
    df = lines(spark)
    assert row_before(df.limit(0), ["k"], ["ts", "seq"], ["v"]).collect() == []
    assert [r.previous for r in row_before(df.filter("seq = 3"), ["k"], ["ts", "seq"], ["v"]).collect()] == [None]


def test_operators_size_no_keys(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("keys are sized")

    monkeypatch.setattr(adjacent, "hot_keys", refuse)
    at = datetime(2024, 1, 1)
    samples = spark.createDataFrame(
        [("i", "o", "c", "n", 65792, at + timedelta(minutes=m), m, 10 * m, 60_000 * m) for m in range(4)],
        "instance_guid string, object_name string, counter_name string, instance_name string, cntr_type long, sample_ts timestamp, seq long, cntr_value long, ms_ticks long",
    )
    assert charts.counter_rate(samples).count() == 3
    snapshots = spark.createDataFrame(
        [("i", 1, at + timedelta(hours=h), h, role) for h, role in enumerate(("A", "A", "B", "B"))],
        "instance_guid string, ag_id int, snapshot_ts timestamp, seq long, role string",
    )
    got = policy.role_change_stamp(snapshots).first()
    assert (got.ag_role, got.ag_role_change_datetime) == ("B", at + timedelta(hours=2))
    log = spark.createDataFrame(
        [("i", at, "s", 1, "Error: 1, Severity: 2, State: 3."), ("i", at, "s", 2, "what it says"), ("i", at, "s", 3, "other")],
        "instance_guid string, log_date timestamp, source string, seq long, message string",
    )
    instances = spark.createDataFrame([("i",), ("quiet",)], "instance_guid string")
    shown = reports.error_keyword_report(log, instances, as_of="2024-01-01 01:00:00")
    assert sorted(r.message for r in shown.collect())[1:] == ["There are no error log messages", "what it says"]
