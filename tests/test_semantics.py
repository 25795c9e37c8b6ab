"""Decisions on meaning: boundaries, rounding, text and units."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetlens.functions import semantics as s
from fleetlens.functions.states import state_code
from fleetlens.operators import charts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hours_and_minutes_count_boundaries(spark):
    a, b = s.instant("2024-01-01 00:59:59"), s.instant("2024-01-01 01:00:01")
    assert one(spark, s.hours_between(a, b)) == 1
    assert one(spark, s.minutes_between(a, b)) == 1
    assert one(spark, s.hours_between(b, a)) == -1
    assert one(spark, s.hours_between(s.instant("2024-01-01 00:00:00"), s.instant("2024-01-01 00:59:59"))) == 0
    # before the epoch too
    assert one(spark, s.hours_between(s.instant("1900-01-01 00:30:00"), s.instant("1900-01-01 01:00:00"))) == 1


def test_instant_takes_datetimes_and_strings(spark):
    assert one(spark, s.instant(datetime(2024, 1, 2, 3, 4, 5, 6))) == one(spark, s.instant("2024-01-02 03:04:05.000006"))


@pytest.mark.parametrize("given, want", [
    ("a  b", "a b"), ("a    b", "a  b"), (" x\r\ny ", "xy"), ('a","b', 'a";"b'), (None, None),
])
def test_clean_text(spark, given, want):
    assert one(spark, s.clean_text(F.lit(given).cast("string"))) == want


def test_iso_with_offset(spark):
    assert one(spark, s.iso_with_offset(s.instant("2024-01-02 03:04:05.678"))) == "2024-01-02T03:04:05.678+00:00"


@pytest.mark.parametrize("zone, want", [
    ("America/St_Johns", "2024-01-01T20:30:00.000-03:30"), ("Asia/Kolkata", "2024-01-02T05:30:00.000+05:30"),
])
def test_offset_sign(spark, zone, want):
    at = s.instant("2024-01-02 00:00:00")
    rendered = F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    assert one(spark, rendered) == want[:23]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, s.iso_with_offset(F.timestamp_seconds(F.lit(1704153600)))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_agent_integers(spark):
    assert one(spark, s.agent_timestamp(F.lit(20240131), F.lit(93007))) == datetime(2024, 1, 31, 9, 30, 7)
    assert one(spark, s.agent_timestamp(F.lit(0), F.lit(0))) is None
    assert one(spark, s.agent_seconds(F.lit(10203))) == 3723
    assert one(spark, s.agent_seconds(F.lit(1250000))) == 125 * 3600


@pytest.mark.parametrize("ms, want", [
    (0, "00 00:00:00.000"), (90061001, "01 01:01:01.001"), (86400000 * 123 + 5, "123 00:00:00.005"),
])
def test_duration_text(spark, ms, want):
    assert one(spark, s.duration_text(F.lit(ms))) == want


def test_quote_name(spark):
    assert one(spark, s.quote_name(F.lit("a]b"))) == "[a]]b]"


def test_state_codes(spark):
    df = spark.createDataFrame([("NA",), ("ok",), ("Warning",), ("CRITICAL",), ("what",)], "state string")
    assert [r[0] for r in df.select(state_code(F.col("state"))).collect()] == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("val, warn, crit, want", [
    (5, 10, 20, "OK"), (10, 10, 20, "WARNING"), (20, 10, 20, "CRITICAL"),
    (30, 20, 10, "OK"), (20, 20, 10, "WARNING"), (10, 20, 10, "CRITICAL"),
    (5, None, 1, "OK"), (5, 1, None, "OK"), (-1, 0, 1, "OK"), (7, 7, 7, "CRITICAL"),
])
def test_threshold_direction(spark, val, warn, crit, want):
    cell = [F.lit(x).cast("int") for x in (val, warn, crit)]
    assert one(spark, charts.threshold_state(*cell)) == want


@pytest.mark.parametrize("counter, instance, kind, want", [
    ("Hit Ratio", "", 537003264, "%"), ("CPU % usage", "", 1, "%"), ("Percent Log Used", "", 65792, "%"),
    ("Usage  ", "", 65792, "c"), ("Usage", "", 1, None), ("Wait (ms)", "", 1, "ms"), ("x", "a(MS)", 1, "ms"),
    ("Memory (KB)", "", 1, "KB"), ("Bytes sent", "", 1, "B"), ("Bytes/sec", "", 1, None), ("Logins", "", 1, None),
])
def test_units(spark, counter, instance, kind, want):
    assert one(spark, charts.counter_uom(F.lit(counter), F.lit(instance), F.lit(kind))) == want


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]
