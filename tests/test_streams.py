"""Streams over several micro-batches give what the batch operators give."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import rows
from fleetlens.operators import charts, checks, history, policy
from fleetlens.streaming import streams
from fleetlens.streaming.upsert import UpsertTable, newest

START = datetime(2024, 1, 1)


def dropped(spark, tmp_path, batches, schema):
    """A stream that reads one file per micro-batch, in order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for n, batch in enumerate(batches):
        staged = tmp_path / f"stage{n}"
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(staged))
        part = next(p for p in staged.iterdir() if p.suffix == ".parquet")
        target = folder / f"{n:03}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    return stream, whole


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def split(data, n):
    size = -(-len(data) // n)
    return [data[i:i + size] for i in range(0, len(data), size)]


SAMPLE = (
    "instance_guid string, seq long, sample_ts timestamp, object_name string, counter_name string, instance_name string, "
    "cntr_value long, cntr_type int, ms_ticks long"
)


def test_counter_rate_across_batches(spark, tmp_path):
    r = random.Random(5)
    data = []
    for n in range(40):
        t, v = START + timedelta(seconds=10 * n), r.randint(0, 50)
        for name, kind, value in (
            ("Hits/sec", charts.PER_SECOND, 100 * n + v), ("X Ratio", charts.RATIO, v), ("X Ratio Base", charts.BASE, 50), ("N", charts.INSTANT, v),
        ):
            data.append(("i", n, t, "o", name, "", value, kind, 10_000 * n))
    stream, whole = dropped(spark, tmp_path, split(data, 5), SAMPLE)
    finish(streams.stream_counter_rate(stream, str(tmp_path / "run")))
    got = spark.read.parquet(str(tmp_path / "run/out"))
    assert rows(got.select(*sorted(got.columns))) == rows(charts.counter_rate(whole).select(*sorted(got.columns)))


LOG = "instance_guid string, log_date timestamp, source string, seq long, message string"


def log_lines(n=60, seed=3):
    r = random.Random(seed)
    data = []
    for g in ("hot", "cold"):
        for k in range(n if g == "hot" else n // 6):
            text = f"Error: {k % 7}, Severity: 1, State: 1." if r.random() < 0.4 else r.choice((f"text  {k}", "a\nb", None))
            data.append((g, START + timedelta(seconds=r.randint(0, 1500)), r.choice(("spid7", "Logon")), k, text))
    return data


CATALOGUE = [(i, f"Template  {i}") for i in range(5)]  # 5 and 6 aren't in it
#: Pushes the watermark past all lines, on an instance of its own.
BEAT = ("beat", START + timedelta(hours=2), "s", 0, "x")


@pytest.mark.parametrize("sanitize", [False, True])
@pytest.mark.parametrize("order", ["by time", "shuffled"])
def test_error_pairs_equal_the_batch_on_any_split(spark, tmp_path, sanitize, order):
    data = log_lines()
    data.sort(key=lambda d: d[1]) if order == "by time" else random.Random(8).shuffle(data)
    end = {g: START + timedelta(minutes=40) for g in ("hot", "cold")}
    last = [(g, end[g], "spid1", 999, "Error: 2, Severity: 1, State: 1.") for g in end]  # stays pending
    stream, whole = dropped(spark, tmp_path, [*split(data, 5), last, [BEAT]], LOG)
    messages = spark.createDataFrame(CATALOGUE, "message_id int, text string")
    # lines may come late by as long as the log lasts
    query = streams.stream_error_pairs(
        stream, messages, str(tmp_path / "run"), sanitize=sanitize, watermark="45 minutes", timeout=timedelta(minutes=10)
    )
    finish(query)
    got = spark.read.parquet(str(tmp_path / "run/out"))
    windows = spark.createDataFrame([(g, START - timedelta(days=1), START + timedelta(days=1)) for g in end], "instance_guid string, start_at timestamp, end_at timestamp")
    want = history.log_error_pairs(whole.filter("instance_guid <> 'beat'"), messages, windows, sanitize=sanitize)
    assert want.count() > 10
    assert rows(got.filter("complete").drop("complete")) == rows(want)
    # the header at the end, which the batch can't pair, comes when its time is up
    text = "Template 2" if sanitize else None
    assert rows(got.filter("NOT complete"), "instance_guid", "message_header", "message") == [
        (g, "Error: 2, Severity: 1, State: 1.", text) for g in ("cold", "hot")
    ]


def test_a_pending_header_meets_a_line_that_comes_in_time(spark, tmp_path):
    head = ("i", START, "s", 1, "Error: 1, Severity: 1, State: 1.")
    late = ("i", START + timedelta(minutes=50), "s", 2, "what follows")
    beats = [("beat", START + timedelta(minutes=m), "s", 0, "x") for m in (20, 40, 200)]
    stream, _ = dropped(spark, tmp_path, [[head], [beats[0]], [beats[1]], [late], [beats[2]]], LOG)
    messages = spark.createDataFrame(CATALOGUE, "message_id int, text string")
    finish(streams.stream_error_pairs(stream, messages, str(tmp_path / "run"), timeout=timedelta(hours=1)))
    assert rows(spark.read.parquet(str(tmp_path / "run/out")), "message", "complete") == [("what follows", True)]


EAV = "instance_guid string, hierarchy string, property string, value string, lastseen timestamp, seq long"


def test_inventory_across_batches(spark, tmp_path):
    data = [("i", f"h{n % 4}", "p", f"v{n}", START + timedelta(hours=n), n) for n in range(20)]
    stream, whole = dropped(spark, tmp_path, split(data, 4), EAV)
    folder, as_of = str(tmp_path / "run"), "2024-01-20 00:00:00"
    finish(streams.stream_eav_upsert(stream, folder, as_of=as_of))
    got = streams.current_inventory(spark, folder, whole.schema, as_of=as_of)
    want = policy.eav_upsert(whole, whole.limit(0), as_of=as_of)
    assert rows(got, "hierarchy", "value") == rows(want, "hierarchy", "value")


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    keys, schema = ["k"], spark.createDataFrame([], "k string, at long, v string").schema
    table = UpsertTable(spark, str(tmp_path / "t"), schema, keys, buckets=16)
    step = newest(keys, ["at"])
    frame = lambda data: spark.createDataFrame(data, schema)
    assert table.read().count() == 0 and table.merge(frame([]), step) == []
    table.merge(frame([(f"k{n}", 0, "old") for n in range(60)] + [(None, 0, "null key")]), step)
    before = files_of(tmp_path / "t")
    batch = frame([("k7", 5, "new")])
    assert len(table.merge(batch, step)) == 1
    after = files_of(tmp_path / "t")
    changed = {name.split("/")[0] for name, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 1
    want = sorted([(f"k{n}", 0, "old") for n in range(60) if n != 7] + [("k7", 5, "new"), (None, 0, "null key")], key=repr)
    assert rows(table.read()) == want
    # the batch again, and an older row: nothing changes
    table.merge(batch, step)
    table.merge(frame([("k7", 1, "late")]), step)
    assert rows(table.read()) == want
    # a bucket may lose all its rows
    table.merge(frame([(k, 9, None) for k, _, _ in want if k]), lambda old, new: newest(keys, ["at"])(old, new).filter("v IS NOT NULL"))
    assert rows(table.read()) == [(None, 0, "null key")]
    assert rows(UpsertTable(spark, str(tmp_path / "t"), schema, keys, buckets=16).read()) == [(None, 0, "null key")]


CHECK = "instance_guid string, check string, object string, checked_at timestamp, seq long, state string"


def test_transitions_across_batches(spark, tmp_path):
    r = random.Random(2)
    data = [("i", "c", r.choice("ab"), START + timedelta(minutes=n), n, r.choice(["OK", "WARNING"])) for n in range(40)]
    stream, whole = dropped(spark, tmp_path, split(data, 7), CHECK)
    finish(streams.stream_alert_transitions(stream, str(tmp_path / "run")))
    got = spark.read.parquet(str(tmp_path / "run/out"))
    want = streams.transitions(whole)
    assert rows(got, "object", "seq", "previous_state", "state") == rows(want, "object", "seq", "previous_state", "state")


def test_a_restart_from_known_results_repeats_no_change(spark, tmp_path):
    early = [("i", "c", o, START + timedelta(minutes=n), n, s) for n, (o, s) in enumerate((("a", "OK"), ("b", "WARNING"), ("a", "CRITICAL")))]
    late = [("i", "c", o, START + timedelta(minutes=10 + n), n, s) for n, (o, s) in enumerate((("a", "CRITICAL"), ("b", "OK"), ("new", "OK"), ("a", "OK")))]
    stale = [("i", "c", "a", START, 0, "WARNING")]
    stream, _ = dropped(spark, tmp_path, [stale + late[:2], late[2:]], CHECK)
    known = spark.createDataFrame(early, CHECK)
    finish(streams.stream_alert_transitions(stream, str(tmp_path / "run"), known))
    got = spark.read.parquet(str(tmp_path / "run/out"))
    assert rows(got, "object", "previous_state", "state") == [("a", "CRITICAL", "OK"), ("b", "WARNING", "OK"), ("new", None, "OK")]


EVENT = "instance_guid string, event_id long, event_ts timestamp, login_name string, destination_code string"


def failures(n):
    return [
        ("i", k, START + timedelta(minutes=2 * k), "bob" if k % 2 else "eve", code)
        for k in range(n) for code in ("0x0000001c", "0x00000002")
    ]


def test_login_windows_drop_late_rows(spark, tmp_path):
    on_time = failures(60)
    late = [("i", 999, START, "bob", "0x0000001c")]
    stream, whole = dropped(spark, tmp_path, [on_time[:60], on_time[60:], late], EVENT)
    counted = streams.stream_login_failures(stream, threshold=5, window="10 minutes", slide=None)
    finish(streams.stream_extract(counted, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    closed = START + timedelta(minutes=2 * 59 - 10)
    want = (
        whole.filter("destination_code = '0x0000001c' AND event_id <> 999")
        .groupBy("login_name", F.window("event_ts", "10 minutes").alias("w")).count()
        .select("login_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("e"), "count")
        .filter(F.col("e") <= F.lit(closed.isoformat(" ")).cast("timestamp"))
    )
    assert rows(got, "login_name", "window_start", "count") == rows(want, "login_name", "window_start", "count")
    assert {s for (s,) in rows(got, "state")} <= {"OK", "WARNING"}


def test_duplicate_events_across_batches(spark, tmp_path):
    data = failures(20)
    # the second copy of an event may arrive in a later batch
    stream, _ = dropped(spark, tmp_path, [data[0:13], data[13:27], data[27:]], EVENT)
    finish(streams.stream_extract(streams.stream_dedupe_events(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "event_id") == [(k,) for k in sorted(range(20), key=lambda k: repr((k,)))]


def test_extract_reads_only_what_is_new(spark, tmp_path):
    folder, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    spark.range(3).write.parquet(str(folder))
    source = lambda: spark.readStream.schema("id long").parquet(str(folder))
    finish(streams.stream_extract(source(), out, cp))
    spark.range(3, 5).write.mode("append").parquet(str(folder))
    finish(streams.stream_extract(source(), out, cp))
    assert rows(spark.read.parquet(out)) == [(n,) for n in range(5)]


POLICY = "instance_guid string, name string, failed_login_threshold int, monitoring_period_minutes int, login_failure_alert string"


def test_login_totals_equal_the_batch_after_every_batch(spark, tmp_path):
    r = random.Random(4)
    policy_rows = [
        ("i", "_default", 12, 30, "WARNING"), ("i", "Bob", 4, 10, "CRITICAL"), ("i", "off", 0, 10, "WARNING"),
        ("i", "idle", 3, 0, "WARNING"), ("i", "wide", 30, 90, "WARNING"), ("j", "_default", 1, 5, "CRITICAL"), ("k", "eve", 1, 5, "CRITICAL"),
    ]
    data = [
        (g, n, START + timedelta(seconds=20 * n + r.randint(0, 300)), r.choice(("bob", "BOB", "off", "idle", "wide", "eve")), r.choice(("0x0000001c", "0x00000002")))
        for n in range(300) for g in ("i", "j", "k") if g == "i" or n % 4 == 0
    ]
    batches = split(data, 4)
    stream, whole = dropped(spark, tmp_path, batches, EVENT)
    limits = spark.createDataFrame(policy_rows, POLICY)
    folder = str(tmp_path / "run")
    finish(streams.stream_login_totals(stream, limits, folder))
    for n in range(4):
        seen = spark.createDataFrame([d for b in batches[: n + 1] for d in b], EVENT)
        report = spark.read.parquet(f"{folder}/out/batch={n}")
        as_of = report.first()["as_of"]
        newest_failure = max(d[2] for b in batches[: n + 1] for d in b if d[4] == "0x0000001c")
        assert as_of == newest_failure.replace(second=0, microsecond=0) + timedelta(minutes=1)
        assert rows(report.drop("as_of")) == rows(checks.login_totals(seen, limits, as_of=as_of))
    names = {name for (name,) in rows(report.filter("instance_guid = 'i'"), "name")}
    assert {"_Total", "Bob", "wide"} == names  # off and idle are switched off
    assert rows(streams.latest_totals(spark, folder)) == rows(report)
    # at any whole minute within reach, and an instance without a default isn't watched
    at = as_of - timedelta(minutes=3)
    before = whole.filter(F.col("event_ts") < F.lit(at))
    got = streams.LoginMinutes(spark, folder).totals(limits, at)
    assert rows(got) == rows(checks.login_totals(before, limits, as_of=at))
    assert got.filter("instance_guid = 'k'").count() == 0


def test_counter_state_follows_the_keys_touched(spark, tmp_path):
    """A batch that touches one series writes one key of state."""
    first = [("i", 0, START, "o", f"N{k}", "", 1, charts.INSTANT, 0) for k in range(60)]
    second = [("i", 1, START + timedelta(seconds=5), "o", "N7", "", 4, charts.INSTANT, 5)]
    stream, _ = dropped(spark, tmp_path, [first, second], SAMPLE)
    query = streams.stream_counter_rate(stream, str(tmp_path / "run"))
    finish(query)
    updated = [sum(o.numRowsUpdated for o in p.stateOperators) for p in query.recentProgress if p.numInputRows]
    assert updated[0] >= 60 and updated[1] <= 5
    assert rows(spark.read.parquet(str(tmp_path / "run/out")), "counter_name", "val") == [("N7", Decimal("4.00"))]


class CountingHandle:
    """State of one key that counts the calls to it; each is a round trip to the state store."""

    def __init__(self):
        self.calls = 0

    def _state(self, *args):
        handle, held = self, {}

        class State:
            def __getattr__(self, name):
                def call(*given):
                    handle.calls += 1
                    if name in ("update", "updateValue"):
                        held[given[:-1]] = given[-1]
                    elif name in ("get", "getValue"):
                        return held.get(given)
                    elif name == "containsKey":
                        return given in held
                    elif name == "exists":
                        return bool(held)
                    elif name == "iterator":
                        return iter([(k[0], v) for k, v in held.items()])
                    else:
                        held.clear()

                return call

        return State()

    getValueState = getMapState = _state  # noqa: N815


def test_a_key_of_counters_costs_two_state_calls_and_a_row(monkeypatch):
    monkeypatch.setattr(streams, "GIVEN", 6, raising=False)
    names = ["seq", "counter_name", "cntr_value", "cntr_type", "ms_ticks", "sample_micros"]
    row = Row("instance_guid", "object_name", "instance_name", "stem", *names, "has_base")
    sample = lambda n, name, kind, value: row("i", "o", "", "b:x", n, name, value, kind, 10 * n, 100 * n, True)
    batch = lambda lo, hi: iter(
        [sample(n, name, kind, v) for n in range(lo, hi) for name, kind, v in (("X Ratio", charts.RATIO, n), ("X Ratio Base", charts.BASE, 50 + n))]
    )
    rates, handle = streams._Rates(names, None), CountingHandle()
    rates.init(handle)
    seen = []
    for lo, hi, given in ((0, 6, 1), (6, 16, 2), (3, 5, 0)):
        handle.calls = 0
        got = list(rates.handleInputRows(("i", "o", "", "b:x"), batch(lo, hi), None))
        assert (len(got), handle.calls) == (given, 2)
        seen += [s for g in got for s in zip(g.seq, g.base_value, g.was_value, g.was_ticks, g.was_base, strict=True)]
    assert seen == [(n, 50 + n, n - 1, 10 * n - 10, 49 + n) for n in range(1, 16)]


def test_silent_series_are_forgotten(spark, tmp_path):
    sample = lambda n, name, value: ("i", n, START + timedelta(hours=n), "o", name, "", value, charts.INSTANT, n)
    batches = [[sample(0, "a", 1), sample(0, "b", 1)], [sample(20, "b", 2)], [sample(30, "b", 3)], [sample(31, "a", 4), sample(31, "b", 4)]]
    stream, _ = dropped(spark, tmp_path, batches, SAMPLE)
    finish(streams.stream_counter_rate(stream, str(tmp_path / "run"), ttl_days=1, watermark="1 hour"))
    got = rows(spark.read.parquet(str(tmp_path / "run/out")), "counter_name", "seq")
    assert got == [("b", 20), ("b", 30), ("b", 31)]


def test_a_base_may_come_in_the_batch_before_its_counter(spark, tmp_path):
    sample = lambda n, name, kind, value: ("i", n, START + timedelta(seconds=n), "o", name, "", value, kind, n)
    batches = [
        [sample(0, "X Ratio", charts.RATIO, 5), sample(0, "X Ratio Base", charts.BASE, 10)],
        [sample(1, "X Ratio Base", charts.BASE, 20)],
        [sample(1, "X Ratio", charts.RATIO, 5), sample(0, "X Ratio", charts.RATIO, 1)],
    ]
    stream, _ = dropped(spark, tmp_path, batches, SAMPLE)
    finish(streams.stream_counter_rate(stream, str(tmp_path / "run")))
    assert rows(spark.read.parquet(str(tmp_path / "run/out")), "seq", "val") == [(1, Decimal("25.00"))]


@pytest.mark.parametrize("slide", ["5 minutes", None])
def test_window_plans_keep_state_small(spark, tmp_path, slide):
    stream, _ = dropped(spark, tmp_path, [failures(2)], EVENT)
    assert streams.stream_login_failures(stream, slide=slide).isStreaming
