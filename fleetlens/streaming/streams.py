"""Structured Streaming versions of the polled operators.

Windowed counts and de-duplication use the engine's own state; so do operators that
look at the row before (rates, error pairs, transitions), as keyed state in its
state store: a batch writes the keys it touches.  Tables kept current by a stream
are upserted by hash bucket: a batch rewrites the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from itertools import chain
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.semantics import KEY
from ..operators.charts import BASE, RATED, base_stem, rate_value
from ..operators.checks import LOGIN_FAILURE, longest_period, totals_of_minutes
from ..operators.history import HEADER, catalogued_pairs
from ..operators.policy import eav_upsert
from ..plans.adjacent import previous_row
from .upsert import UpsertTable, newest

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs this state store; queries take the setting when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_login_failures(
    events: DataFrame, threshold: int = 60, alert: str = "WARNING", watermark: str = "10 minutes",
    window: str = "60 minutes", slide: str | None = "5 minutes",
) -> DataFrame:
    """Failures per login and window with their state; tumbling without `slide`.

    Rows later than the watermark are dropped; a window is emitted once it has
    passed.
    """
    span = F.window("event_ts", window, slide) if slide else F.window("event_ts", window)
    counted = (
        events.filter(F.col("destination_code") == "0x0000001c")
        .withWatermark("event_ts", watermark)
        .groupBy(KEY, "login_name", span.alias("w"))
        .agg(F.count("*").alias("count"))
    )
    return counted.select(
        KEY, "login_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count",
        F.when(F.col("count") >= threshold, alert).otherwise("OK").alias("state"),
    )


def stream_dedupe_events(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """One of each pair of events that differ only in their destination."""
    return events.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark([KEY, "event_id"])


def stream_extract(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new since the last run; offsets take the place of marks."""
    return (
        source.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def start(result: DataFrame, folder: str, *, available_now: bool = True) -> StreamingQuery:
    """Append the rows of a stateful stream to `folder/out`."""
    writer = result.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start(f"{folder}/out")


# -- login failures by policy -------------------------------------------------------


class LoginMinutes:
    """Failures per login and minute, as a stream leaves them, and what the policy makes of them."""

    COLUMNS = f"{KEY} string, login_key string, minute timestamp, n long, batch long"

    def __init__(self, spark: SparkSession, folder: str):
        schema = spark.createDataFrame([], self.COLUMNS).schema
        self.spark, self.folder = spark, folder
        self.table = UpsertTable(spark, f"{folder}/minutes", schema, [KEY, "login_key"])

    def clock(self) -> datetime | None:
        """The end of the newest minute with a failure; one value."""
        return self.table.read().agg((F.max("minute") + F.expr("INTERVAL 1 MINUTE")).alias("t")).first()["t"]

    def totals(self, policy_login: DataFrame, as_of: datetime | Column) -> DataFrame:
        """`login_totals` at a whole minute, from the minutes before it."""
        now = as_of if isinstance(as_of, Column) else F.lit(as_of)
        age = ((F.unix_seconds(now) - F.unix_seconds("minute")) / 60).cast("long")
        minutes = self.table.read().filter(F.col("minute") < now)
        return totals_of_minutes(minutes.select(KEY, "login_key", age.alias("age"), "n"), policy_login)


def stream_login_totals(
    events: DataFrame, policy_login: DataFrame, folder: str, watermark: str = "10 minutes", *, available_now: bool = True
) -> StreamingQuery:
    """Failures of each watched login and in total, over the window and against the threshold its policy names.

    State is the engine's count per login and minute.  Minutes that changed, open ones
    too, are upserted into `folder/minutes`; each batch then sums them by policy,
    every login over its own period and the total over the default one, as of the
    end of the newest minute, into `folder/out/batch=<id>`.  A threshold or period of zero
    switches a login off.  Events later than the watermark are dropped.  Minutes
    older than the longest period and the watermark leave the table when their
    bucket is next written.
    """
    spark = events.sparkSession
    counted = (
        events.filter(F.col("destination_code") == LOGIN_FAILURE)
        .withWatermark("event_ts", watermark)
        .groupBy(KEY, F.lower("login_name").alias("login_key"), F.window("event_ts", "1 minute").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(KEY, "login_key", F.col("w.start").alias("minute"), "n")
    )
    minutes = LoginMinutes(spark, folder)
    keep = newest([KEY, "login_key", "minute"], ["batch", "n"])
    # the session's longest window and delay: rows older than both can't count or change any more
    span = F.expr(f"INTERVAL {longest_period(policy_login)} MINUTE") + F.expr(f"INTERVAL {watermark}")

    def run(changed: DataFrame, batch_id: int) -> None:
        changed = changed.withColumn("batch", F.lit(batch_id).cast("long")).persist()
        try:
            latest = changed.agg(F.max("minute").alias("t")).first()["t"]  # one value
            if latest is None:
                return
            old = lambda rows: rows.filter(F.col("minute") >= F.lit(latest) - span)
            minutes.table.merge(changed, lambda have, more: old(keep(have, more)))
            now = minutes.clock()
            report = minutes.totals(policy_login, now).withColumn("as_of", F.lit(now))
            report.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        finally:
            changed.unpersist()

    writer = counted.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the newest batch."""
    reports = spark.read.parquet(f"{folder}/out")
    last = reports.agg(F.max("batch").alias("batch"))
    return reports.join(last, "batch").drop("batch")


# -- counter rates ------------------------------------------------------------------

KEYS = (KEY, "object_name", "instance_name")
#: Per series its last sample, as lists side by side, and the newest base.
_KEPT = (
    "names array<string>, micros array<long>, seqs array<long>, cntr_values array<long>, ticks array<long>, "
    "base_values array<long>, base_seq long, base_value long"
)
#: Samples in one row that the processor gives, at most.
GIVEN = 4096


class _Rates(StatefulProcessor):
    """The last sample of each counter of one stem, and of the base counter they share.

    Samples of a key come in any order within a batch; those not later than the last
    sample of their series are left out.  A key's state is one value, read and written once a
    batch, and its rated samples leave as lists, one for each column: what a key and a row of Python cost is most of the run.
    """

    def __init__(self, columns: list[str], ttl_ms: int | None):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = next(rows)
        at = [first.__fields__.index(c) for c in self.columns]
        micros, seq, kind, name, value, ticks = (
            first.__fields__.index(c) for c in ("sample_micros", "seq", "cntr_type", "counter_name", "cntr_value", "ms_ticks")
        )
        samples = sorted(map(tuple, chain([first], rows)), key=itemgetter(micros, seq))
        kept = self.kept.get()
        *series, base_seq, base_value = kept if kept is not None else ([], [], [], [], [], [], None, None)
        last = {s[0]: s[1:] for s in zip(*series, strict=True)}
        bases = {r[seq]: r[value] for r in samples if r[kind] == BASE}
        if bases:  # the newest base is kept, for counters whose batch comes without it
            base_seq = max(bases)
            base_value = bases[base_seq]
        elif base_seq is not None:
            bases = {base_seq: base_value}
        has_base = key[3] is not None and key[3].startswith("b:")
        rated = Row(*KEYS, *self.columns, "base_value", "was_value", "was_ticks", "was_base")
        out: list[tuple] = []
        for r in samples:
            if r[kind] not in RATED:
                continue
            was = last.get(r[name])
            if was is not None and (r[micros], r[seq]) <= was[:2]:
                continue
            if was is not None and self.ttl_ms is not None and r[micros] - was[0] > self.ttl_ms * 1000:
                was = None  # forgotten, whether or not the timer has run
            base = bases.get(r[seq]) if has_base else None
            if was is not None:
                out.append((*[r[i] for i in at], base, *was[2:]))
                if len(out) == GIVEN:
                    yield rated(*key[:3], *map(list, zip(*out, strict=True)))
                    out = []
            last[r[name]] = (r[micros], r[seq], r[value], r[ticks], base)
        if out:
            yield rated(*key[:3], *map(list, zip(*out, strict=True)))
        series = [list(c) for c in zip(*((n, *s) for n, s in last.items()), strict=True)] or [[] for _ in range(6)]
        self.kept.update((*series, base_seq, base_value))
        if self.ttl_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(samples[-1][micros] // 1000 + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Nothing came for the time to live: the stem is forgotten."""
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        return


def stream_counter_rate(
    samples: DataFrame, folder: str, ttl_days: int | None = None, watermark: str = "1 hour", *, available_now: bool = True
) -> StreamingQuery:
    """Counter rates of a sample stream; state is the last sample of each series.

    A ratio or average has one key with its base counter, so both meet without a
    join; every other series is a key of its own.  A series is never forgotten, unless
    `ttl_days` is given: then a sample so many days after the last one of its series gets
    no rate, the watermark clears keys that are silent for so long, and samples later than the
    watermark are dropped.  A base that comes in another batch than its counter must come before it.
    """
    keyed_state(samples.sparkSession)
    stem = base_stem(F.col("counter_name"), F.col("cntr_type"))
    rows = samples.withColumn("stem", F.coalesce(F.concat(F.lit("b:"), stem), F.concat(F.lit("c:"), "counter_name")))
    rows = rows.withColumn("sample_micros", F.unix_micros("sample_ts"))
    rows = rows.drop("sample_ts") if ttl_days is None else rows.withWatermark("sample_ts", watermark)
    columns = [c for c in rows.columns if c not in (*KEYS, "stem", "sample_ts")]
    kinds = dict(rows.dtypes)
    lists = {c: kinds[c] for c in columns} | dict.fromkeys(("base_value", "was_value", "was_ticks", "was_base"), "bigint")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in KEYS), *(f"`{c}` array<{kind}>" for c, kind in lists.items())])
    ttl = None if ttl_days is None else int(timedelta(days=ttl_days).total_seconds() * 1000)
    given = rows.groupBy(*KEYS, "stem").transformWithState(
        _Rates(columns, ttl), schema, "Append", "None" if ttl is None else "EventTime"
    )
    stepped = given.select(*KEYS, F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in lists])))
    previous = F.struct(
        F.col("was_value").alias("cntr_value"), F.col("was_ticks").alias("ms_ticks"), F.col("was_base").alias("base_value")
    )
    rated = stepped.withColumn("previous", previous).withColumn("sample_ts", F.timestamp_micros("sample_micros"))
    return start(rated.withColumn("val", rate_value()).select(*samples.columns, "val"), folder, available_now=available_now)


# -- error pairs --------------------------------------------------------------------

_PAIR = f"{KEY} string, at long, source string, message_header string, message string, complete boolean"
_Pair = Row(KEY, "at", "source", "message_header", "message", "complete")


class _PendingHeader(StatefulProcessor):
    """A header that ends a slice waits for the first line of the next slice, or for its time to be up."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "at long, source string, message_header string, due long")

    def _drop(self) -> None:
        due = self.pending.get()[3]
        self.pending.clear()
        self.handle.deleteTimer(due)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        waiting = self.pending.get() if self.pending.exists() else None
        had = waiting is not None
        for r in sorted(rows, key=lambda r: r.slice_end):
            if waiting is not None:
                yield _Pair(key[0], waiting[0], waiting[1], waiting[2], r.first, True)
            for p in r.inside:
                yield _Pair(key[0], p["at"], p["source"], p["header"], p["message"], True)
            last = r.last
            waiting = None if last is None else (last["at"], last["source"], last["header"], last["at"] // 1000 + self.timeout_ms)
        if had:
            self._drop()
        if waiting is not None:
            self.pending.update(tuple(waiting))
            self.handle.registerTimer(waiting[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            at, source, header, due = self.pending.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.pending.clear()
                yield _Pair(key[0], at, source, header, None, False)

    def close(self) -> None:
        return


def stream_error_pairs(
    error_log: DataFrame, messages: DataFrame, folder: str, *, sanitize: bool = False, watermark: str = "10 minutes",
    slice: str = "1 minute", timeout: timedelta = timedelta(hours=1), available_now: bool = True,
) -> StreamingQuery:
    """Error headers with the line that follows, as `log_error_pairs` gives them, from a live log.

    Lines are gathered per instance and slice of time until the watermark has passed it, so their
    order is final however they arrive, and a busy instance is many groups.  Pairs inside a
    slice are found there; only they and a slice's two edges go on to the state of
    their instance, which pairs neighbouring slices.  A header that no line
    follows within `timeout` of event time is given out with `complete` false: its text
    is the catalogue's when sanitized, NULL otherwise.
    """
    keyed_state(error_log.sparkSession)
    line = F.struct(F.unix_micros("log_date").alias("at"), "source", "seq", "message")
    slices = (
        error_log.withWatermark("log_date", watermark)
        .groupBy(KEY, F.window("log_date", slice).alias("w"))
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
    )

    def header(of: Column) -> Column:
        return of["message"].ilike(HEADER)

    paired = F.transform(
        F.slice("lines", 1, F.size("lines") - 1),
        lambda x, i: F.struct(
            x["at"].alias("at"), x["source"].alias("source"), x["message"].alias("header"),
            F.get("lines", i + 1)["message"].alias("message"),
        ),
    )
    last = F.element_at("lines", -1)
    edges = slices.select(
        KEY, F.window_time("w").alias("closed"), F.unix_micros("w.end").alias("slice_end"),
        F.filter(paired, lambda p: p["header"].ilike(HEADER)).alias("inside"),
        F.element_at("lines", 1)["message"].alias("first"),
        F.when(header(last), F.struct(last["at"].alias("at"), last["source"].alias("source"), last["message"].alias("header"))).alias("last"),
    )
    found = edges.groupBy(KEY).transformWithState(
        _PendingHeader(int(timeout.total_seconds() * 1000)), _PAIR, "Append", "EventTime"
    )
    pairs = found.withColumn("log_date", F.timestamp_micros("at"))
    named = catalogued_pairs(pairs, messages, sanitize=sanitize, also=("complete",))
    return start(named, folder, available_now=available_now)


# -- inventory ----------------------------------------------------------------------

_EAV = ("hierarchy", "property")
_EAV_COLUMNS = [KEY, *_EAV, "value", "lastseen", "seq"]


def inventory_table(spark: SparkSession, folder: str, schema) -> UpsertTable:
    return UpsertTable(spark, f"{folder}/state", schema, [KEY, *_EAV])


def stream_eav_upsert(
    source: DataFrame, folder: str, *, as_of: datetime | str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Inventory kept current in hash buckets; `current_inventory` reads it.

    A batch rewrites the buckets its keys fall into.  Without `as_of` retention counts
    from the newest value seen in the batch; buckets that a batch doesn't touch are
    purged when read.
    """
    rows = source.select(*_EAV_COLUMNS)
    table = inventory_table(source.sparkSession, folder, rows.schema)

    def run(batch: DataFrame, batch_id: int) -> None:
        now = as_of
        if now is None:
            seen = batch.agg(F.max("lastseen").alias("t")).first()["t"]  # one value
            now = seen if seen is not None else datetime(1900, 1, 1)
        table.merge(batch, lambda have, more: eav_upsert(have, more, as_of=now))

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_inventory(spark: SparkSession, folder: str, schema, *, as_of: datetime | str) -> DataFrame:
    """The inventory as of a time: what retention keeps."""
    have = inventory_table(spark, folder, schema).read()
    return eav_upsert(have, have.limit(0), as_of=as_of)


# -- alert transitions --------------------------------------------------------------


class _LastState(StatefulProcessor):
    """The last result of one object; a result that differs from the one before goes on."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "checked_micros long, seq long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        change = Row(*self.columns, "previous_state")
        for r in sorted(rows, key=lambda r: (r.checked_micros, r.seq)):
            if last is not None and (r.checked_micros, r.seq) <= last[:2]:
                continue
            if last is None or last[2] != r.state:
                yield change(*[r[c] for c in self.columns], None if last is None else last[2])
            last = (r.checked_micros, r.seq, r.state)
        if last is not None:
            self.last.update(last)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState.checked_micros, initialState.seq, initialState.state))

    def close(self) -> None:
        return


_CHECKED = [KEY, "check", "object", "checked_at", "seq", "state"]


def stream_alert_transitions(
    checks: DataFrame, folder: str, known: DataFrame | None = None, *, available_now: bool = True
) -> StreamingQuery:
    """A row whenever (instance, check, object) changes state.

    `checks` has checked_at and seq besides the check columns.  State is the
    last result of each object.  `known`, of the same columns, holds results from
    before: its last one of each object seeds the state of a new checkpoint, so a stream that is
    started anew repeats no change.  Otherwise the first result of an object counts as a
    change.  Results not later than the last one of their object are left out.
    """
    keyed_state(checks.sparkSession)
    keys = [KEY, "check", "object"]

    def plain(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.unix_micros("checked_at").alias("checked_micros"), "seq", "state")

    rows = plain(checks)
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", previous_state string"
    seeds = None
    if known is not None:
        last = plain(known).groupBy(*keys).agg(F.max(F.struct("checked_micros", "seq", "state")).alias("s"))
        seeds = last.select(*keys, "s.*").groupBy(*keys)
    changed = rows.groupBy(*keys).transformWithState(_LastState(rows.columns), schema, "Append", "None", seeds)
    out = changed.withColumn("checked_at", F.timestamp_micros("checked_micros")).select(*_CHECKED, "previous_state")
    return start(out, folder, available_now=available_now)


def transitions(results: DataFrame) -> DataFrame:
    """Results whose state differs from the one before of the same object."""
    stepped = previous_row(
        results, [KEY, "check", "object"], "checked_at", ["checked_at", "seq"], ["state"]
    )
    return stepped.filter(
        F.col("previous").isNull() | (F.col("previous.state") != F.col("state"))
    ).select(
        *results.columns, F.col("previous.state").alias("previous_state")
    )
