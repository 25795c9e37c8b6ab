"""Session snapshots: filters, deltas, waits, blocking, locks and log use."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import KEY, duration_text, instant, like_text
from ..plans.fixpoint import subtree_sizes
from ..plans.listing import listed

# fixed values: what a session filter can look at
FILTER_COLUMNS = {
    "program": "program_name", "login": "login_name", "host": "host_name", "database": "database_name",
}
DELTA_COLUMNS = (
    "reads", "writes", "cpu", "tempdb_allocations", "used_memory", "physical_io", "physical_reads", "tempdb_current",
    "context_switches", "max_used_memory",
)

# fixed values: transaction isolation levels
ISOLATION = {
    0: "Unspecified", 1: "ReadUncomitted", 2: "ReadCommitted", 3: "Repeatable", 4: "Serializable",
    5: "Snapshot",
}


def _matches(kind: str, pattern: str) -> Column | None:
    if kind == "session":
        number = int(pattern or 0)
        return F.col("session_id") == number if number else None
    if kind not in FILTER_COLUMNS:
        raise ValueError(f"cannot filter by {kind!r}")
    return F.col(FILTER_COLUMNS[kind]).ilike(like_text(pattern)) if pattern else None


def session_filter(
    sessions: DataFrame, type: str = "session", pattern: str = "", not_type: str = "session",
    not_pattern: str = "",
) -> DataFrame:
    """Sessions that match one pattern and do not match another; empty means no filter."""
    wanted, unwanted = _matches(type, pattern), _matches(not_type, not_pattern)
    out = sessions if wanted is None else sessions.filter(wanted)
    return out if unwanted is None else out.filter(~unwanted)


def session_interest(
    sessions: DataFrame, sleeping: int = 1, system: bool = False, own_id: int | None = None
) -> DataFrame:
    """Sessions worth showing.

    `sleeping`: 0 hides sleeping sessions, 1 shows those with an open
    transaction, 2 shows all.
    """
    out = sessions
    if sleeping == 0:
        out = out.filter(F.col("status") != "sleeping")
    elif sleeping == 1:
        out = out.filter((F.col("status") != "sleeping") | (F.col("open_tran_count") > 0))
    elif sleeping != 2:
        raise ValueError("sleeping must be 0, 1 or 2")
    if not system:
        out = out.filter("is_user_process")
    if own_id is not None:
        out = out.filter(F.col("session_id") != own_id)
    return out


def session_delta(
    sessions: DataFrame, *, from_ts: datetime | str, to_ts: datetime | str,
    columns: Sequence[str] = DELTA_COLUMNS,
) -> DataFrame:
    """Later snapshot with the change of each measure since the earlier one.

    NULL unless the same request (same start) is in both and the change is not
    negative.  Both snapshots come from one pass: rows are grouped per request
    with conditional maxima instead of a self join.
    """
    early, late = F.col("snapshot_ts") == instant(from_ts), F.col("snapshot_ts") == instant(to_ts)
    paired = sessions.filter(early | late).groupBy(KEY, "session_id", "request_id").agg(
        F.max(F.when(early, F.col("start_time"))).alias("first_start"),
        F.max(F.when(late, F.col("start_time"))).alias("start_time"),
        *[F.max(F.when(early, F.col(c))).alias(f"first_{c}") for c in columns],
        *[F.max(F.when(late, F.col(c))).alias(c) for c in columns],
    ).filter(F.col("start_time").isNotNull())
    same = F.col("first_start") == F.col("start_time")

    def change(c: str) -> Column:
        moved = F.col(c) - F.col(f"first_{c}")
        return F.when(same & (moved >= 0), moved).alias(f"{c}_delta")

    return paired.select(KEY, "session_id", "request_id", "start_time", *columns, *[change(c) for c in columns])


def wait_rollup(waits: DataFrame) -> DataFrame:
    """Waits per collection, request and type with a rank: blocked first, then most tasks.

    The window runs over the distinct wait types of one request, a few hundred
    at most, not over its tasks.
    """
    request = [KEY, "snapshot_ts", "session_id", "request_id"]
    rolled = waits.filter(F.col("wait_ms") > 0).groupBy(*request, "wait_type").agg(
        F.count("*").alias("tasks"),
        F.min("wait_ms").alias("min_ms"),
        F.floor(F.sum("wait_ms") / F.count("*")).cast("long").alias("avg_ms"),
        F.max("wait_ms").alias("max_ms"),
        F.max(F.col("blocking_session_id").isNotNull()).alias("is_blocked"),
    )
    order = Window.partitionBy(*request).orderBy(
        F.col("is_blocked").desc(), F.col("tasks").desc(), F.col("wait_type")
    )
    return rolled.withColumn("rank", F.row_number().over(order))


def wait_format(rollup: DataFrame) -> DataFrame:
    """`(Ax: B/C/Dms)E` per request, best rank first.

    One task shows its time, two show both, three or more the minimum, average
    and maximum.
    """
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    times = (
        F.when(F.col("tasks") == 1, text("min_ms"))
        .when(F.col("tasks") == 2, F.concat(text("min_ms"), F.lit("/"), text("max_ms")))
        .otherwise(F.concat(text("min_ms"), F.lit("/"), text("avg_ms"), F.lit("/"), text("max_ms")))
    )
    one = F.concat(F.lit("("), text("tasks"), F.lit("x: "), times, F.lit("ms)"), F.col("wait_type"))
    return (
        rollup.withColumn("one", one)
        .groupBy(KEY, "snapshot_ts", "session_id", "request_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "one"))).alias("all"))
        .select(KEY, "snapshot_ts", "session_id", "request_id", F.array_join("all.one", ", ").alias("wait_info"))
    )


def block_leaders(sessions: DataFrame) -> DataFrame:
    """Sessions blocked by each session, directly or through others, in each snapshot.

    A blocker may change between snapshots, so each snapshot is a forest of its
    own.  Sessions that block each other in a ring count all others they reach.
    """
    one = F.struct(KEY, "snapshot_ts").alias("at")
    links = sessions.select(one, "session_id", "blocking_session_id").distinct()
    return subtree_sizes(links, "at", "session_id", "blocking_session_id").select(
        f"at.{KEY}", "at.snapshot_ts", F.col("node").alias("session_id"), (F.col("size") - 1).alias("blocked_session_count")
    )


def lock_rollup(locks: DataFrame) -> DataFrame:
    """Lock requests of a collection counted and nested by object.

    The inner array is bounded by lock modes times states, not by the locks.
    """
    at = [KEY, "snapshot_ts", "session_id", "request_id", "database_name", "resource_type", "schema_name", "object_name"]
    is_database = F.col("resource_type") == "DATABASE"
    placed = locks.withColumn(
        "object_name",
        F.when(~is_database, F.coalesce("object_name", F.lit("(null)"))),
    ).withColumn("schema_name", F.when(~is_database, F.col("schema_name")))
    counted = placed.groupBy(*at, "request_mode", "request_status").agg(F.count("*").alias("request_count"))
    return counted.groupBy(*at).agg(
        F.sum("request_count").alias("request_count"),
        F.array_sort(
            F.collect_list(F.struct("request_mode", "request_status", "request_count"))
        ).alias("locks"),
    )


def tran_log_rollup(tran_log: DataFrame) -> DataFrame:
    """Log records, kB, first write and implicit flag per collection, request and database."""
    return tran_log.groupBy(KEY, "snapshot_ts", "session_id", "request_id", "database_name").agg(
        F.coalesce(F.sum("log_records"), F.lit(0)).alias("log_record_count"),
        F.floor(F.coalesce(F.sum("log_bytes"), F.lit(0)) / 1024).cast("long").alias("log_kb_used"),
        F.min("begin_time").alias("transaction_start_time"),
        F.max((F.col("name") == "implicit_transaction").cast("int")).alias("implicit_tran"),
    )


def tran_log_format(rollup: DataFrame) -> DataFrame:
    """A line `database: records (kB kB)` per request and database, with the request's first write and flag."""
    line = F.concat(
        F.coalesce("database_name", F.lit("(null)")), F.lit(": "), F.col("log_record_count").cast("string"),
        F.lit(" ("), F.col("log_kb_used").cast("string"), F.lit(" kB)"),
    )
    request = [KEY, "snapshot_ts", "session_id", "request_id"]
    totals = rollup.groupBy(*request).agg(
        F.min("transaction_start_time").alias("transaction_start_time"),
        F.max("implicit_tran").alias("implicit_tran"),
    )
    texts = listed(rollup.withColumn("line", line), request, {"tran_log_write": "line"})
    return texts.drop("copies").join(totals, request)


def avg_elapsed(requests: DataFrame, statement_stats: DataFrame) -> DataFrame:
    """Requests with the historical mean duration of their statement."""
    mean = statement_stats.select(
        KEY, "statement_id",
        F.expr("total_elapsed_ms div nullif(execution_count, 0)").alias("avg_elapsed_ms"),
    )
    return requests.join(mean, [KEY, "statement_id"], "left")


def activity_view(df: DataFrame, columns: str, sort: str = "") -> DataFrame:
    """Columns and order from bracketed lists such as `[a][b%]` and `[a] DESC[b]`.

    `%` stands for any rest of a name; unknown names are ignored; a name is
    taken at its first mention.
    """
    known = {c.lower(): c for c in df.columns}

    def named(token: str) -> list[str]:
        if "%" not in token:
            return [known[token.lower()]] if token.lower() in known else []
        rx = re.compile(".*".join(re.escape(p) for p in token.split("%")), re.IGNORECASE)
        return [c for c in df.columns if rx.fullmatch(c)]

    chosen: list[str] = []
    for token in re.findall(r"\[([^\]]*)\]", columns):
        chosen += [c for c in named(token) if c not in chosen]
    if not chosen:
        raise ValueError("no known column is listed")
    keys: dict[str, Column] = {}
    for token, direction in re.findall(r"\[([^\]]*)\]([^\[]*)", sort):
        for c in named(token):
            keys.setdefault(c, F.desc(c) if "desc" in direction.lower() else F.asc(c))
    return (df.orderBy(*keys.values()) if keys else df).select(*chosen)


def duration_format(ms: Column) -> Column:
    """`dd hh:mm:ss.mss`."""
    return duration_text(ms)


def running_requests(
    requests: DataFrame, session_info: DataFrame, connections: DataFrame, own_id: int | None = None
) -> DataFrame:
    """Active requests with their session, connection and current statement.

    Offsets count bytes of two-byte characters; an end of -1 is the end of the
    text.  The statement starts at character offset/2 counted from 1, so an
    offset of 0 leaves the last character out, as the reports show it.
    """
    active = requests.filter(~F.lower("status").isin("background", "sleeping"))
    if own_id is not None:
        active = active.filter(F.col("session_id") != own_id)
    start = F.floor(F.col("statement_start_offset") / 2).cast("int")
    end = F.when(
        F.col("statement_end_offset") == -1, F.length(F.rtrim("text")) * 2
    ).otherwise(F.col("statement_end_offset"))
    length = F.floor((end - F.col("statement_start_offset")) / 2).cast("int")
    # position 0 is one before the text
    statement = F.substring(
        F.col("text"), F.greatest(start, F.lit(1)), F.greatest(length - F.when(start < 1, 1 - start).otherwise(0), F.lit(0))
    )
    level = F.col("transaction_isolation_level").cast("string")
    for code, name in ISOLATION.items():
        level = F.when(F.col("transaction_isolation_level") == code, name).otherwise(level)
    login = F.when(F.col("login_name") == F.col("original_login_name"), F.col("login_name")).otherwise(
        F.concat("login_name", F.lit(" ("), "original_login_name", F.lit(")"))
    )
    return (
        active.join(session_info, [KEY, "session_id"], "left")
        .join(connections, [KEY, "connection_id"], "left")
        .select(
            KEY, "session_id", "request_id", "status", "host_name", "client_net_address",
            login.alias("login_name"), "program_name", "command", statement.alias("statement"),
            "start_time", F.col("total_elapsed_time").alias("total_elapsed_time_ms"),
            level.alias("transaction_isolation_level_name"),
        )
    )
