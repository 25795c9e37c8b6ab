"""Repair of conversation structure by depth-first branch and bound.

Turns are kept, given another role, deleted or put in until the roles read
system (optional), then user and assistant in turn.  The search over one
conversation's edits keeps an explicit stack, bounds what is left, holds the best
repair found (cost, audit), and per node (row, state) a table of the least cost
it was reached with, which ends worse prefixes, until nothing cheaper is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import cut_lineage
from ..plans.ranking import numbered

#: Costs of the edits; a truncated row that isn't deleted costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"

# states: nothing yet, after a system turn, after a user's, after an assistant's
_NEXT = (2, 2, 3, 2)
_DONE = (0, 3)
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
_CODES = {2: ("u", "U"), 3: ("a", "A")}


def _moves(row: str, state: int) -> list[tuple[str, int, int]]:
    """(code, cost, state after) of the edits that use up a row, in the order of their initials D, K, R.

    `row` is the role's initial (s, u, a, or o for others) and its fault: `x` must be
    deleted, `t` is truncated, `.` is sound.  Codes: D, K, and u or a for the
    role a row is given; U and A are turns put in.
    """
    moves = [("D", DELETE, state)]
    if row[1] != "x":
        extra = TRUNCATED if row[1] == "t" else 0
        kept = _KEEP[row[0]].get(state)
        if kept is not None:
            moves.append(("K", extra, kept))
        if kept != _NEXT[state]:  # the same role costs less kept
            moves.append((_CODES[_NEXT[state]][0], REROLE + extra, _NEXT[state]))
    return moves


def suffix_bounds(rows: Sequence[str], block: int) -> list[list[int]]:
    """A lower bound of the cost from row i on in each state, i = 0 to len(rows).

    Exact to the end of the row's block; later blocks count with their cheapest
    way through, from any state to any.
    """
    n = len(rows)

    def with_inserts(costs: list[int]) -> list[int]:
        for _ in range(2):  # a second one may follow the first
            costs = [min(costs[q], INSERT + costs[_NEXT[q]]) for q in range(4)]
        return costs

    unknown = 10**18
    ahead = with_inserts([0 if q in _DONE else unknown for q in range(4)])
    bounds = [ahead]
    for i in reversed(range(n)):
        if (i + 1) % block == 0 and i + 1 < n:
            ahead = [min(ahead)] * 4
        ahead = with_inserts([min(cost + ahead[after] for _, cost, after in _moves(rows[i], q)) for q in range(4)])
        bounds.append(ahead)
    bounds.reverse()
    return bounds


def cheapest_edits(rows: Sequence[str], block: int = 64) -> tuple[int, list[str]]:
    """(cost, codes) of the cheapest repair; of equal ones that with the least audit.

    The audit is the edits' initials in order.  Children are visited in the order of
    their initials, so repairs come up in the order of their audits and a later
    one of equal cost never wins, neither as a whole nor as a prefix at a node.
    `codes` holds, per row, what is put in before it and its own edit, and at last
    what is put in after all.
    """
    n = len(rows)
    bounds = suffix_bounds(rows, max(block, n // 16))
    # a first dive along the bounds gives a cost to beat or to equal
    i = q = spent = 0
    while i < n or q not in _DONE:
        moves = [(cost + bounds[i + 1][after], cost, i + 1, after) for _, cost, after in _moves(rows[i], q)] if i < n else []
        moves.append((INSERT + bounds[i][_NEXT[q]], INSERT, i, _NEXT[q]))
        _, cost, i, q = min(moves)
        spent += cost
    best, audit = spent + 1, []
    reached = [1 << 62] * (4 * (n + 1))
    stack: list[tuple[int, int, int, int, str]] = [(0, 0, 0, 0, "")]
    path: list[str] = []
    while stack:
        i, q, spent, depth, code = stack.pop()
        if spent >= reached[4 * i + q] or spent + bounds[i][q] >= best:
            continue
        reached[4 * i + q] = spent
        path[max(depth - 1, 0) :] = [code] if depth else []
        if i == n and q in _DONE:
            best, audit = spent, path.copy()
            continue
        moves = [(c, cost, i + 1, after) for c, cost, after in _moves(rows[i], q)] if i < n else []
        moves.insert(1 if moves else 0, (_CODES[_NEXT[q]][1], INSERT, i, _NEXT[q]))  # D, I, K, R
        stack.extend((at, after, spent + cost, depth + 1, c) for c, cost, at, after in reversed(moves))
    codes, pending = [], ""
    for code in audit:
        pending += code
        if code not in "UA":
            codes.append(pending)
            pending = ""
    return best, [*codes, pending]


class Repair(NamedTuple):
    """What `repair` returns: a row per conversation, and the repaired turns."""

    conversations: DataFrame
    turns: DataFrame


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 64
) -> Repair:
    """Faults and cheapest repair of each conversation, and the repaired turns.

    `conversations`: (conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit).  `turns`: (conv, place, step, role, text), ordered by place and step within
    a conversation; steps number the turns that one place gives.

    Rows are ordered by turn (nulls first), then role and text; repeated rows stand
    together.  A null role or text counts as one space, a null conversation is one of
    its own.  An empty role has no initial and can't be kept.  An empty table gives none.  Texts are compared and returned whole.  Other
    columns aren't read.

    Numbering spreads a long conversation over several tasks, and texts
    are told apart by group, so no window holds a conversation.  The search takes a
    conversation's initials and faults, two letters a row, as the audit it returns has one.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    rows = df.select(
        key.alias("__key"), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("__id"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("__id")]
    rows = cut_lineage(numbered(rows, "__key", order, "place").drop("__id"))

    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    trimmed = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    signs = rows.select(
        "__key", "place", said.alias("said"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (trimmed == "").alias("is_blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("unfinished"),
    )
    again = signs.groupBy("__key", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    fault = (
        F.when(F.col("is_blank"), "b").when(F.col("place") > F.col("first"), "d").when(F.col("unfinished"), "t").otherwise(".")
    )
    signs = signs.join(again, ["__key", "said"], "left").select("__key", "place", "initial", fault.alias("fault"))
    listed = F.array_sort(F.collect_list(F.struct("place", "initial", "fault")))
    signs = signs.groupBy("__key").agg(
        listed.alias("l"), *[F.sum((F.col("fault") == f).cast("long")).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    )
    joined = lambda each: F.array_join(F.transform("l", each), "")
    initials = joined(lambda r: r["initial"])
    signs = signs.select(
        "__key", "blank", "duplicate", "truncated",
        (F.length(initials) - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).cast("long").alias("illegal"),
        joined(lambda r: F.concat(r["initial"], F.translate(r["fault"], "bd", "xx"))).alias("signs"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(5).to_pylist()
            found = [cheapest_edits([s[i : i + 2] for i in range(0, len(s), 2)], block) for s in strings]
            cost, codes = pa.array([c for c, _ in found], pa.int64()), pa.array([e for _, e in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], cost, codes], names=schema.fieldNames())

    schema = T.StructType([*signs.schema.fields[:5], *T._parse_datatype_string("cost long, codes array<string>").fields])
    searched = cut_lineage(signs.mapInArrow(search, schema))

    turns = rows.select("__key", "turn").distinct().groupBy("__key")
    span = F.try_subtract(F.max("turn"), F.min("turn"))
    gaps = F.coalesce(F.try_subtract(F.try_add(span, F.lit(1)), F.count("turn")), F.when(F.count("turn") == 0, 0))
    ids = rows.groupBy("__key").agg(F.first("conv").alias("conv"))
    audit = F.translate(F.array_join("codes", ""), "uaUA", "RRII")
    conversations = (
        searched.withColumn("audit", audit).join(turns.agg(gaps.alias("gaps")), "__key").join(ids, "__key")
        .select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    )

    edits = searched.select("__key", F.posexplode("codes").alias("place", "code")).filter("code NOT IN ('', 'D')")
    edits = edits.withColumn("place", (F.col("place") + 1).cast(dict(rows.dtypes)["place"]))
    # rows put in after the last one have no row of their own, so the id comes by key
    met = edits.join(rows.select("__key", "place", "role", "text"), ["__key", "place"], "left").join(ids, "__key")
    letter = met.select("conv", "place", F.posexplode(F.split("code", "")).alias("step", "c"), "role", "text").filter("c NOT IN ('', 'D')")
    c = F.col("c")
    return Repair(
        conversations,
        letter.select(
            "conv", "place", "step",
            F.when(c.isin("u", "U"), "user").when(c.isin("a", "A"), "assistant").otherwise(F.col("role")).alias("role"),
            F.when(c.isin("U", "A"), "").otherwise(F.col("text")).alias("text"),
        ),
    )


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the `role:text` lines of repaired turns, joined by line feeds.

    A SHA-256 is taken in order, so a conversation's lines stream through one task, a
    batch at a time.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    lines = turns.select(key.alias("__key"), "conv", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("__key").sortWithinPartitions("__key", "place", "step").select("__key", "conv", "line")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, digest = None, None, None
        names = ["conv", "repaired_sha256"]
        for batch in batches:
            ids, found = [], []
            for k, c, line in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if k == key:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        ids.append(conv)
                        found.append(digest.hexdigest())
                    key, conv, digest = k, c, hashlib.sha256()
                digest.update(line.encode())
            kind = batch.schema.field("conv").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string())], names=names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=names)

    schema = T.StructType([turns.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    return lines.mapInArrow(hashed, schema)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`df` with faults of known kinds, at places the checksum of `conv:turn` decides.

    Modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?`, 3 repeats
    it, 4 gives it the role user.  Nulls read as one space, but conv and turn are
    returned as they are.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    found = df.withColumn("__kind", kind).filter("__kind <> 0")
    k = F.col("__kind")
    spoiled = F.when(k == 1, "").when(k == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (
        found.withColumn(text, spoiled).withColumn(role, F.when(k == 4, "user").otherwise(space(role)))
        .withColumn("__copy", copies).drop("__kind", "__copy")
    )
