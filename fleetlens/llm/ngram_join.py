"""Exact Jaccard join of whole texts on word shingles, by a token-group matrix.

Texts of the same shingle set form one class.  Classes are put into groups of
similar ones: those that share a min-hash and are verified to link with the
group's leader, so that a group is connected.  The matrix keeps for each group
the union of its tokens twice: as rows (token, group) of the tokens that can
decide a link, and as a hashed bit row.  Groups meet through the first kind;
how much a query can overlap a group is bounded with the second; and only
groups that still qualify are opened, their members compared exactly.

No step pairs the members of a group with each other, and none of them caps
anything: pairs left out are in one component already, or bounded away.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut_lineage
from .components import components
from .joins import join_checked
from .text import NOT_SPACE, SHINGLE, chunks, mix, texts_of

#: Counters of the token frequencies that order the tokens; a fixed 2^23.
COUNTERS = 1 << 23
_BLOCKS = 32
#: Rounds of grouping, each by a min-hash of its own.
ROUNDS = 3
#: Min-hashes of a class; those that aren't its round's key tell how central it is among those of one key.
HASHES = 16
#: Bits of a group's hashed row of the matrix; a class has a finer one too, of twice its tokens.
BITS = 2048
_WORDS = BITS // 64
#: Bits of the filter that names the texts whose sets a step needs; a fixed 2^23.
_FILTER = 1 << 23
_TOKEN_BITS = 58
#: Bits of a class's parity row: a bit tells whether an odd number of its tokens fall on it.
PARITY = 256
#: A large group is asked by shares of its members: the first of so many to so many times that, the next so many times as large.
FIRST_SHARE = 64
SHARES = 8
#: Sizes are kept in 21 bits.
_PART = (1 << 21) - 1


def _sets(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted tokens) of each text."""
    for first, chunk in chunks(texts, NOT_SPACE):
        shingles = mix(chunk.shingles(k)) >> np.uint64(64 - _TOKEN_BITS)
        for i in range(len(chunk.bounds) - 1):
            a, b = chunk.bounds[i], chunk.bounds[i + 1]
            if b - a >= k:
                yield first + i, np.unique(shingles[a : b - k + 1])
            else:
                yield first + i, mix(chunk.text_shingles(i, shingles, k)) >> np.uint64(64 - _TOKEN_BITS)


def _class(tokens: np.ndarray) -> int:
    """Of a set: 64 bits that stand for it."""
    salted = mix(tokens ^ np.uint64(0x51A7E5)).sum(dtype=np.uint64)
    return int(mix(np.array([salted + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def _bits(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, dtype=np.uint8)
    out[tokens & np.uint64(BITS - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def _fine(tokens: np.ndarray) -> bytes:
    width = 1 << max(9, int(2 * len(tokens) - 1).bit_length())
    out = np.zeros(width, dtype=np.uint8)
    out[tokens & np.uint64(width - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Bits that differ between two of these are at most as many as the tokens in one of the two sets only."""
    at = (tokens >> np.uint64(_TOKEN_BITS - 8)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _differing(a: bytes, b: bytes) -> int:
    """Bits that differ, after the wider row is folded to the other's width: so many tokens are in one set only."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _count(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    at, n = np.unique(np.concatenate(sets) & np.uint64(COUNTERS - 1), return_counts=True)
    counts[at] += n.astype(np.int32)


def _profile(rows: DataFrame, k: int) -> DataFrame:
    """Per text its class, size, min-hashes and bit row; per task the counts of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int32)
        salts = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
        schema = pa.schema(
            [("doc_id", pa.int64()), ("rkey", pa.int64()), ("n", pa.int32()), ("cid", pa.int64()), ("mins", pa.list_(pa.int64())),
             ("bits", pa.list_(pa.int64())), ("fine", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())]
        )
        for batch in batches:
            n, cid, mins, bits, fine = [], [], [], [], []
            waiting: list[np.ndarray] = []
            for _, tokens in _sets(texts_of(batch.column(2)), k):
                n.append(len(tokens))
                cid.append(_class(tokens))
                mins.append([int(mix(tokens ^ salt).min().view(np.int64)) if len(tokens) else 0 for salt in salts])
                bits.append(_bits(tokens))
                fine.append(_fine(tokens))
                waiting.append(tokens)
                if len(waiting) == 2000:
                    _count(counts, waiting)
                    waiting = []
            if waiting:
                _count(counts, waiting)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(cid, pa.int64()), pa.array(mins, pa.list_(pa.int64())),
                 pa.array(bits, pa.list_(pa.int64())), pa.array(fine, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema
            )
        if counts.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.minimum(counts, 2**16 - 1).astype(np.uint16).reshape(_BLOCKS, -1)]
            none = pa.nulls(_BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [*(none.cast(t) for t in schema.types[:7]), pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary())],
                schema=schema,
            )

    return rows.mapInArrow(
        run, "doc_id long, rkey long, n int, cid long, mins array<long>, bits array<long>, fine binary, block int, counts binary"
    )


def _token_order(profile: DataFrame) -> np.ndarray:
    """Frequency class of each counter, 0 for ordinary ones; frequent tokens come last in the order.

    The counters are summed and classed by block in tasks; a byte each reaches the driver.
    """
    usual = (profile.agg(F.sum("n")).first()[0] or 0) / COUNTERS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(counts), dtype=np.uint16).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        for block, total in sums.items():
            above = np.maximum(total - usual - 3 * math.sqrt(usual) - 4, 0)
            classes = np.minimum(np.ceil(np.log2(above + 1)), 31).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([classes.tobytes()], pa.binary())], names=["block", "classes"]
            )

    parts = profile.filter("block is not null").select("block", "counts").repartition(_BLOCKS, "block")
    order = np.zeros((_BLOCKS, COUNTERS // _BLOCKS), dtype=np.uint8)
    for r in parts.mapInArrow(add, "block int, classes binary").toLocalIterator():  # a fixed 8 MB, a block at a time
        order[r.block] = np.frombuffer(r.classes, dtype=np.uint8)
    return order.ravel()


def _prefixes(rows: DataFrame, order: Broadcast, k: int, percent: int) -> DataFrame:
    """Per text its size, and in order the tokens one of which any partner must have: all but the last 0.8 n - 1.

    `frequent` is how many of them are of a frequency class above 0; those come last.
    """
    schema = "cid long, n long, frequent long, parity array<long>, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for _, tokens in _sets(texts_of(batch.column(0)), k):
                if n := len(tokens):
                    keys = (order.value[tokens & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(_TOKEN_BITS)) | tokens
                    p = n - -(-percent * n // 100) + 1
                    first = np.sort(np.partition(keys, p - 1)[:p] if p < n else keys).view(np.int64)
                    found.append((_class(tokens), n, int((first >= 1 << _TOKEN_BITS).sum()), _parity(tokens), first))
                if len(found) == 2000:
                    yield columns(found)
                    found = []
            if found:
                yield columns(found)

    def columns(found: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["cid", "n", "frequent", "parity", "prefix"]
        )

    return rows.select("text").mapInArrow(run, schema)


def _needed_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, tokens) of the wanted (cid, rkey), read from the texts again and written.

    A filter of fixed size names the texts; a text that passes without being
    wanted only costs its row.
    """
    slot = f"pmod(rkey, {_FILTER})"
    words = wanted.selectExpr(f"cast({slot} div 64 as int) as w", f"shiftleft(1L, cast({slot} % 64 as int)) as v")
    table = np.zeros(_FILTER // 64, dtype=np.int64)
    for r in words.groupBy("w").agg(F.bit_or("v").alias("v")).collect():  # at most 2^17 rows
        table[r.w] = r.v
    held = rows.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = held.value[batch.column(0).to_numpy() % _FILTER]
            texts = texts_of(batch.column(1).filter(pa.array(hit)))
            cid, sets = [], []
            for _, tokens in _sets(texts, k):
                cid.append(_class(tokens))
                sets.append(tokens.tobytes())
                if len(cid) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "tokens"])
                    cid, sets = [], []
            if cid:
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "tokens"])

    found = rows.select("rkey", "text").mapInArrow(run, "cid long, tokens binary")
    sets = cut_lineage(found.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))
    held.unpersist()
    return sets


def _within(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of two sorted sets: which of the first are in the second."""
    at = np.searchsorted(t, s)
    return t[np.minimum(at, len(t) - 1)] == s


def _popcount(a: Column, b: Column, how) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(how(x, y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the (a, b) those whose sets link, with `shared`, the size of the intersection."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, shared = [], [], []
            for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64)
                both = int(_within(s, t).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
                    shared.append(both)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int64())], names=["a", "b", "shared"])

    full = (
        pairs.select("a", "b")
        .join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("s")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("t")), "b")
    )
    return cut_lineage(full.select("a", "b", "s", "t").mapInArrow(compare, "a long, b long, shared long"))


def _verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the (a, b) those that link, with `shared`, the size of the intersection.

    Tokens whose bits differ are in one set only, so the bit rows bound the
    overlap; what they don't rule out is compared exactly.
    """
    ends = cut_lineage(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    met = join_checked(reps, ends, ["cid"], "left_semi")
    side = lambda x: met.select(F.col("cid").alias(x), *[F.col(c).alias(c + x) for c in ("n", "rkey", "fine")])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            fine = zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)
            differ = np.fromiter((_differing(x, y) for x, y in fine), dtype=np.int64, count=len(na))
            most = np.minimum((na.astype(np.int64) + nb - differ) // 2, np.minimum(na, nb))
            keep = pa.array(100 * most >= percent * (na.astype(np.int64) + nb - most))
            picked = [batch.column(i).filter(keep) for i in (0, 1, 4, 5)]
            yield pa.RecordBatch.from_arrays(picked, names=["a", "b", "rkeya", "rkeyb"])

    sided = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sided = sided.filter(f"na * {percent} <= nb * 100 and nb * {percent} <= na * 100")
    sided = sided.select("a", "b", "na", "nb", "rkeya", "rkeyb", "finea", "fineb")
    likely = sided.mapInArrow(bound, "a long, b long, rkeya long, rkeyb long")
    likely = cut_lineage(likely)
    wanted = likely.selectExpr("a as cid", "rkeya as rkey").union(likely.selectExpr("b", "rkeyb")).distinct()
    sets = _needed_sets(rows, wanted, k)

    return _compared(likely.select("a", "b"), sets, percent)


def _leaders(heads: DataFrame, round_: int) -> DataFrame:
    """(key, a): of the heads with one min-hash the most central, where there are several; the smallest of equals.

    That is the one whose other min-hashes most of them have too.  The copies of an
    original agree with it more than with each other, so it links with most.
    """
    keyed = heads.select("cid", F.col("mins")[round_].alias("key"), "mins")
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    each = keyed.join(shared, "key").select("key", "cid", F.posexplode("mins").alias("at", "min")).filter(F.col("at") != round_)
    each = cut_lineage(each)
    common = each.groupBy("key", "at", "min").agg(F.count("*").alias("c")).filter("c > 1")
    central = each.join(common, ["key", "at", "min"], "left").groupBy("key", "cid").agg(F.sum(F.coalesce("c", F.lit(1))).alias("c"))
    return central.groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("c"), "cid")).getField("cid").alias("a"))


def _groups(reps: DataFrame, rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, (cid, gid) of the groups with more than their leader).

    In each round the leaders left, those of one class included, meet by a min-hash
    of that round; those that link with the most central of their min-hash join its group.
    So a cluster of near copies comes to few groups, and every group is connected.
    """
    heads = reps.select("cid", "mins")
    links, of = None, reps.select("cid", F.col("cid").alias("gid"))
    for round_ in range(ROUNDS):
        keyed = heads.select(F.col("mins")[round_].alias("key"), F.col("cid").alias("b"))
        meet = keyed.join(_leaders(heads, round_), "key").filter("a != b").select("a", "b")
        meet = cut_lineage(meet)
        if links is not None and meet.isEmpty():
            continue
        found = _verified(meet, reps, rows, k, percent)
        links = found if links is None else links.union(found)
        if found.isEmpty():
            continue
        joined = found.select(F.col("b").alias("gid"), F.col("a").alias("to"))
        of = cut_lineage(join_checked(of, cut_lineage(joined), ["gid"], "left").select("cid", F.coalesce("to", "gid").alias("gid")))
        heads = cut_lineage(heads.join(joined.select(F.col("gid").alias("cid")), "cid", "left_anti"))
    many = of.groupBy("gid").agg(F.count("*").alias("c")).filter("c > 1").select("gid")
    return links, cut_lineage(of.join(many, "gid", "left_semi").select("cid", "gid"))


def _differences(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Per (gid, cid, asks): how many of the leader's tokens the class lacks, how many others it has, and all these tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lacks, more, size, diff = [], [], [], []
            for s, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                s, t = np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64)
                r, a = t[~_within(t, s)], s[~_within(s, t)]
                lacks.append(len(r))
                more.append(len(a))
                size.append(len(t))
                diff.append(np.concatenate([r, a]).view(np.int64))
            found = [*(pa.array(c, pa.int64()) for c in (lacks, more, size)), pa.array(diff, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], names=["gid", "cid", "asks", "lacks", "more", "size", "diff"])

    sided = asked.join(sets, "cid").join(sets.select(F.col("cid").alias("gid"), F.col("tokens").alias("leader")), "gid")
    sided = sided.select("gid", "cid", "asks", "tokens", "leader")
    return cut_lineage(sided.mapInArrow(run, "gid long, cid long, asks boolean, lacks long, more long, size long, diff array<long>"))


def _opened(queries: DataFrame, grouped: DataFrame, reps: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b, shared) of the queries (q, q_gid, gid) with members of the groups: some, where there is one.

    A class is its group's leader, less tokens it lacks, and more tokens.  So two classes have in common what is left
    of the leader, and the tokens in which both differ from it: how many of those a link needs follows from the
    numbers alone, (100 + p) * c >= w(q) + w(m) - (100 - p) * size of the leader, with w = 100 * lacks + p * more.  Of a query
    that doesn't link with the leader, w exceeds (100 - p) * size, so any member must share more than about half of
    its own differences with it.  Queries and members meet in the rarest of the differences both sides have, as many as
    decide that; the members that a query has nothing rare in common with are never paired with it.
    """
    own, more = 100 - percent, 100 + percent
    members = join_checked(grouped, cut_lineage(queries.select("gid").distinct()), ["gid"], "left_semi")
    asked = queries.select("gid", F.col("q").alias("cid"), F.lit(True).alias("asks")).union(members.select("gid", "cid", F.lit(False)))
    asked = cut_lineage(asked)
    wanted = cut_lineage(asked.select("cid").distinct())
    sets = _needed_sets(rows, join_checked(reps.select("cid", "rkey"), wanted, ["cid"], "left_semi"), k)
    apart = _differences(asked, sets).withColumn("w", F.expr(f"100 * lacks + {percent} * more - {own} * size"))

    def unanswered(queries: DataFrame, found: DataFrame) -> DataFrame:
        told = queries.join(found.select("q", "gid"), ["q", "gid"], "left_semi").select("q_gid", "gid").distinct()
        return cut_lineage(queries.join(cut_lineage(told), ["q_gid", "gid"], "left_anti").select("q", "q_gid", "gid"))

    # the leaders first: what links with one needs no member
    direct = cut_lineage(apart.filter("asks and w <= 0").selectExpr("cid as q", "gid", "size - lacks as shared"))
    links = direct.selectExpr("q as a", "gid as b", "shared")
    queries = unanswered(queries, direct)
    asking = apart.filter("asks").join(queries.select("gid", F.col("q").alias("cid")), ["gid", "cid"], "left_semi")
    # a member shares all its differences at most, so w of a query has a bound per group; and the other way around
    room = F.expr(f"{percent} * lacks + 100 * more")
    bounds = asking.groupBy("gid").agg(F.min("w").alias("least")).join(apart.filter("not asks").groupBy("gid").agg(F.max(room).alias("most")), "gid")
    bounds = cut_lineage(bounds)
    sides = asking.unionByName(apart.filter("not asks and lacks + more > 0"))
    sides = sides.join(bounds, "gid").filter(F.when(F.col("asks"), F.col("w") <= F.col("most")).otherwise(room >= F.col("least")))
    # a member's w counts the leader's size too: the need of a pair is the sum of both and that once more
    sides = sides.withColumn("w", F.when(F.col("asks"), F.col("w")).otherwise(F.col("w") + own * F.col("size")))
    sides = cut_lineage(sides.select("gid", "cid", "asks", "w", F.explode("diff").alias("tok")))
    both = sides.groupBy("gid", "tok").agg(F.count("*").alias("c"), F.count_if("asks").alias("q")).filter("q > 0 and q < c").select("gid", "tok", "c")
    ordered = sides.join(both, ["gid", "tok"]).groupBy("gid", "cid", "asks", "w").agg(F.array_sort(F.collect_list(F.struct("c", "tok"))).alias("diff"))
    ordered = ordered.select("gid", "cid", "asks", "w", F.size("diff").alias("all"), F.posexplode("diff").alias("at", "d"))
    ordered = ordered.select("gid", "cid", "asks", "w", F.col("d.tok").alias("tok"), (F.col("all") - F.col("at")).alias("left"))
    # a pair is found at its first common token, where what is left on either side still suffices
    ordered = cut_lineage(ordered.filter(f"{more} * left >= w"))
    side = lambda asks, x: ordered.filter(F.col("asks") == asks).select("gid", "tok", *[F.col(c).alias(c + x) for c in ("cid", "w", "left")])
    # a query that links with many members is told by a small share of them: shares grow, and each asks for the rest only
    largest, share, chance = members.groupBy("gid").count().agg(F.max("count")).first()[0] or 0, 1, F.xxhash64("cidm")
    while largest // share >= FIRST_SHARE * SHARES:
        share *= SHARES
    first = share
    while share:
        these = F.pmod(chance, F.lit(share)) == 0
        if share < first:
            these = these & (F.pmod(chance, F.lit(share * SHARES)) != 0)
        some = side(True, "q").join(queries.select("gid", F.col("q").alias("cidq")), ["gid", "cidq"], "left_semi")
        meet = some.join(side(False, "m").filter(these), ["gid", "tok"]).filter(f"{more} * least(leftq, leftm) >= wq + wm")
        meet = cut_lineage(meet.select("gid", F.col("cidq").alias("a"), F.col("cidm").alias("b")).distinct())
        found = _compared(meet, sets, percent)
        links = links.union(found)
        share //= SHARES
        if share:
            queries = unanswered(queries, meet.join(found, ["a", "b"]).select(F.col("a").alias("q"), "gid"))
    return links


def classes_and_links(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = 80
) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, rkey (hash of id and text), n, cid of every text; and the verified links (a, b, shared) of classes.

    The links connect exactly the classes that the full join connects: a link
    that isn't listed lies inside one component of those listed.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("rkey", F.xxhash64("doc_id", "text"))
    profile = cut_lineage(_profile(rows.select("doc_id", "rkey", "text"), k))
    order = rows.sparkSession.sparkContext.broadcast(_token_order(profile))  # a fixed 8 MB
    members = profile.filter("block is null").select("doc_id", "rkey", "n", "cid")
    reps = profile.filter("n > 0").select("cid", "n", "mins", "bits", "fine", "rkey").dropDuplicates(["cid"])
    reps = cut_lineage(reps)

    star, grouped = _groups(reps, rows, k, percent)

    # the matrix: (token, group), with the sizes of the members that have the token, and how many of a member's tokens
    # are left from it on at most; 21 bits each, which only makes sizes from 2^21 on look alike
    prefixes = _prefixes(rows, order, k, percent).dropDuplicates(["cid"]).join(grouped, "cid", "left")
    entries = prefixes.select("cid", "gid", "n", "frequent", "parity", F.posexplode("prefix").alias("at", "tok"))
    entries = entries.select("tok", F.coalesce("gid", "cid").alias("gid"), F.col("gid").isNull().alias("alone"), "n", (F.col("n") - F.col("at")).alias("left"), "frequent", "parity")
    common = F.when(F.col("tok") >= 1 << _TOKEN_BITS, F.col("parity")).alias("parity")
    alone = entries.filter("alone").select("tok", "gid", F.col("n").alias("lo"), F.col("n").alias("hi"), "left", "frequent", common)
    united = entries.filter("not alone").groupBy("tok", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("left").alias("left"), F.max("frequent").alias("frequent"))
    part = lambda c, by: F.shiftleft(F.least(F.col(c), F.lit(_PART)), by)
    sizes = part("lo", 42).bitwiseOR(part("hi", 21)).bitwiseOR(F.least(F.col("left"), F.lit(_PART)))
    united = united.withColumn("parity", F.lit(None).cast("array<long>"))
    matrix = alone.union(united).select("tok", "gid", sizes.alias("sizes"), "frequent", "parity")

    # groups meet in a token if their sizes allow it; in a frequent one only where enough tokens are left on both sides,
    # as must be where the first token that a linked pair shares is frequent, and where the parity rows of two classes
    # without a group differ in no more bits than the tokens of a linked pair may.  Common ordinary tokens are counted
    end = lambda x: matrix.select("tok", F.col("gid").alias(x), F.col("sizes").alias("s" + x), F.col("frequent").alias("f" + x), F.col("parity").alias("p" + x))
    lo, hi, left = (lambda x: f"shiftright(s{x}, 42)"), (lambda x: f"(shiftright(s{x}, 21) & {_PART})"), (lambda x: f"(s{x} & {_PART})")
    ordinary = f"tok < {1 << _TOKEN_BITS}"
    differ = " + ".join(f"bit_count(pa[{i}] ^ pb[{i}])" for i in range(PARITY // 64))
    meet = end("a").join(end("b"), "tok").filter(
        f"a < b and {lo('a')} * {percent} <= {hi('b')} * 100 and {lo('b')} * {percent} <= {hi('a')} * 100 and ({ordinary} or "
        f"(least({left('a')}, {left('b')}) * {100 + percent} >= {percent} * ({lo('a')} + {lo('b')}) and "
        f"coalesce(({differ}) * {100 + percent} <= {100 - percent} * ({lo('a')} + {lo('b')}), true)))"
    )
    pairs = meet.groupBy("a", "b").agg(F.count_if(F.expr(ordinary)).alias("c"), F.max(F.least("fa", "fb")).alias("f"))
    pairs = cut_lineage(pairs)
    order.unpersist()

    # groups whose sizes and common deciding tokens allow a link: the leaders first.  A pair shares its deciding tokens
    # up to where one of the two ends, the counted ones and the frequent ones of either at most, and then no more than
    # the rest of that one: 0.8 of its size, less one
    spans = join_checked(reps, grouped, ["cid"]).groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("many"), *[F.bit_or(F.col("bits")[i]).alias(f"u{i}") for i in range(_WORDS)])
    spans = cut_lineage(spans.select("gid", "lo", "hi", "many", F.array(*[f"u{i}" for i in range(_WORDS)]).alias("union")))
    single = reps.select(F.col("cid").alias("gid"), "n").join(grouped.select(F.col("cid").alias("gid")), "gid", "left_anti")
    sizes = spans.select("gid", "lo", "hi", "many").union(single.select("gid", "n", "n", F.lit(1)))
    end = lambda x: sizes.select(F.col("gid").alias(x), *[F.col(c).alias(c + x) for c in ("lo", "hi", "many")])
    fitting = pairs.join(end("a"), "a").join(end("b"), "b")
    fitting = fitting.filter(f"loa * {percent} <= hib * 100 and lob * {percent} <= hia * 100")
    rest = f"({percent} * greatest(hia, hib) + 99) div 100 - 1"
    fitting = cut_lineage(fitting.filter(f"(c + f + {rest}) * {100 + percent} >= {percent} * (loa + lob)"))
    links = star.union(_verified(fitting, reps, rows, k, percent))

    # groups that are still apart: bound each query of the smaller one by the other's union, then open that one
    label = cut_lineage(components(links))
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias("l" + x))
    apart = fitting.filter("manya > 1 or manyb > 1").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.filter("la is null or lb is null or la != lb")
    asks = apart.select(F.when(F.col("manya") <= F.col("manyb"), F.col("a")).otherwise(F.col("b")).alias("q_gid"),
                        F.when(F.col("manya") <= F.col("manyb"), F.col("b")).otherwise(F.col("a")).alias("gid"))
    asks = cut_lineage(asks)
    if asks.isEmpty():
        return members, links
    in_group = grouped.union(single.select("gid", "gid"))
    queries = in_group.select(F.col("cid").alias("q"), F.col("gid").alias("q_gid")).join(asks, "q_gid")
    queries = cut_lineage(queries)
    queries = join_checked(reps.select(F.col("cid").alias("q"), F.col("n").alias("nq"), F.col("bits").alias("bq")), queries, ["q"])
    bounded = queries.join(spans.select("gid", "union"), "gid")
    outside = _popcount(F.col("bq"), F.col("union"), lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    bounded = bounded.filter(100 * (F.col("nq") - outside) >= percent * F.col("nq")).select("q", "q_gid", "gid")
    return members, links.union(_opened(cut_lineage(bounded), grouped, reps, rows, k, percent))


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, rkey) per document.

    Words are runs of all but ASCII white space, A-Z in lower case; the set is
    the distinct k-word shingles, or the whole sequence where there are fewer
    words.  Two texts link when percent * union <= 100 * intersection.
    `component_id` is the smallest doc_id reachable by links, the own included;
    `component` is a number of the component's own and `rkey` a hash of id and text.

    Null and empty texts have an empty set and link with nothing: each is alone.
    Rows of equal text link, also rows with equal doc_id.  A null doc_id is never
    the smallest, unless all of a component are null.  Other columns are not read.
    """
    members, links = classes_and_links(documents, doc_id, text, k, percent)
    labels = components(links).withColumnRenamed("node", "cid")
    least = members.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    least = least.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    by_label = least.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = least.join(by_label, "label").select("cid", "component_id", F.col("label").alias("component"))
    found = members.join(by_class, "cid", "left")
    none = F.col("n") == 0
    return found.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(none, F.col("rkey")).otherwise(F.col("component")).alias("component"),
        "rkey",
    )


def keep_one(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = 80
) -> DataFrame:
    """`documents` with one of each component: the smallest doc_id, nulls last, then the smallest `rkey`.

    Rows of equal doc_id and text count once; texts without words stay, one row
    for each doc_id.
    """
    found = near_duplicates(documents, doc_id, text, k, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rkey"))
    kept = cut_lineage(found.groupBy("component").agg(first.alias("first")).select(F.col("first.rkey").alias("__rkey")))
    key = F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))
    return documents.withColumn("__rkey", key).join(kept, "__rkey", "left_semi").dropDuplicates(["__rkey"]).drop("__rkey")
