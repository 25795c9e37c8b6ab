"""Mixing sources to target weights by entropy balancing.

Of all document rates w, those nearest to 1 in relative entropy that give each
source its target of words, none above `most`, are w = min(most, exp(l * x)): x is
the document's size, l its source's dual variable.  The dual is convex; Newton
steps over a table of (source, size, count) solve it for all sources at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut_lineage
from ..plans.ranking import numbered
from .joins import join_checked

_KEY = ["no_source", "source"]
#: Steps of the rounding scale per copy.
_STEPS = 1024


def sized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, no_source, source, size, u): words of the whole text, and a number in [0, 1) fixed by the row."""
    u = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return documents.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        u.alias("u"),
    )


def shared_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(no_source, source, source_size, least, spread, target) per source.

    Sources in code point order, null last, weigh `weights`, repeating, and share
    the words of all.  A target stops at `most` times its source's size; what is
    over is shared again by weight.  That is one level for all sources that
    aren't full, found by raising it until no more fill up.
    """
    per_source = sizes.groupBy(*_KEY).agg(
        F.sum("size").alias("source_size"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        # the mean size as seen from a word
        (F.sum(F.col("size").cast("double") * F.col("size")) / F.greatest(F.sum("size"), F.lit(1))).alias("spread"),
    )
    ranked = numbered(per_source.withColumn("__all", F.lit(0)), "__all", [F.col(c) for c in _KEY], "rank").drop("__all")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = cut_lineage(ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).drop("rank"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("source_size") * most < F.col("weight") * level
        over, free = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))
        ).first()
        raised = (total - (over or 0)) / free if free else math.inf
        if raised <= level or not free:
            break
        level = raised
    share = F.least(F.col("weight") * F.lit(min(level, 1e300)), F.col("source_size").cast("double") * most)
    return cut_lineage(ranked.withColumn("target", share.cast("double")).drop("weight"))


def _rate(size: Column, tilt: Column, spread: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * size / spread, F.lit(50.0))))


def solve_tilts(sizes: DataFrame, targets: DataFrame, most: float = 3, rounds: int = 80) -> DataFrame:
    """`targets` with `tilt`, the dual variable of each source.

    Newton steps kept inside a bracket that each step narrows; a step that
    leaves it is replaced by the middle.  A source whose target is `most` times
    its size, where no finite tilt solves it, has an infinite one; one with
    target or size 0 takes nothing and gets minus infinity.
    """
    table = cut_lineage(sizes.filter("size > 0").groupBy(*_KEY, "size").agg(F.count("*").alias("c")))
    some = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    end = math.log(most) * 1.000001
    state = targets.withColumn("open", some).withColumn(
        "tilt", F.when(some, 0.0).when(F.col("target") > 0, math.inf).otherwise(-math.inf)
    )
    state = state.withColumn("low", F.lit(-math.inf)).withColumn("high", F.lit(end) * F.col("spread") / F.col("least"))
    state = cut_lineage(state)
    for _ in range(rounds):
        if state.filter("open").isEmpty():
            break
        at = join_checked(table, state.filter("open").select(*_KEY, "tilt", "spread"), _KEY)
        words = (F.col("c") * F.col("size")).cast("double")
        rate = _rate(F.col("size"), F.col("tilt"), F.col("spread"), most)
        slope = F.when(rate < most, words * rate * F.col("size") / F.col("spread")).otherwise(0.0)
        now = at.groupBy(*_KEY).agg(F.sum(words * rate).alias("got"), F.sum(slope).alias("slope"))
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("tilt") - miss / F.col("slope"))
        middle = F.when(low == -math.inf, high - 1 - F.abs(high)).otherwise((low + high) / 2)
        near = F.abs(miss) <= 1e-10 * F.col("target")
        near = near | ((low > -math.inf) & ((high - low) <= 1e-13 * F.greatest(F.abs(high), F.abs(low))))
        moved = F.when(near, F.col("tilt")).when((step > low) & (step < high), step).otherwise(middle)
        stepped = state.join(now, _KEY, "left").select(
            *targets.columns,
            (F.col("open") & ~near).alias("open"),
            F.when(F.col("open"), moved).otherwise(F.col("tilt")).alias("tilt"),
            F.when(F.col("open"), low).otherwise(F.col("low")).alias("low"),
            F.when(F.col("open"), high).otherwise(F.col("high")).alias("high"),
        )
        state = cut_lineage(stepped)
    # sums of doubles differ in their last digits from run to run; the tilts kept don't
    return cut_lineage(state.withColumn("tilt", F.when(F.abs("tilt") == math.inf, F.col("tilt")).otherwise(F.round("tilt", 7))).drop("open", "low", "high"))


def _largest_fit(events: DataFrame, room: DataFrame) -> DataFrame:
    """(source, upto, used): the last step whose events, with all before, fit in `room`.

    `events` is (source, step, size) with a bounded number of steps, summed first.
    """
    sums = events.groupBy(*_KEY, "step").agg(F.sum("size").alias("words"))
    run = Window.partitionBy(*_KEY).orderBy("step")
    cum = sums.withColumn("used", F.sum("words").over(run)).join(room, _KEY)
    fit = cum.filter(F.col("used") <= F.col("room") + 1e-6).groupBy(*_KEY)
    return fit.agg(F.max("step").alias("upto"), F.max("used").alias("used"))


def copies(sizes: DataFrame, tilts: DataFrame, most: int = 3, refinements: int = 5) -> DataFrame:
    """`sizes` with source_size, target, rate and copies: rates rounded to whole copies, 0 to `most`.

    A document takes floor(rate + u + t) copies; t is one number a source, the
    largest step at which the source stays within its target.  What is then
    missing is filled up, several times, with one more copy of documents that
    fit into it, in an order fixed by u.
    """
    rated = join_checked(sizes, tilts, _KEY)
    rate = F.when(F.col("tilt") == math.inf, float(most)).when(F.col("tilt") == -math.inf, 0.0)
    rate = rate.otherwise(_rate(F.col("size"), F.col("tilt"), F.col("spread"), most))
    rated = cut_lineage(rated.withColumn("rate", rate).drop("tilt", "spread", "least"))
    step_of = lambda m: F.ceil((m - F.col("rate") - F.col("u") + most + 1) * _STEPS)
    each = F.explode(F.array(*[step_of(F.lit(m)) for m in range(1, most + 1)])).alias("step")
    room = tilts.select(*_KEY, F.col("target").alias("room"))
    first = cut_lineage(_largest_fit(rated.filter("size > 0").select(*_KEY, each, "size"), room))
    taken = F.lit(0)
    for m in range(1, most + 1):
        taken = taken + F.when((step_of(F.lit(m)) <= F.col("upto")) & (F.col("size") > 0), 1).otherwise(0)
    state = join_checked(rated, first.select(*_KEY, "upto"), _KEY, "left")
    state = cut_lineage(state.withColumn("copies", taken).drop("upto"))
    left = room.join(first, _KEY, "left").select(*_KEY, (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
    for turn in range(refinements):
        left = cut_lineage(left)
        open_ = join_checked(state, left, _KEY)
        step = F.floor(F.pmod(F.xxhash64("u", "doc_id", F.lit(turn)), F.lit(4 * _STEPS)))
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("copies") < most)
        more = cut_lineage(_largest_fit(open_.filter(fits).select(*_KEY, step.alias("step"), "size"), left))
        if more.isEmpty():
            break
        state = join_checked(open_, more.select(*_KEY, "upto"), _KEY, "left")
        state = state.withColumn("copies", F.col("copies") + F.when(fits & (step <= F.col("upto")), 1).otherwise(0)).drop("upto", "room")
        state = cut_lineage(state)
        left = left.join(more, _KEY, "left").select(*_KEY, (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
    return state


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) per document.

    `taken` = copies * size words.  A null source is one of its own, the last; a
    null or empty text has size 0 and no copy.  Rows of equal doc_id and text
    get the same number of copies, within the last refinements.  An empty table
    gives none.  Other columns are not read.
    """
    sizes = cut_lineage(sized(documents, doc_id, text, source))
    tilts = solve_tilts(sizes, shared_targets(sizes, weights, most), most)
    found = copies(sizes, tilts, most)
    return found.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
