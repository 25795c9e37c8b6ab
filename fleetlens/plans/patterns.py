"""Matching names against LIKE patterns without a nested-loop join.

A name can only match a pattern all of whose literal runs, the text between
wildcards, occur in it.  Each pattern row is keyed by its longest run in any of
its columns, names by their substrings of the lengths that are in use, and the
full patterns are verified on what meets.  Both sides are tables of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import like_regex

_WILD = r"%|_|\[[^\]]*\]?"


def longest_run(pattern: Column, column: int) -> Column:
    """(size, column, run): the longest literal run of a pattern, in lower case; a NULL pattern is `%`."""
    runs = F.split(F.lower(F.coalesce(pattern, F.lit("%"))), _WILD)
    return F.array_max(
        F.transform(runs, lambda r: F.struct(F.length(r).alias("size"), F.lit(column).alias("column"), r.alias("run")))
    )


def match_patterns(
    names: DataFrame, patterns: DataFrame, pairs: list[tuple[str, str]], keys: list[str],
) -> DataFrame:
    """Distinct names joined to every pattern row they satisfy.

    `pairs` are (name column, pattern column); a NULL pattern means `%`.  `keys`
    are equality columns present on both sides.  Duplicate names should be
    removed by the caller.  Only a row without any literal meets every name of
    its key, all of which it matches, but for names shorter than its `_`.
    """
    best = F.greatest(*[longest_run(F.col(p), n) for n, (_, p) in enumerate(pairs)]) if len(pairs) > 1 else longest_run(F.col(pairs[0][1]), 0)
    keyed = patterns.withColumn("__best", best).select(
        "*", F.col("__best.column").alias("__column"), F.col("__best.run").alias("__run"),
        *[like_regex(F.col(p)).alias(f"__regex{n}") for n, (_, p) in enumerate(pairs)],
    ).drop("__best")
    used = keyed.groupBy(*keys).agg(F.collect_set(F.struct("__column", F.length("__run").alias("size"))).alias("__used"))
    texts = F.array(*[F.lower(F.rtrim(F.col(n))) for n, _ in pairs])

    def parts(u: Column) -> Column:
        text = F.element_at(texts, u["__column"] + 1)
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - u["size"] + 1, F.lit(1)))
        found = F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, u["size"])))
        return F.transform(F.when(u["size"] == 0, F.array(F.lit(""))).when(F.length(text) >= u["size"], found).otherwise(F.array().cast("array<string>")), lambda run: F.struct(u["__column"].alias("__column"), run.alias("__run")))

    probe = names.join(used, keys).withColumn("__probe", F.explode(F.flatten(F.transform("__used", parts))))
    probe = probe.select(*names.columns, "__probe.__column", "__probe.__run")
    matched = probe.join(keyed, [*keys, "__column", "__run"])
    full = [F.col(p).isNull() | F.rlike(F.rtrim(F.col(n)), F.col(f"__regex{i}")) for i, (n, p) in enumerate(pairs)]
    return matched.filter(reduce(lambda a, b: a & b, full)).drop("__column", "__run", *[f"__regex{i}" for i in range(len(pairs))])
