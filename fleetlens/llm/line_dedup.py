"""Removal of lines that many sites share, by the spread of their distinct sites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut_lineage

#: Sites from which on a line is boilerplate.
MIN_SITES = 8
#: Registers of a sketch are 2^LG_K; the estimate is trusted beyond three standard errors.
LG_K = 12
_ERROR = 3 * 1.04 / math.sqrt(1 << LG_K)
_BLANK = " \t\r"


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def text_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """(tkey, line) of every line but blank ones, by hash; `tkey` stands for the text."""
    lines = documents.select(_key(F.col(text)).alias("tkey"), F.explode(F.split(F.col(text), "\n")).alias("l"))
    lines = lines.select("tkey", _trimmed(F.col("l")).alias("l")).filter("l != ''")
    return lines.select("tkey", F.xxhash64("l").alias("line"))


def boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(line) hashes of lines that occur on `min_sites` sites or more, in two or more distinct texts.

    Every site of every row counts; a line of one text only is no boilerplate,
    however many sites copy that text.  Each line has a HyperLogLog sketch of its sites,
    built before the shuffle and merged after it; only lines whose estimate is
    within three standard errors of the bound get an exact distinct count.  A
    null site is the site ''.
    """
    lines = documents.select(
        _key(F.col(text)).alias("tkey"), F.coalesce(F.col(site), F.lit("")).alias("site"), F.explode(F.split(F.col(text), "\n")).alias("l")
    )
    lines = lines.select("tkey", "site", _trimmed(F.col("l")).alias("l")).filter("l != ''")
    pairs = lines.groupBy(F.xxhash64("l").alias("line"), "site")
    seen = pairs.agg(F.min("tkey").alias("low"), F.max("tkey").alias("high"))
    several = F.min("low") < F.max("high")
    seen = cut_lineage(seen)
    spread = seen.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about"), several.alias("several")
    )
    low, high = math.floor(min_sites * (1 - _ERROR)), math.ceil(min_sites * (1 + _ERROR))
    spread = cut_lineage(spread.filter(F.col("several") & (F.col("about") >= low)).select("line", "about"))
    near = spread.filter(F.col("about") <= high).select("line")
    exact = seen.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("n"))
    return spread.filter(F.col("about") > high).select("line").union(exact.filter(F.col("n") >= min_sites).select("line"))


def dedupe_lines(
    documents: DataFrame,
    min_sites: int = MIN_SITES,
    text: str = "text",
    site: str = "source",
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """`documents` without cross-site boilerplate lines, with the `counts` of lines and of removed ones.

    Lines end at a line feed and are compared without blanks around them; blank
    lines stay, and so does the order.  The lines go from every text, whatever
    share of it they are.  Only a text that would keep no line, and that other
    rows have word for word, is a copy as a whole, which is for a near-duplicate
    step: it stays as it is.  A null text stays null, with no lines; an empty one has one.
    All rows and columns come back; columns named like the counts are replaced.

    The lines to cut come to each text by a join on its hash, however many there are.
    """
    bad = cut_lineage(boilerplate(documents, min_sites, text, site))
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in counts]
    hits = text_lines(documents, text).join(bad, "line", "left_semi").distinct()
    strip = hits.groupBy(F.col("tkey").alias("__tkey")).agg(F.collect_list("line").alias("__strip"))
    rows = documents.select(*kept, _key(F.col(text)).alias("__tkey")).join(strip.hint("merge"), "__tkey", "left")
    lines = F.split(F.col(text), "\n")
    rest = F.col("__some")
    good = F.filter(lines, lambda line: ~F.array_contains("__strip", F.xxhash64(_trimmed(line))))
    rows = rows.withColumn("__some", F.when(F.col("__strip").isNull(), lines).otherwise(good)).drop("__strip")
    emptied = (F.size(rest) < F.size(lines)) & F.forall(rest, lambda line: _trimmed(line) == "")
    emptied = F.coalesce(emptied, F.lit(False))
    # texts that would keep no line are few and short: they learn whether they come again
    again = rows.filter(emptied).groupBy("__tkey").agg((F.count("*") > 1).alias("__copy"))
    rows = rows.join(cut_lineage(again.filter("__copy")).hint("merge"), "__tkey", "left")
    carrier = (F.size(rest) < F.size(lines)) & F.col("__copy").isNull()
    rows = rows.withColumn("__rest", F.when(carrier, rest))
    removed = F.when(F.col("__rest").isNotNull(), F.size(lines) - F.size("__rest")).otherwise(0)
    return rows.select(
        *[F.coalesce(F.array_join("__rest", "\n"), F.col(text)).alias(c) if c == text else F.col(f"`{c}`")
          for c in documents.columns if c not in counts],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]),
        removed.cast("long").alias(counts[1]),
    )
