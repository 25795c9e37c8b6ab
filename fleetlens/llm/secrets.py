"""Secrets in texts: fixed patterns, and strings that look random to a character Markov model.

Column expressions only; a text is searched within its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Strings that the Markov models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"
_CODES = 128


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Matches in order: (start, kind, end, value), in code points; those whose group is shorter than `least` go.

    What lies between the matches comes from a split by the same pattern, so a
    match starts where the pieces and matches before it end.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    shape = "struct<at:int,out:array<struct<start:int,kind:int,end:int,value:string>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value"))
        kept = F.when(F.length(x["value"]) >= least, F.concat(state["out"], F.array(one))).otherwise(state["out"])
        return F.when(x["whole"].isNull(), state).otherwise(F.struct(end.alias("at"), kept.alias("out"))).cast(shape)

    spans = F.aggregate(found, begin.cast(shape), add)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, each leftmost and non-overlapping, by start, then kind."""
    assign = _spans(text, ASSIGN, "assign", group=2, least=6)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def labelled_samples(documents: DataFrame, text: str = "text", most: int = 20_000) -> DataFrame:
    """(token, is_random): values of fixed-kind spans and digests of texts, in base 64, as
    random strings; and the words of texts without such spans, alone, joined
    in the ways identifiers and paths are, and rulers, as ordinary ones.

    Fits on a bounded sample: about `most` texts of either sort, even by hash.
    """
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    any_span = F.col("t").rlike(ASSIGN) | F.col("t").rlike(ACCESS) | F.col("t").rlike(HEX)
    rows = rows.withColumn("hit", any_span)
    n = {r.hit: r.n for r in rows.groupBy("hit").agg(F.count("*").alias("n")).collect()}
    spread = F.xxhash64("t", F.lit(13)) / F.lit(2.0**64) + F.lit(0.5)
    with_hits = rows.filter(F.col("hit") & (spread * n.get(True, 0) < most))
    values = F.explode(F.transform(base_spans(F.col("t")), lambda s: s["value"]))
    without = rows.filter(~F.col("hit") & (spread * n.get(False, 0) < most))
    words = F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    some = F.slice(F.regexp_extract_all("t", F.lit(r"[A-Za-z]{2,}"), F.lit(0)), 1, 40)
    lower = F.transform(some, F.lower)
    joined = F.array(
        F.concat_ws("", F.transform(some, lambda w: F.initcap(w))),
        *[F.concat_ws(sign, lower) for sign in "_-/"],
        F.upper(F.concat_ws("_", lower)),
        *[F.lit(sign * 40) for sign in "_-=/+"],
    )
    digest = F.base64(F.unhex(F.sha2("t", 256)))
    return (
        with_hits.select(values.alias("token"), F.lit(True).alias("is_random"))
        .union(without.select(digest, F.lit(True)))
        .union(without.select(words, F.lit(False)))
        .union(without.select(F.explode(joined), F.lit(False)))
    )


def _pairs(value: Column, of) -> Column:
    """`of` the codes of each two neighbouring characters; the string is taken apart once for either side."""
    codes = F.transform(F.split(value, ""), F.ascii)
    n = F.length(value) - 1
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), of)


def log_ratios(samples: DataFrame) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary) by 128 * char + next.

    Counts of character pairs of all sample tokens, summed on Spark; at most
    2 * 128^2 numbers reach the driver.  Pairs are smoothed towards the
    frequency of the next character; without samples all ratios are 0.
    """
    pair = F.explode(_pairs(F.col("token"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    pairs = samples.filter(F.length("token") > 1).select("is_random", pair.alias("p")).select("is_random", "p.*")
    pairs = pairs.filter(f"x < {_CODES} and y < {_CODES}")
    counted = pairs.groupBy("is_random", "x", "y").agg(F.count("*").alias("n")).collect()
    if len({r.is_random for r in counted}) < 2:
        return [0.0] * (_CODES * _CODES)
    symbols = {r.y for r in counted} | {r.x for r in counted}
    out = [0.0] * (_CODES * _CODES)
    for sign, label in ((1, True), (-1, False)):
        rows = [r for r in counted if r.is_random == label]
        total, of_next, of_char, n = sum(r.n for r in rows), {}, {}, {}
        for r in rows:
            of_next[r.y] = of_next.get(r.y, 0) + r.n
            of_char[r.x] = of_char.get(r.x, 0) + r.n
            n[r.x, r.y] = r.n
        for x in symbols:
            for y in symbols:
                back = (of_next.get(y, 0) + 1) / (total + len(symbols))
                out[x * _CODES + y] += sign * math.log((n.get((x, y), 0) + 8 * back) / (of_char.get(x, 0) + 8))
    return out


def find(
    documents: DataFrame, ratios: list[float], text: str = "text", least_mean: float = 0.7, least_total: float = 14.0
) -> DataFrame:
    """Add `base` and `spans`: arrays of (start, kind, end, value) over the whole text, by start, then kind.

    `spans` has the base ones and, of kind `random`, the strings whose
    log-likelihood ratio is `least_total` or more and `least_mean` or more a
    pair, where no base span overlaps them.  A null text is empty and has no
    spans; equal rows get equal spans.  Columns named like the two are replaced.
    """
    table = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = documents.withColumn("base", base_spans(t))

    def ratio(value: Column) -> Column:
        scores = _pairs(value, lambda x, y: F.element_at(table, x * _CODES + y + 1))
        return F.aggregate(scores, F.lit(0.0), lambda total, score: total + score)

    def looks_random(span: Column) -> Column:
        total = ratio(span["value"])
        clear = ~F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return clear & (total >= least_total) & (total >= least_mean * (F.length(span["value"]) - 1))

    more = F.filter(_spans(t, TOKEN, "random"), looks_random)
    return rows.withColumn("spans", F.array_sort(F.concat("base", more)))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    )
