"""Column expressions with the meanings the monitored servers use.

Each helper is a composition of built-in functions, so it stays inside
whole-stage code generation.  Times are instants; sessions run in UTC.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "instance_guid"
PAGES_PER_MB = 128
MB = "decimal(20,2)"

SANITIZED_NOTICE = "SANITIZE_DATASET is enabled. Please investigate on the SQL Instance."


def instant(value: datetime | str | Column) -> Column:
    """A timestamp literal; strings and datetimes are read in the session zone."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp")


def _boundaries(start: Column, end: Column, seconds: int) -> Column:
    return (
        F.floor(F.unix_seconds(end) / seconds) - F.floor(F.unix_seconds(start) / seconds)
    ).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    """Hour boundaries crossed: 00:59 to 01:01 is one hour."""
    return _boundaries(start, end, 3600)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed."""
    return _boundaries(start, end, 60)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_seconds(end) - F.unix_seconds(start)).cast("long")


def name_key(name: Column) -> Column:
    """Names compare without case."""
    return F.lower(name)


def quote_name(name: Column) -> Column:
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def clean_text(text: Column) -> Column:
    """Halve double spaces once, drop line breaks, defuse `","`, trim blanks."""
    once = F.replace(text, F.lit("  "), F.lit(" "))
    flat = F.replace(F.replace(once, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))
    return F.trim(F.replace(flat, F.lit('","'), F.lit('";"')))


def iso_with_offset(ts: Column) -> Column:
    """ISO-8601 with milliseconds and the session's numeric offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")


def pages_to_cents(pages: Column) -> Column:
    """Hundredths of a megabyte, rounded half up, in integer arithmetic."""
    return F.shiftright(pages.cast("long") * 100 + PAGES_PER_MB // 2, 7)


def cents_to_mb(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MB)


def pages_to_mb(pages: Column) -> Column:
    return cents_to_mb(pages_to_cents(pages))


def agent_timestamp(run_date: Column, run_time: Column) -> Column:
    """Integers yyyymmdd and hhmmss to an instant; NULL for no such time."""
    return F.try_make_timestamp(
        F.floor(run_date / 10000).cast("int"),
        F.floor(run_date % 10000 / 100).cast("int"),
        (run_date % 100).cast("int"),
        F.floor(run_time / 10000).cast("int"),
        F.floor(run_time % 10000 / 100).cast("int"),
        (run_time % 100).cast("int"),
    )


def agent_seconds(run_duration: Column) -> Column:
    """Integer HHMMSS to seconds."""
    return (
        F.floor(run_duration / 10000) * 3600
        + F.floor(run_duration % 10000 / 100) * 60
        + run_duration % 100
    ).cast("long")


def duration_text(ms: Column) -> Column:
    """`dd hh:mm:ss.mss`; at least two digits of days."""
    ms = ms.cast("long")
    whole = F.floor(ms / 1000)
    days = F.floor(whole / 86400).cast("string")

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    return F.concat(
        F.when(F.length(days) < 2, F.lpad(days, 2, "0")).otherwise(days),
        F.lit(" "),
        two(F.floor(whole % 86400 / 3600)),
        F.lit(":"),
        two(F.floor(whole % 3600 / 60)),
        F.lit(":"),
        two(whole % 60),
        F.lit("."),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def like_regex(pattern: Column) -> Column:
    """LIKE pattern with `%`, `_` and `[...]` classes as an anchored regex."""
    p = pattern
    # one-character classes of a wildcard stand for the character itself
    for wild, mark in (("[%]", "\u0001"), ("[_]", "\u0002"), ("[[]", "\u0003")):
        p = F.replace(p, F.lit(wild), F.lit(mark))
    p = F.regexp_replace(p, r"([\\.$|?*+(){}]|(?<!\[)\^)", r"\\$1")
    for wild, rx in (("%", ".*"), ("_", "."), ("\u0001", "%"), ("\u0002", "_"), ("\u0003", r"\[")):
        p = F.replace(p, F.lit(wild), F.lit(rx))
    return F.concat(F.lit("(?is)^"), p, F.lit("$"))


def like_text(pattern: str) -> str:
    """A constant pattern for `Column.ilike`: one-character classes become escapes."""
    out = pattern.replace("\\", "\\\\")
    return out.replace("[_]", "\\_").replace("[%]", "\\%").replace("[[]", "[")
