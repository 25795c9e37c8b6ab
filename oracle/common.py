"""Pieces shared by the checking statements."""

from __future__ import annotations

from fleetlens.sources.adapters import AS_OF, AS_OF_EVENTS, duckdb_ctes

ORACLE: dict[str, str] = {}

NOW = f"TIMESTAMP '{AS_OF}'"
NOW_EV = f"TIMESTAMP '{AS_OF_EVENTS}'"
CODE = (
    "CASE WHEN upper(state) IN ('NA','OK') THEN 0 WHEN upper(state) = 'WARNING' THEN 1 "
    "WHEN upper(state) = 'CRITICAL' THEN 2 ELSE 3 END"
)


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00'"


def quoted(expr: str) -> str:
    return f"'[' || replace({expr}, ']', ']]') || ']'"


def clean(expr: str) -> str:
    return (
        f"trim(replace(replace(replace(replace({expr}, '  ', ' '), chr(10), ''), chr(13), ''), "
        "'\",\"', '\";\"'))"
    )


def sql(name: str, inputs: str, body: str) -> None:
    """Register `body`; it may start with further CTEs followed by `SELECT`."""
    text = duckdb_ctes(*inputs.split()) + body
    if "RECURSIVE_MARK" in text:
        text = text.replace("RECURSIVE_MARK ", "").replace("WITH ", "WITH RECURSIVE ", 1)
    ORACLE[name] = text


def check(name: str, inputs: str, rows: str, summary: str, extra: str = "") -> None:
    ORACLE[name] = (
        duckdb_ctes(*inputs.split())
        + extra
        + f""", rows_ AS ({rows}), summary_ AS ({summary}),
        all_ AS (SELECT instance_guid, object, message, state FROM rows_
                 UNION ALL SELECT instance_guid, NULL, message, 'NA' FROM summary_
                 WHERE instance_guid NOT IN (SELECT instance_guid FROM rows_))
        SELECT instance_guid, '{name}' AS "check", object, message, state, {CODE} AS state_code FROM all_"""
    )
