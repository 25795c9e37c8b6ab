"""Alert states and the result shape every check shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut_lineage
from .semantics import KEY

STATES = ("NA", "OK", "WARNING", "CRITICAL")
RESULT = [KEY, "check", "object", "message", "state", "state_code"]


def state_code(state: Column) -> Column:
    """NA and OK are 0, WARNING 1, CRITICAL 2, anything else 3."""
    s = F.upper(state)
    return (
        F.when(s.isin("NA", "OK"), 0).when(s == "WARNING", 1).when(s == "CRITICAL", 2).otherwise(3)
    )


def shaped(check: str, rows: DataFrame) -> DataFrame:
    return rows.select(
        KEY,
        F.lit(check).alias("check"),
        "object",
        "message",
        "state",
        state_code(F.col("state")).alias("state_code"),
    )


def with_summary(check: str, rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows of a check; instances without any get their summary line as `NA`.

    `summary` has one (instance, message) row per instance.  The rows found are
    written once and read twice, so the history behind them is scanned once.
    The instances that do have rows are reduced to a key set before the anti join, so a hot
    instance costs one partial aggregate, not a shuffle of its rows.
    """
    rows = cut_lineage(rows.select(KEY, "object", "message", "state"))
    reported = rows.select(KEY).distinct()
    quiet = summary.join(reported, KEY, "left_anti").select(
        KEY, F.lit(None).cast("string").alias("object"), "message", F.lit("NA").alias("state")
    )
    columns = [KEY, "object", "message", "state"]
    return shaped(check, rows.select(*columns).unionByName(quiet))
