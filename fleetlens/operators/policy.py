"""Policy tables as data: defaults, merges, pruning, parameters, retention.

Every function returns the new state of a table; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import KEY, instant, like_text, name_key
from ..functions.states import STATES
from ..plans.segments import row_before

# fixed values: parameter names and the types they are read as
PARAMETER_TYPES = {
    "DEFAULT_CAP_WARN_PERCENT": "int",
    "DEFAULT_CAP_CRIT_PERCENT": "int",
    "DEFAULT_BACKUP_FREQ": "int",
    "DEFAULT_BACKUP_STATE": "string",
    "DEFAULT_CHECKDB_FREQ": "int",
    "DEFAULT_CHECKDB_STATE": "string",
    "DEFAULT_DB_STATE": "string",
    "DEFAULT_JOB_MAX_MIN": "int",
    "DEFAULT_JOB_STATE": "string",
    "DEFAULT_JOB_ENABLED": "boolean",
    "DEFAULT_ALWAYSON_STATE": "string",
    "DEFAULT_ALWAYSON_ROLE": "string",
    "SANITIZE_DATASET": "boolean",
    "TENANT_NAME": "string",
}

# fixed values: hierarchy of the volatile subtree of the inventory
VOLATILE_SUBTREE = "%Win32[_]GroupUser/Local[_]Admins%"


def param_resolve(parameters: DataFrame, types: Mapping[str, str] = PARAMETER_TYPES) -> DataFrame:
    """One typed row per instance; a parameter that is not set is NULL."""
    return parameters.groupBy(KEY).agg(
        *[
            F.max(F.when(F.col("name") == name, F.col("value"))).cast(kind).alias(name.lower())
            for name, kind in types.items()
        ]
    )


def policy_add_missing(
    objects: DataFrame, policy: DataFrame, params: DataFrame, kind: str = "database",
    roles: DataFrame | None = None,
) -> DataFrame:
    """Policy plus a default row for every object it does not know.

    `kind` is database, job or group.  `params` is the result of
    `param_resolve`.  `roles` gives mirroring roles of databases.
    """
    p = {name: F.col(f"__p.{name}") for name in params.columns}
    if kind == "database":
        known, key = objects.filter(F.col("source_database_id").isNull()), "database_id"
        if roles is not None:
            known = known.join(
                roles.select(KEY, key, F.col("mirroring_role_desc").alias("mirroring_role")),
                [KEY, key], "left",
            )
        else:
            known = known.withColumn("mirroring_role", F.lit(None).cast("string"))
        frequent = F.when(name_key(F.col("name")) == "tempdb", F.lit(0))
        values: dict[str, Column] = {
            "db_name": F.col("name"),
            "capacity_warning_percent_free": p["default_cap_warn_percent"],
            "capacity_critical_percent_free": p["default_cap_crit_percent"],
            "mirroring_role": F.col("mirroring_role"),
            "backup_frequency_hours": frequent.otherwise(p["default_backup_freq"]),
            "backup_state_alert": p["default_backup_state"],
            "checkdb_frequency_hours": frequent.otherwise(p["default_checkdb_freq"]),
            "checkdb_state_alert": p["default_checkdb_state"],
            "change_state_alert": p["default_db_state"],
            "is_enabled": F.lit(True),
        }
    elif kind == "job":
        known, key = objects, "job_id"
        values = {
            "job_name": F.col("job_name"),
            "max_exec_time_min": p["default_job_max_min"],
            "change_state_alert": p["default_job_state"],
            "is_enabled": p["default_job_enabled"],
        }
    elif kind == "group":
        known, key = objects, "ag_id"
        values = {
            "ag_name": F.col("ag_name"),
            "ag_state_alert": p["default_alwayson_state"],
            "ag_state_is_enabled": F.lit(True),
            "ag_role": F.col("role_desc"),
            "ag_role_alert": p["default_alwayson_role"],
            "ag_role_is_enabled": F.lit(True),
            "ag_role_change_datetime": F.lit(None).cast("timestamp"),
        }
    else:
        raise ValueError(f"unknown kind of object: {kind}")
    fresh = (
        known.join(policy.select(KEY, key), [KEY, key], "left_anti")
        .join(params.withColumn("__p", F.struct(*params.columns)).select(KEY, "__p"), KEY, "left")
        .select(KEY, key, *[v.alias(n) for n, v in values.items()])
    )
    return policy.select(KEY, key, *values).unionByName(fresh)


def policy_refresh_names(
    objects: DataFrame, policy: DataFrame, key: str = "database_id",
    name: str = "name", stored: str = "db_name",
) -> DataFrame:
    """Stored names replaced by the current ones where the object still exists."""
    current = objects.select(KEY, key, F.col(name).alias("__current"))
    return policy.join(current, [KEY, key], "left").select(
        *[F.coalesce("__current", stored).alias(stored) if c == stored else c for c in policy.columns]
    )


def policy_backfill_role(mirror_state: DataFrame, policy: DataFrame) -> DataFrame:
    """Expected mirroring role filled in only where the policy has none."""
    current = mirror_state.select(KEY, "database_id", F.col("mirroring_role_desc").alias("__role"))
    return policy.join(current, [KEY, "database_id"], "left").select(
        *[
            F.coalesce("mirroring_role", "__role").alias(c) if c == "mirroring_role" else c
            for c in policy.columns
        ]
    )


def policy_prune(objects: DataFrame, policy: DataFrame, key: str = "database_id") -> DataFrame:
    """Policies whose object still exists."""
    return policy.join(objects.select(KEY, key), [KEY, key], "left_semi")


def policy_merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Upsert: source values win, target-only rows stay, source-only rows come in.

    Keys compare null-safely, so a default instance (NULL name) matches itself.
    """
    t = target.select(*[F.col(k).alias(f"t_{k}") for k in keys],
                      *[F.col(c).alias(f"t_{c}") for c in cols], F.lit(True).alias("t__in"))
    s = source.select(*[F.col(k).alias(f"s_{k}") for k in keys],
                      *[F.col(c).alias(f"s_{c}") for c in cols], F.lit(True).alias("s__in"))
    same = None
    for k in keys:
        one = F.col(f"t_{k}").eqNullSafe(F.col(f"s_{k}"))
        same = one if same is None else same & one
    from_source = F.col("s__in").isNotNull()
    return t.join(s, same, "full_outer").select(
        *[
            F.when(from_source, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c)
            for c in [*keys, *cols]
        ]
    )


def role_change_stamp(replica_snapshots: DataFrame) -> DataFrame:
    """Current role per group and the last time it changed (NULL if it never did)."""
    stepped = row_before(replica_snapshots, [KEY, "ag_id"], ["snapshot_ts", "seq"], ["role"])
    changed = F.when(F.col("previous.role") != F.col("role"), F.col("snapshot_ts"))
    return stepped.groupBy(KEY, "ag_id").agg(
        F.max(F.struct("snapshot_ts", "seq", "role")).getField("role").alias("ag_role"),
        F.max(changed).alias("ag_role_change_datetime"),
    )


def eav_upsert(
    service_eav: DataFrame, incoming: DataFrame, *, as_of: datetime | str,
    keep_months: int = 1, volatile_minutes: int = 1,
) -> DataFrame:
    """Latest value per (hierarchy, property) after a batch of upserts.

    Rows not seen for a month expire; the volatile subtree after a minute.
    Ties on `lastseen` go to the higher `seq`, then to the higher value.
    """
    now = instant(as_of)
    merged = (
        service_eav.unionByName(incoming)
        .groupBy(KEY, "hierarchy", "property")
        .agg(F.max(F.struct("lastseen", "seq", "value")).alias("r"))
        .select(KEY, "hierarchy", "property", "r.value", "r.lastseen", "r.seq")
    )
    volatile = F.col("hierarchy").ilike(like_text(VOLATILE_SUBTREE))
    return merged.filter(
        (F.col("lastseen") >= now - F.expr(f"INTERVAL {int(keep_months)} MONTH"))
        & (~volatile | (F.col("lastseen") >= now - F.expr(f"INTERVAL {int(volatile_minutes)} MINUTE")))
    )


def retention_purge(
    df: DataFrame, ts_col: str, *, as_of: datetime | str, keep_days: int | None = None,
    keep_months: int | None = None,
) -> DataFrame:
    """Rows not older than the retention; the sign of the number does not matter.

    Zero months purges everything before `as_of`.  The filter is on the raw
    column, so it reaches the scan and prunes partitions.
    """
    if (keep_days is None) == (keep_months is None):
        raise ValueError("give keep_days or keep_months")
    now = instant(as_of)
    if keep_days is not None:
        cutoff = now - F.expr(f"INTERVAL {abs(keep_days)} DAY")
    else:
        cutoff = now - F.expr(f"INTERVAL {abs(keep_months)} MONTH")
    return df.filter(F.col(ts_col) >= cutoff)


def policy_validate(
    policy: DataFrame, keys: Sequence[str], alerts: Sequence[str],
    pairs: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Violations: alert outside its domain, one threshold of a pair, repeated key.

    Returns (keys as `object`, rule, detail).
    """
    label = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("%")) for k in keys])
    found = []
    for column in alerts:
        found.append(
            F.when(
                F.col(column).isNull() | ~F.upper(column).isin(*STATES[1:]),
                F.struct(F.lit(f"alert:{column}").alias("rule"), F.col(column).alias("detail")),
            )
        )
    for low, high in pairs:
        found.append(
            F.when(
                F.col(low).isNull() != F.col(high).isNull(),
                F.struct(
                    F.lit(f"pair:{low}").alias("rule"),
                    F.coalesce(low, high).cast("string").alias("detail"),
                ),
            )
        )
    broken = policy.select(
        KEY, label.alias("object"), F.explode(F.array_compact(F.array(*found))).alias("v")
    ).select(KEY, "object", "v.rule", "v.detail")
    repeated = (
        policy.groupBy(KEY, label.alias("object"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(KEY, "object", F.lit("key").alias("rule"), F.col("n").cast("string").alias("detail"))
    )
    return broken.unionByName(repeated)
