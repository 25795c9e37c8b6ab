"""One pass over all checks of an estate."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame

from ..operators import checks


def run_checks(inputs: Callable[[str], DataFrame], *, as_of: datetime | str) -> DataFrame:
    """Result rows of every state check; `inputs` delivers a table by name."""
    i = inputs
    results = [
        checks.check_backup(
            i("databases"), i("backup_history"), i("policy_database"), i("instances"), as_of=as_of
        ),
        checks.check_integrity(i("db_info"), i("databases"), i("policy_database"), as_of=as_of),
        checks.check_database_state(i("databases"), i("policy_database")),
        checks.check_inventory(i("databases"), i("policy_database"), i("instances")),
        checks.check_job(i("job_history"), i("policy_job")),
        checks.check_job_long_running(i("job_activity"), i("policy_job"), i("instances"), as_of=as_of),
        checks.check_logshipping(
            i("logship_primary"), i("logship_secondary"), i("policy_database"), i("instances"), as_of=as_of
        ),
        checks.check_mirroring(
            i("databases"), i("mirror_state"), i("policy_database"), i("instances")
        ),
        checks.check_replica_group(i("replica_state"), i("policy_replica_group"), i("instances")),
    ]
    return reduce(DataFrame.unionByName, results)
