"""Iterative joins whose state is cut by tables written to the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only where that is unset, on a local master as in tests, a folder in the
    session's warehouse is taken; a cluster has to name a folder all its
    machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder the cluster shares")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/fleetlens-scratch"


def run_folder(spark: SparkSession) -> str:
    """This session's own folder in the shared one; it is removed when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = f"{shared_folder(spark)}/fleetlens-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _written[app])
    return _written[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Through Hadoop's file system, as the folder may be in any store; nothing waits for it."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended already
        return


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it from there.

    Unlike a checkpoint, the table has its true size: the estimates of a chain of
    checkpointed joins multiply, which in a loop costs the planner more than the
    joins, and hides from it what is small enough to broadcast.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(start: DataFrame, step: DataFrame, key: str) -> DataFrame:
    """(key, source, target, depth): every target reachable from a source.

    `start` and `step` have (key, source, target); paths begin with a row of
    `start` and go on through rows of `step`.  Semi-naive: each round extends
    only the pairs found in the round before, and pairs already known are
    removed, so cycles end by themselves.  The depth is the shortest one.
    """
    columns = [key, "source", "target"]
    step = cut_lineage(
        step.select(key, F.col("source").alias("target"), F.col("target").alias("reached")).distinct()
    )
    frontier = cut_lineage(start.select(*columns).distinct().withColumn("depth", F.lit(1)))
    known = frontier
    depth = 1
    while True:
        depth += 1
        grown = (
            frontier.join(step, [key, "target"])
            .select(key, "source", F.col("reached").alias("target"))
            .distinct()
            .join(known.select(*columns), columns, "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(grown)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def reachable(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, target): all that can be reached within the group of `keys`, by path doubling.

    `edges` has the keys, source and target.  Each round joins the pairs known with
    themselves, so paths of twice the length are covered: rounds grow with the
    logarithm of the longest path, and each reads the last table alone.  Cycles
    add nothing after a while; then the table stops growing.
    """
    columns = [*keys, "source", "target"]
    known = cut_lineage(edges.select(*columns).distinct())
    size = known.count()
    while True:
        ahead = known.select(*keys, F.col("source").alias("target"), F.col("target").alias("reached"))
        longer = known.join(ahead, [*keys, "target"]).select(*keys, "source", F.col("reached").alias("target"))
        known = cut_lineage(known.unionByName(longer).distinct())
        grown = known.count()
        if grown == size:
            return known
        size = grown


def _gather(links: DataFrame, key: str, rounds: int) -> DataFrame:
    """Pointer doubling; rows whose `up` is still set afterwards lead to a ring."""
    state = links.select(key, "node", "up", F.lit(1).cast("long").alias("size"))
    for _ in range(rounds):
        gained = (
            state.filter(F.col("up").isNotNull())
            .groupBy(key, F.col("up").alias("node"))
            .agg(F.sum("size").alias("gain"))
        )
        jump = state.select(key, F.col("node").alias("up"), F.col("up").alias("further"))
        state = cut_lineage(
            state.join(gained, [key, "node"], "left")
            .join(jump, [key, "up"], "left")
            .select(
                key, "node", F.col("further").alias("up"),
                (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"),
            )
        )
        if state.filter(F.col("up").isNotNull()).isEmpty():
            break
    return state


def _ring_labels(ring_links: DataFrame, key: str, rounds: int) -> DataFrame:
    """(key, node, ring): the smallest node of the ring each node lies on."""
    state = ring_links.select(key, "node", "up", F.col("node").alias("ring"))
    for _ in range(rounds):
        ahead = state.select(
            key, F.col("node").alias("up"), F.col("up").alias("further"),
            F.col("ring").alias("ahead"),
        )
        state = cut_lineage(
            state.join(ahead, [key, "up"]).select(
                key, "node", F.col("further").alias("up"), F.least("ring", "ahead").alias("ring")
            )
        )
    return state.select(key, "node", "ring")


def subtree_sizes(links: DataFrame, key: str, node: str, parent: str) -> DataFrame:
    """(key, node, size): nodes reachable below each node, itself included.

    Each node has at most one parent.  Pointer doubling: round k adds to the
    2^k-th ancestor what a node has gathered so far, then squares the pointer.
    That is O(log depth) rounds over one row per node, where listing all pairs
    would grow with the depth.  Nodes on a ring reach the same nodes, so a ring
    is folded into its smallest node and unfolded at the end.
    """
    links = cut_lineage(links.select(key, F.col(node).alias("node"), F.col(parent).alias("up")))
    rounds = max(links.count(), 1).bit_length() + 1
    state = _gather(links, key, rounds)
    on_ring = state.filter(F.col("up").isNotNull()).select(key, F.col("up").alias("node")).distinct()
    if on_ring.isEmpty():
        return state.select(key, "node", "size")

    rings = _ring_labels(links.join(on_ring, [key, "node"], "left_semi"), key, rounds)
    folded = links.join(rings, [key, "node"], "left").select(
        key,
        "node",
        F.when(F.col("ring").isNull(), F.col("up"))
        .when(F.col("ring") != F.col("node"), F.col("ring"))
        .alias("up"),
    )
    state = _gather(cut_lineage(folded), key, rounds).join(rings, [key, "node"], "left")
    totals = state.filter(F.col("ring") == F.col("node")).select(
        key, "ring", F.col("size").alias("total")
    )
    return state.join(totals, [key, "ring"], "left").select(
        key, "node", F.coalesce("total", "size").alias("size")
    )
