"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node with an edge; the label is the component's smallest node.

    Contraction: each round maps a node to the one of it and its neighbours that
    comes first in a random order, new in every round, and joins the edges
    between what is left.  That takes a constant share of the nodes away each
    time, whatever the shape, so rounds grow with the logarithm of a
    component's size.  Hubs meet their minimum in a pre-aggregated group-by.
    """
    rest = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct())
    at = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().withColumn("at", F.col("node"))
    round_ = 0
    while not rest.isEmpty():
        round_ += 1
        both = rest.union(rest.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(round_)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.least(F.min(order("b")), order("a")).getField("to").alias("to"))
        first = cut_lineage(first.select(F.col("a").alias("at"), "to"))
        at = at.join(first, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        at = cut_lineage(at)
        rest = (
            rest.join(first.select(F.col("at").alias("a"), F.col("to").alias("x")), "a")
            .join(first.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
            .filter("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        rest = cut_lineage(rest)
    smallest = at.groupBy("at").agg(F.min("node").alias("label"))
    return at.join(smallest, "at").select("node", "label")
