"""A uniform shuffle into shards of exact sizes by a communication matrix.

How many rows each partition sends to each shard follows the law of a uniform
permutation: a matrix with the partitions' sizes as row sums and the shards'
sizes as column sums, drawn from hypergeometric distributions.  Each partition is
permuted by itself and dealt by its row of the matrix; after the exchange each
shard is permuted again.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut_lineage
from .joins import join_checked

#: Bits of the place within a partition in `monotonically_increasing_id`.
_PLACE = 33
_TWO63 = float(1 << 63)


def hypergeometric(total: Column, marked: Column, drawn: Column, *key: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`; `key` decides the draw.

    The law's weights relative to its mode follow from ratios of neighbours.
    One pass over them keeps a value with the chance of its weight among
    those seen, which draws it by weight.  Values beyond 12 standard deviations (and 40)
    from the mode have less than 2^-53 together, the resolution of a uniform double.
    """
    t, m, d = (c.cast("double") for c in (total, marked, drawn))
    low, high = F.greatest(drawn + marked - total, F.lit(0).cast("long")), F.least(drawn, marked)
    mode = F.greatest(low, F.least(high, F.floor((d + 1) * (m + 1) / (t + 2)).cast("long")))
    p = m / F.greatest(t, F.lit(1.0))
    reach = F.ceil(12 * F.sqrt(d * p * (1 - p) * (t - d) / F.greatest(t - 1, F.lit(1.0)))).cast("long") + 40
    up, down = F.least(high - mode, reach), F.least(mode - low, reach)
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))

    def walk(start: Column, n: Column, side: int) -> Column:
        def step(acc: Column, j: Column) -> Column:
            k = mode + side * j  # the value reached
            x = F.when(F.lit(side > 0), k).otherwise(k + 1).cast("double")  # the larger of the two neighbours
            rise = (m - x + 1) * (d - x + 1) / (x * (t - m - d + x))
            w = acc["w"] * (rise if side > 0 else 1 / rise)
            z = acc["z"] + w
            u = F.shiftrightunsigned(F.xxhash64(*key, k), 11) / F.lit(float(1 << 53))
            return F.struct(w.alias("w"), z.alias("z"), F.when(u * z < w, k).otherwise(acc["pick"]).alias("pick"))

        return F.aggregate(steps(n), start, step)

    first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("z"), mode.alias("pick"))
    return F.aggregate(  # bind the first walk's end once
        F.array(walk(first, up, 1)),
        first,
        lambda _, a: walk(F.struct(F.lit(1.0).alias("w"), a["z"].alias("z"), a["pick"].alias("pick")), down, -1),
    )["pick"]


def split_counts(total: Column, counts: Column, drawn: Column, shards: int, *key: Column) -> Column:
    """Counts per shard of `drawn` rows out of `total`, of which `counts` belong to each shard."""

    def step(acc: Column, s: Column) -> Column:
        mine = F.element_at(counts, (s + 1).cast("int"))
        # the draw is needed three times, so it is bound as a lambda's variable
        bound = F.array(hypergeometric(acc["total"], mine, acc["drawn"], *key, s))
        return F.element_at(
            F.transform(
                bound,
                lambda x: F.struct(
                    (acc["total"] - mine).alias("total"), (acc["drawn"] - x).alias("drawn"),
                    F.concat(acc["out"], F.array(x)).alias("out"),
                ),
            ),
            1,
        )

    start = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), start, step)["out"]


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, counts): rows that each partition sends to each shard.

    `sizes` is (part, n), part from 0 on.  The shards' sizes are at most one apart.  The
    partitions are halved by the bits of their number: a node's counts are
    split between its halves, all nodes of a level at once, so there are as many
    rounds as bits and no row knows more than two nodes.
    """
    total, last = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    each = F.array(*[F.lit(total // shards + (s < total % shards)).cast("long") for s in range(shards)])
    nodes = sizes.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(total).cast("long").alias("n"), each.alias("counts"))
    for bit in reversed(range(int(last).bit_length())):
        upper = sizes.select(F.shiftright("part", bit).alias("half"), "n")
        left = upper.filter(F.col("half") % 2 == 0).groupBy(F.shiftright("half", 1).alias("node")).agg(F.sum("n").alias("n_left"))
        met = nodes.join(left, "node", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0).cast("long")))
        drawn = split_counts(F.col("n"), F.col("counts"), F.col("n_left"), shards, F.lit(seed), F.lit(bit), F.col("node"))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("n_left").alias("n"), F.col("left").alias("counts")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("n_left")).alias("n"),
                F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"),
            ),
        )
        nodes = cut_lineage(met.withColumn("left", drawn).select(F.explode(halves).alias("h")).select("h.*").filter("n > 0"))
    return nodes.select(F.col("node").alias("part"), "counts")


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 12, block_rows: int = 1 << 16) -> DataFrame:
    """`df` with shard (0 to shards - 1) and slot (0, 1, ... in each shard), a uniform permutation of its rows.

    Shard sizes are at most one apart, whatever the data: rows count, not their
    contents, so copies, hot keys and repeated rows spread like others, and nulls and
    empty texts are rows like any.  An empty table gives none; fewer rows than shards leave
    shards empty.  Columns named shard or slot are replaced.

    The permutation of a partition is fixed when it is written (cut), and with it the
    result: a task that runs again reads what was written.  A rerun over the same
    files and partitions gives the same.  A shard is permuted in blocks of about
    `block_rows` rows, cut by the number the rows are ordered by, so that no
    task holds a shard.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")])
    # permute locally: a row's id is its partition and its place after a local sort by random numbers
    local = rows.withColumn("__u", F.rand(seed)).sortWithinPartitions("__u").withColumn("__row", F.monotonically_increasing_id())
    placed = cut_lineage(local.drop("__u")).withColumn("__part", F.shiftright("__row", _PLACE))
    sizes = cut_lineage(placed.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")))
    matrix = communication_matrix(sizes, shards, seed).select(F.col("part").alias("__part"), "counts")
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = cut_lineage(matrix.select("__part", upto.alias("__upto")))
    place = F.col("__row").bitwiseAND(F.lit((1 << _PLACE) - 1))
    dealt = join_checked(placed, matrix, ["__part"]).withColumn("shard", F.size(F.filter("__upto", lambda e: e <= place)))
    # exchange, and permute again
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // (shards * block_rows)) or 1
    number = F.shiftrightunsigned(F.xxhash64("__row", F.lit(seed)), 1)
    dealt = dealt.withColumn("__number", number).withColumn("__block", F.floor(F.col("__number") / F.lit(_TWO63) * blocks)).drop("__upto", "__part")
    filled = dealt.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(filled.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    inside = F.row_number().over(Window.partitionBy("shard", "__block").orderBy("__number", "__row"))
    found = join_checked(dealt.withColumn("__inside", inside), offsets, ["shard", "__block"])
    return found.withColumn("slot", F.col("__before") + F.col("__inside") - 1).select(*rows.columns, "shard", "slot")


def write_shards(sharded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per shard, its rows in the order of their slots; a large shard is several files."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode(mode).partitionBy("shard").parquet(path)
