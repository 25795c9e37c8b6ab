"""Documents of a parent and its children in long form, one shape at every size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(parent: DataFrame, keys: Sequence[str], children: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Parent rows, `kind` and `item` NULL, and a row per child: keys, kind, and its fields as a JSON `item`.

    `children` maps the kind to (child rows, fields).  Children without a parent
    are left out, repeated ones stay.  Nothing is gathered, so a parent of any
    number of children is spread over as many tasks as its rows are.
    """
    keys = list(keys)
    own = parent.select(*keys).distinct()
    out = parent.withColumn("kind", F.lit(None).cast("string")).withColumn("item", F.lit(None).cast("string"))
    for kind, (rows, fields) in children.items():
        item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        mine = rows.select(*keys, F.lit(kind).alias("kind"), item.alias("item")).join(own, keys, "left_semi")
        out = out.unionByName(mine, allowMissingColumns=True)
    return out
