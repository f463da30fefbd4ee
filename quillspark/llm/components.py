"""Connected components by alternating stars, on tables: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; a component's name is its smallest node.

    Large-star links each node's larger neighbours to its smallest, small-star its smaller ones; both keep
    components, and when nothing changes every node hangs on its component's smallest. A star of any size
    settles in one round. Null ends, loops and repeated edges are ignored.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(first.withColumnRenamed("m", "v")).distinct(), "edges")
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
