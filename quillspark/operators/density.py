"""Density clusters: the condensed tree of a neighbour graph over a ladder of distances, the stablest clusters of it.

Random projections (``pyspark.ml``) hash the rows; in each table a row meets the next ones in the order of its bucket and
of a second projection, so its candidates are bounded however full a bucket is. The nearest of them make a graph, whose
edges weigh the largest of the distance and both ends' core distances. Its components at each rung of a ladder of
distances (quantiles of the weights) come from the rung below by contracting stars. Components of ``least`` rows or more
are the tree's nodes: a node that is its parent's only one continues the parent's cluster, others begin clusters. A
cluster's stability is the sum of its nodes' sizes by how much inverse distance they span; bottom up, a cluster gives way
to those below it where they are stabler together. All of this is joins and grouped sums; the ladder alone is collected.

A row belongs to the chosen cluster that held it when it began; rows of none are noise, -1. A cluster of all rows is never
chosen. Null ids and vectors are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.sources.scratch import stored

NOISE = -1


def neighbours(df: DataFrame, id_col: str, array: str, k: int, tables: int = 8, window: int = 16, bucket: float = 1.0, seed: int = 42) -> DataFrame:
    """(a, b, d): each row's ``k`` nearest among its candidates, as pairs a < b with their distance."""
    rows = df.select(F.col(id_col).alias("id"), F.transform(array, lambda v: v.cast("double")).alias("x")).where("id is not null and x is not null")
    hashed = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=2 * tables, seed=seed).fit(probe := rows.withColumn("v", array_to_vector("x"))).transform(probe)
    own = hashed.select("id", "x", "h", F.posexplode(F.slice("h", 1, tables)).alias("t", "own"))
    own = own.select("id", "x", "t", vector_to_array("own")[0].alias("bucket"), vector_to_array(F.get("h", F.col("t") + tables))[0].alias("second"))
    near = Window.partitionBy("t", "bucket").orderBy("second", "id").rowsBetween(1, window)
    met = own.withColumn("others", F.collect_list(F.struct("id", "x")).over(near)).select("id", "x", F.explode("others").alias("o"))
    distance = F.sqrt(F.aggregate(F.zip_with("x", F.col("o.x"), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    pairs = met.where("id <> o.id").select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"), distance.alias("d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    pairs = stored(pairs, "density-pairs")
    ends = pairs.select(F.col("a").alias("id"), "a", "b", "d").unionByName(pairs.select(F.col("b").alias("id"), "a", "b", "d"))
    best = ends.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "a", "b"))), 1, k).alias("best"))
    return best.select(F.explode("best").alias("e")).select("e.a", "e.b", "e.d").distinct()


def reachability(pairs: DataFrame, core: int) -> DataFrame:
    """(a, b, w): the largest of the distance and of both ends' distance to their ``core``-th neighbour (the last, if fewer)."""
    ends = pairs.select(F.col("a").alias("id"), "d").unionByName(pairs.select(F.col("b").alias("id"), "d"))
    cores = ends.groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("d")).select("id", F.get("d", F.least(F.size("d"), F.lit(core)) - 1).alias("core"))
    a, b = cores.select(F.col("id").alias("a"), F.col("core").alias("ca")), cores.select(F.col("id").alias("b"), F.col("core").alias("cb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


def merged(pairs: DataFrame) -> DataFrame:
    """(node, root) for all ends of ``pairs`` (a, b): the least node of each component, by alternating stars."""
    def seen(df: DataFrame) -> tuple[DataFrame, tuple]:
        """Stored, and what tells whether it changed."""
        state = Observation()
        return stored(df.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")), "stars"), tuple(state.get.values())

    now, state = seen(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, (now, state) = state, seen(small.unionByName(first.withColumnRenamed("m", "v")).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def ladder(edges: DataFrame, rungs: int) -> list[float]:
    """Rising distances: quantiles of the weights, the largest last."""
    found = edges.agg(F.percentile_approx("w", [(k + 1) / rungs for k in range(rungs)], 100_000)).first()[0] or []
    return sorted({max(float(x), 1e-9) for x in found})


def components(ids: DataFrame, edges: DataFrame, rungs: Sequence[float]) -> DataFrame:
    """(id, level, comp): the component of every row at each rung, named by its least id."""
    labels = ids.select("id", F.col("id").alias("comp"))
    left, out = edges, None
    for level, most in enumerate(rungs):
        told = merged(left.where(F.col("w") <= most).select("a", "b"))
        labels = stored(labels.join(told, labels["comp"] == told["node"], "left").select("id", F.coalesce("root", "comp").alias("comp")), "density-level")
        rest = left.where(F.col("w") > most)
        for end in "ab":
            rest = rest.join(told.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        left = stored(rest.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")), "density-left")
        here = labels.withColumn("level", F.lit(level))
        out = here if out is None else out.unionByName(here)
    return out


def chosen(labels: DataFrame, rungs: Sequence[float], least: int) -> DataFrame:
    """(level, comp, size): where each chosen cluster begins, and its rows there."""
    top = len(rungs) - 1
    sized = stored(labels.groupBy("level", "comp").agg(F.count("*").alias("size")).where(F.col("size") >= least), "density-nodes")
    # A node's parent is what holds its least row one rung up.
    up = labels.select((F.col("level") - 1).alias("level"), F.col("id").alias("comp"), F.col("comp").alias("parent"))
    nodes = sized.join(up, ["level", "comp"], "left")
    only = nodes.groupBy(F.col("level").alias("_level"), F.col("parent").alias("_parent")).agg(F.count("*").alias("siblings"))
    nodes = stored(nodes.join(only, (F.col("level") == F.col("_level")) & F.col("parent").eqNullSafe(F.col("_parent"))).select("level", "comp", "parent", "size", "siblings"), "density-nodes")
    inverse = [1 / r for r in rungs] + [0.0]
    span = F.element_at(F.array(*[F.lit(inverse[k] - inverse[k + 1]) for k in range(top + 1)]), F.col("level") + 1)
    # Top down: the rung and name under which a node's cluster began, and the cluster that it came out of.
    own = F.struct(F.col("level").alias("level"), F.col("comp").alias("comp"))
    above = nodes.where(F.col("level") == top).select("level", "comp", "size", own.alias("cluster"), F.lit(None).cast(f"struct<level:int,comp:{dict(labels.dtypes)['comp']}>").alias("under"))
    parts = [above := stored(above, "density-named")]
    for level in range(top - 1, -1, -1):
        here = nodes.where(F.col("level") == level)
        up = above.select(F.col("comp").alias("parent"), F.col("cluster").alias("_c"), F.col("under").alias("_u"))
        goes_on = F.col("siblings") == 1
        above = stored(here.join(up, "parent").select("level", "comp", "size", F.when(goes_on, F.col("_c")).otherwise(own).alias("cluster"), F.when(goes_on, F.col("_u")).otherwise(F.col("_c")).alias("under")), "density-named")
        parts.append(above)
    named = parts[0]
    for p in parts[1:]:
        named = named.unionByName(p)
    clusters = stored(named.groupBy("cluster", "under").agg(F.sum(F.col("size") * span).alias("own"), F.max("size").alias("size")), "density-clusters")
    rows = labels.where(F.col("level") == top).count()
    # Bottom up, by the rung at which clusters begin: the better of their own stability and of those right below.
    best = clusters.select("cluster", "under", "size", F.lit(None).cast("double").alias("total"), F.lit(False).alias("kept")).limit(0)
    for level in range(top + 1):
        here = clusters.where(F.col("cluster.level") == level)
        below = best.groupBy(F.col("under").alias("cluster")).agg(F.sum("total").alias("below"))
        keep = (F.col("own") >= F.coalesce("below", F.lit(0.0))) & (F.col("under").isNotNull() | (F.col("size") < rows))
        done = here.join(below, "cluster", "left").select("cluster", "under", "size", F.when(keep, F.col("own")).otherwise(F.coalesce("below", F.lit(0.0))).alias("total"), keep.alias("kept"))
        best = stored(best.unionByName(done), "density-best")
    # Top down again: of kept clusters those that no kept one stands above.
    hidden = best.where("under is null").select("cluster", "size", "kept", F.lit(False).alias("hidden"))
    seen = [hidden := stored(hidden, "density-hidden")]
    for level in range(top - 1, -1, -1):
        rest = seen[0]
        for s in seen[1:]:
            rest = rest.unionByName(s)
        up = rest.select(F.col("cluster").alias("under"), (F.col("hidden") | F.col("kept")).alias("hidden"))
        seen.append(stored(best.where(F.col("cluster.level") == level).join(up, "under").select("cluster", "size", "kept", "hidden"), "density-hidden"))
    final = seen[0]
    for s in seen[1:]:
        final = final.unionByName(s)
    return final.where("kept and not hidden").select("cluster.level", "cluster.comp", "size")


def density_clusters(df: DataFrame, id_col: str, array: str, least: int = 15, core: int = 5, k: int = 15, rungs: int = 10, **hashing) -> DataFrame:
    """(id, cluster): a chosen cluster's name is its least id's, noise is -1."""
    ids = df.where(F.col(id_col).isNotNull() & F.col(array).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    if ids.isEmpty():
        return ids.select("id", F.lit(NOISE).cast("long").alias("cluster"))
    edges = stored(reachability(stored(neighbours(df, id_col, array, k, **hashing), "density-near"), core), "density-edges")
    steps = ladder(edges, rungs)
    if not steps:
        return ids.select("id", F.lit(NOISE).cast("long").alias("cluster"))
    labels = components(ids, edges, steps)
    found = chosen(labels, steps, least).select("level", "comp", F.col("comp").alias("cluster"))
    held = labels.join(found, ["level", "comp"]).select("id", "cluster")
    return ids.join(held, "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
