"""Scores from answer probabilities: coordinates, alignment with a target, quadrants and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import centred, dot, first_argmax, weight_variance


def long_items(df: DataFrame, keys: Sequence[str], probs: str, answers: str = "p", item: str = "item") -> DataFrame:
    """Wide to long: a row for each item of an array of answer distributions."""
    return df.select(*keys, F.posexplode(probs).alias(item, answers))


def wide_items(df: DataFrame, keys: Sequence[str], item: str, answers: str) -> DataFrame:
    """Long to wide: the distributions as one array in item order."""
    pairs = F.sort_array(F.collect_list(F.struct(item, answers)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x[answers]).alias("probs"))


def unstacked(df: DataFrame, keys: Sequence[str], prefix: str, suffixes: Sequence[str], items: int) -> DataFrame:
    """Columns ``<prefix><item>_<suffix>`` to rows (item, suffix...): a header that is a two-dimensional array."""
    rows = F.array(*[F.struct(F.lit(k).alias("item"), *[F.col(f"{prefix}{k}_{s}").alias(s) for s in suffixes]) for k in range(items)])
    return df.select(*keys, F.inline(rows))


def coordinates(df: DataFrame, keys: Sequence[str], item: str, answers: Column, scorer: DataFrame, axes: Sequence[str], biases: dict[str, float]) -> DataFrame:
    """Per key: for each axis the bias plus the sum over items of expected weights, and the sum of their variances.

    ``scorer`` has a row for each item and an array of weights for each axis; it is a dimension table.
    """
    rows = df.withColumn("_p", answers).join(scorer, item)
    score = [(F.sum(F.coalesce(F.nanvl(dot(F.col("_p"), F.col(a)), F.lit(0.0)), F.lit(0.0))) + biases.get(a, 0.0)).alias(f"score_{a}") for a in axes]
    spread = [F.sum(weight_variance(F.col("_p"), F.col(a))).alias(f"variance_{a}") for a in axes]
    return rows.groupBy(*keys).agg(*score, *spread, F.count("*").alias("items"))


def question_axes(scorer: DataFrame, axes: Sequence[str], least: float = 1e-9) -> DataFrame:
    """The axis whose weights of an item vary (the first such), their range, and the direction of the last answer."""
    ranges = {a: F.array_max(a) - F.array_min(a) for a in axes}
    axis, spread, way = None, None, None
    for a in axes:
        hit = ranges[a] > least
        slope = F.sign(F.element_at(F.col(a), -1) - F.element_at(F.col(a), 1)).cast("int")
        axis = F.when(hit, a) if axis is None else axis.when(hit, a)
        spread = F.when(hit, ranges[a]) if spread is None else spread.when(hit, ranges[a])
        way = F.when(hit, slope) if way is None else way.when(hit, slope)
    return scorer.withColumns({"axis": axis.otherwise("unweighted"), "weight_range": spread.otherwise(0.0), "direction": way.otherwise(0)})


def aligned(p: Column, weights: Column, sign: Column) -> dict[str, Column]:
    """Whether the predicted answer's centred weight has the target's sign, and the expected centred weight along it."""
    c = centred(weights)
    chosen = F.get(c, first_argmax(p))
    return {"target_aligned": F.coalesce(sign * chosen > 0, F.lit(False)), "target_projection": sign * dot(p, c)}


def in_quadrant(x: Column, y: Column, sign_x: Column, sign_y: Column) -> Column:
    return (x * sign_x > 0) & (y * sign_y > 0)


def distance(x: Column, y: Column, x0: Column | float = 0.0, y0: Column | float = 0.0) -> Column:
    return F.hypot(x - x0, y - y0)


def centroid_shifts(df: DataFrame, groups: Sequence[str], level: str, base: str, x: str, y: str) -> DataFrame:
    """Distance of each level's centroid from the base level's in the same group: one aggregate and a window, no self-join."""
    from pyspark.sql.window import Window

    centroids = df.groupBy(*groups, level).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count("*").alias("n"))
    w = Window.partitionBy(*groups)
    own = F.col(level) == base
    bases = {f"b{c}": F.max(F.when(own, F.col(c))).over(w) for c in ("cx", "cy")}
    return centroids.withColumns(bases).where(~own & F.col("bcx").isNotNull()).withColumn("shift", distance(F.col("cx"), F.col("cy"), F.col("bcx"), F.col("bcy")))
