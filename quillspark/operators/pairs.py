"""Matched pairs: one shuffle instead of a self-join, outcomes, contrasts and how they recur."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.labels import direction, recurrence
from quillspark.operators.checks import unique_rows
from quillspark.operators.metrics import ratio


def matched(df: DataFrame, keys: Sequence[str], side: Column, left: str, right: str, values: Sequence[str]) -> DataFrame:
    """Rows of two sides with equal keys, as ``value_left`` and ``value_right``: inner, one to one.

    A grouped pivot: one shuffle of the table, which fails while it runs if a side has a key twice.
    """
    rows = df.select(*keys, side.alias("_side"), *values).where(F.col("_side").isin(left, right))
    sides = ((left, "left"), (right, "right"))
    picked = [F.min(F.when(F.col("_side") == s, F.col(v))).alias(f"{v}_{name}") for v in values for s, name in sides]
    both = rows.groupBy(*keys).agg(*picked, *[F.count_if(F.col("_side") == s).alias(f"_{name}") for s, name in sides])
    twice = (F.col("_left") > 1) | (F.col("_right") > 1)
    told = F.raise_error(F.concat(F.lit("a side has several rows of "), F.to_json(F.struct(*keys)))).cast("boolean")
    return both.where(F.when(twice, told).otherwise((F.col("_left") == 1) & (F.col("_right") == 1))).drop("_left", "_right")


def regimes(df: DataFrame, keys: Sequence[str], side: Column, contrasts: dict[str, tuple[str, str]], values: Sequence[str]) -> DataFrame:
    """The matched pairs of several contrasts (name: left and right side), one under another."""
    out = None
    for name, (left, right) in contrasts.items():
        own = matched(df, keys, side, left, right, values).withColumn("regime", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def agreeing(left: DataFrame, right: DataFrame, keys: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Per pair of a one-to-one join, which of the named columns differ (nulls are equal)."""
    both = one_to_one(left.select(*keys, *facts), right.select(*keys, *facts), keys)
    differs = F.filter(F.array(*[F.when(~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")), F.lit(c)) for c in facts]), lambda c: c.isNotNull())
    return both.select(*keys, differs.alias("differs"))


def positional(rows: DataFrame, source: DataFrame, group: str, position: str, order: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Rows with their item of ``source``, found by its group and place there (from 1, in ``order``), and whether it agrees.

    A row whose place the source doesn't have fails, and so does an item that no row is for.
    """
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    wanted = source.select(group, place.alias(position), *[F.col(c).alias(f"{c}_expected") for c in facts], F.lit(True).alias("_found"))
    met = rows.withColumn("_own", F.lit(True)).join(wanted, [group, position], "full")
    lacks = F.when(F.col("_found").isNull(), "no item at ").when(F.col("_own").isNull(), "no row for the item at ")
    told = F.raise_error(F.concat(lacks, F.to_json(F.struct(group, position)))).cast("boolean")
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_expected"))
    return met.withColumn("aligned", F.when(lacks.isNotNull(), told).otherwise(same)).drop("_found", "_own", *[f"{c}_expected" for c in facts])


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """An inner join that fails while it runs if a key repeats on a side; other columns take the suffixes."""
    keys = list(keys)
    sides = [unique_rows(x, keys).select(*keys, *[F.col(c).alias(c + s) for c in x.columns if c not in keys]) for x, s in zip((left, right), suffixes, strict=True)]
    return sides[0].join(sides[1], keys)


def many_to_one(fact: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that fails while it runs if a key repeats in the dimension."""
    return fact.join(unique_rows(dimension, keys), list(keys), "left")


def event_cells(pairs: DataFrame, groups: Sequence[str], left: Column, right: Column, least_events: int = 30, least_difference: float = 0.05) -> DataFrame:
    """Per group of pairs of 0/1 events: counts, rates, the risk difference right minus left with its 95 % interval, screens."""
    rows = pairs.select(*groups, left.cast("double").alias("_l"), right.cast("double").alias("_r")).withColumn("_d", F.col("_r") - F.col("_l"))
    cells = rows.groupBy(*groups).agg(
        F.count("*").alias("matched_pairs"),
        F.sum("_l").cast("long").alias("left_events"),
        F.sum("_r").cast("long").alias("right_events"),
        F.avg("_d").alias("risk_difference"),
        F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("sd"),
        F.count_if(F.col("_d") != 0).alias("discordant_pairs"),
    )
    n, pooled = F.col("matched_pairs"), F.col("left_events") + F.col("right_events")
    half = F.col("sd") / F.sqrt(n) * 1.96
    cells = cells.withColumns({"left_rate": ratio(F.col("left_events"), n), "right_rate": ratio(F.col("right_events"), n), "pooled_events": pooled, "pooled_rate": ratio(pooled, 2 * n), "ci_low": F.col("risk_difference") - half, "ci_high": F.col("risk_difference") + half})
    informative = F.col("pooled_events") >= least_events
    return cells.withColumns({"ci_excludes_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0), "informative": informative, "substantive": informative & (F.abs("risk_difference") >= least_difference), "direction": direction(F.col("risk_difference"))})


def recurrence_support(cells: DataFrame, keys: Sequence[str], model: str, family: str, parent: str, protocol: str) -> DataFrame:
    """Cells with the support of substantive ones of equal keys and direction, and the class of recurrence."""
    support = cells.where("substantive").groupBy(*keys, "direction").agg(
        F.countDistinct(model).alias("support_models"),
        F.countDistinct(family).alias("support_families"),
        F.countDistinct(parent).alias("support_parent_families"),
        F.countDistinct(F.struct(family, protocol)).alias("support_family_protocols"),
    )
    names = [c for c in support.columns if c.startswith("support_")]
    out = cells.join(support, [*keys, "direction"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return out.withColumn("recurrence", recurrence(F.col("informative"), F.col("substantive"), F.col("support_models"), F.col("support_parent_families")))


def stability(cells: DataFrame, groups: Sequence[str], key: Sequence[str], side: str, left: str, right: str) -> DataFrame:
    """How cells' risk differences agree between two variants: counts of substantive ones, same direction, correlation."""
    wide = matched(cells.withColumn("_s", F.col("substantive").cast("int")), [*groups, *key], F.col(side), left, right, ["risk_difference", "_s"])
    x, y, sx, sy = (F.col(c) for c in ("risk_difference_left", "risk_difference_right", "_s_left", "_s_right"))
    return wide.groupBy(*groups).agg(
        F.count("*").alias("cells"),
        F.count_if((sx == 1) & (sy == 1)).alias("both_substantive"),
        F.count_if((sx == 1) & (sy == 0)).alias("left_only"),
        F.count_if((sx == 0) & (sy == 1)).alias("right_only"),
        F.count_if(x * y > 0).alias("same_direction"),
        F.corr(x, y).alias("correlation"),
    )


def pooled_benchmark(df: DataFrame, keys: Sequence[str], model: Column, one: str, value: str) -> DataFrame:
    """One model's mean against the mean over all other models' means, a row for each key that both have."""
    per_model = df.select(*keys, model.alias("_m"), value).groupBy(*keys, "_m").agg(F.avg(value).alias("v"))
    own = F.col("_m") == one
    out = per_model.groupBy(*keys).agg(F.avg(F.when(own, F.col("v"))).alias("one"), F.avg(F.when(~own, F.col("v"))).alias("others"), F.count_if(~own).alias("n_others"))
    return out.where("one is not null and others is not null").withColumn("difference", F.col("one") - F.col("others"))
