"""Append-log compaction: which record of a key counts.

A log has no order of its own in Spark, so every function takes ``order``: columns that number the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """The last (or first) record of each key; Spark's top-1 window limit drops others before the shuffle."""
    by = [F.col(c).desc_nulls_last() if last else F.col(c).asc_nulls_first() for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return log.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def last_wins(log: DataFrame, keys: Sequence[str], order: Sequence[str], error: Column | None = None) -> DataFrame:
    """The last record of each key; error records go after the choice, so they hide earlier successes."""
    out = one_per_key(log, keys, order, True)
    return out if error is None else out.where(~F.coalesce(error, F.lit(False)))


def first_wins(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return one_per_key(log, keys, order, False)


def duplicates(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records, distinct keys and records beyond a key's first, in one row."""
    per_key = log.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("records"), F.count("*").alias("keys"), F.sum(F.col("n") - 1).alias("duplicates"))


def any_success(log: DataFrame, keys: Sequence[str], error: Column) -> DataFrame:
    """Keys with a record that is no error, whatever followed."""
    return log.where(~F.coalesce(error, F.lit(False))).select(*keys).distinct()


def latest_success(log: DataFrame, keys: Sequence[str], order: Sequence[str], error: Column) -> DataFrame:
    """Keys whose last record is no error."""
    return last_wins(log, keys, order, error).select(*keys)


def pending(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are not done."""
    return expected.join(done.select(*keys).distinct(), list(keys), "left_anti")


def coverage(log: DataFrame, groups: Sequence[str], config: str, item: str, error: Column, expected: DataFrame, expected_col: str) -> DataFrame:
    """Rows, errors, distinct configs and items for each expected group, and their share of what is expected."""
    seen = log.groupBy(*groups).agg(F.count("*").alias("rows"), F.count_if(error).alias("errors"), F.countDistinct(config).alias("configs"), F.countDistinct(config, item).alias("items"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "errors", "configs", "items")}
    out = expected.join(seen, list(groups), "left").select(*groups, *zero.values(), F.col(expected_col))
    return out.withColumn("ratio", F.round(F.try_divide(F.col("items").cast("double"), F.col(expected_col).cast("double")), 6))
