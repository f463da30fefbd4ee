"""Constraints on tables: each gives a table of violations or counts, or raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A table breaks a constraint."""


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself if its keys are unique."""
    if found := repeated_keys(df, keys).limit(1).collect():
        raise ConstraintError(f"keys {list(keys)} repeat, as in {found[0].asDict()}")
    return df


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table's rows, partitioned by the keys, failing while they are read if a key repeats (nulls are equal).

    Nothing runs before then, and a join on the keys that follows needs no shuffle of its own.
    """
    keys = list(keys)
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns) if c not in keys]
    rows = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    told = F.raise_error(F.concat(F.lit("several rows of "), F.to_json(F.struct(*keys)))).cast("boolean")
    return rows.where(F.when(F.col("_n") > 1, told).otherwise(True)).select(*[c if c in keys else F.col(f"_row.c{k}").alias(c) for k, c in enumerate(df.columns)])


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct keys, and whether they are as many."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    out = per_key.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"))
    return out.withColumn("unique", F.col("rows") == F.col("keys"))


def probability_violations(df: DataFrame, groups: Sequence[str], probs: Column, tolerance: float) -> DataFrame:
    """Per group: rows, and those with an entry that isn't a probability or a sum off 1 by more than the tolerance."""
    p = df.withColumn("_p", probs)
    bad = F.exists("_p", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    off = F.abs(F.aggregate("_p", F.lit(0.0), lambda s, v: s + v) - 1) > tolerance
    return p.groupBy(*groups).agg(F.count("*").alias("rows"), F.count_if(bad).alias("out_of_range"), F.count_if(~bad & off).alias("bad_sum"))


def complete_groups(df: DataFrame, group: Sequence[str], expected: int, failed: Column) -> DataFrame:
    """The groups that have exactly the expected rows and none that failed."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    return sizes.where((F.col("n") == expected) & (F.col("failures") == 0)).select(*group)


def template_faults(templates: DataFrame, kind: str, text: str, expected: dict[str, int], placeholder: dict[str, str]) -> DataFrame:
    """Kinds of templates whose number isn't the expected one, or of which some lack their placeholder."""
    number, wanted = F.lit(None).cast("long"), F.lit(False)
    for k, n in expected.items():
        number = F.when(F.col(kind) == k, F.lit(n).cast("long")).otherwise(number)
    for k, p in placeholder.items():
        wanted = wanted | ((F.col(kind) == k) & ~F.coalesce(F.col(text).contains(p), F.lit(False)))
    found = templates.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(wanted).alias("without_placeholder"))
    kinds = templates.sparkSession.createDataFrame([(k,) for k in expected], f"{kind} string")  # a closed list
    out = F.broadcast(kinds).join(found, kind, "right").unionByName(kinds.join(found, kind, "left_anti").selectExpr(kind, "0L AS n", "0L AS without_placeholder"))
    return out.withColumn("expected", number).where("not (n <=> expected) or without_placeholder > 0")


def against_ledger(found: DataFrame, ledger: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Published values (name, value, tolerance) with those found, and whether they hold; what isn't found doesn't."""
    own = found.select(key, F.col(value).alias("found"))
    held = F.coalesce(F.abs(F.col("found") - F.col(value)) <= F.col("tolerance"), F.lit(False))
    return ledger.join(own, key, "left").withColumn("holds", held)


def unbalanced(df: DataFrame, cell: Sequence[str], expected: int | None = None) -> DataFrame:
    """Cells whose size isn't the expected one (by default the largest cell's)."""
    cells = df.groupBy(*cell).agg(F.count("*").alias("n"))
    if expected is not None:
        return cells.where(F.col("n") != expected)
    most = cells.agg(F.max("n").alias("most"))
    return cells.join(F.broadcast(most)).where("n <> most").drop("most")


def outside_domain(df: DataFrame, column: str, domain: Sequence[str], sample: int = 5) -> DataFrame:
    """Values outside a domain with their number; the first few by value, as a report."""
    return df.where(~F.col(column).isin(*domain) | F.col(column).isNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col(column).asc_nulls_first()).limit(sample)


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False, forbidden: Sequence[str] = ()) -> DataFrame:
    """The table itself if it has the columns (only them, with ``exact``) and none that is forbidden."""
    have = set(df.columns)
    if missing := sorted(set(columns) - have):
        raise ConstraintError(f"missing columns: {missing}")
    if exact and (extra := sorted(have - set(columns))):
        raise ConstraintError(f"unexpected columns: {extra}")
    if bad := sorted(have & set(forbidden)):
        raise ConstraintError(f"forbidden columns: {bad}")
    return df


def pair_completeness(left: DataFrame, right: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """Keys on both sides and on one alone, and pairs whose ``same`` columns differ (nulls are equal)."""
    a = left.select(*keys, *[F.col(c).alias(f"{c}_l") for c in same], F.lit(1).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in same], F.lit(1).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))
    return a.join(b, list(keys), "full").agg(F.count_if(both).alias("pairs"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(both & differ).alias("different"))
