"""Row numbers in a global order, and groups dealt into folds of like size, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.scratch import stored

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[Column | str], out: str, by: Sequence[Column | str] = (), made: dict[str, Column] | None = None, kept: Sequence[Column | str] = ("*",)) -> DataFrame:
    """``df`` with its rows' places from 0 in ``order``: ranges sorted apart, each after all rows of those before it.

    ``by`` deals the ranges, where something that begins the order is enough for that; columns ``made`` from the rows
    then take part in the sort without being shuffled. Only ``kept`` is stored.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(parts, *(by or order)).withColumns(made or {})
    placed = stored(ranges.sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias(out)), "numbered")
    part = F.shiftright(out, 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)])
    # A row a partition.
    offsets = df.sparkSession.createDataFrame([(int(p), int(n)) for (p, _), n in zip(sizes, before, strict=False)], "_part long, _before long")
    place = F.col("_before") + F.col(out).bitwiseAND(F.lit(_ROW))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, place).drop("_part", "_before")


def with_group(df: DataFrame, keys: Sequence[str], facts: DataFrame) -> DataFrame:
    """``df`` with what ``facts`` (a row a group) holds of each row's group; null keys are equal.

    A join, not a window: where facts turn out small they are told to all tasks, else hot keys are split as it runs.
    """
    told = facts.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(told, same).drop(*[f"_key{i}" for i in range(len(keys))])


def numbered_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with its rows' places from 0 in their group: all rows numbered by ranges, less the group's first place."""
    placed = numbered(df, [*groups, *order], out)
    if not groups:
        return placed
    first = placed.groupBy(*groups).agg(F.min(out).alias("_first"))
    return with_group(placed, groups, first).withColumn(out, F.col(out) - F.col("_first")).drop("_first")


def dealt(sizes: Sequence[tuple[int, int]], folds: int) -> list[list[int]]:
    """How many groups of each (size, groups), largest first, go to each fold if each goes to the fold with the fewest rows."""
    rows, out = [0] * folds, []
    for size, groups in sizes:
        now = [0] * folds
        while groups:
            # Up to the next fuller fold at once; folds that are level take turns.
            low = min(range(folds), key=lambda f: (rows[f], f))
            others = [r for r in rows if r > rows[low]]
            level = [f for f in range(folds) if rows[f] == rows[low]]
            each = max(1, (min(others) - rows[low]) // size) if others and len(level) == 1 else max(1, groups // folds) if len(level) == folds else 1
            for f in level if len(level) == folds else [low]:
                take = min(each, groups)
                now[f] += take
                rows[f] += take * size
                groups -= take
        out.append(now)
    return out


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): no group is split; groups go, largest first, to the fold with the fewest rows so far. Null is a group.

    Groups of one size are alike, so how many of them each fold takes follows from the sizes' own counts (at most
    the square root of twice the rows), and which ones from their place by name.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    placed = numbered(sizes, [F.desc("_n"), F.col(group)], "_place")
    counts = sorted(((int(n), int(c)) for n, c in placed.groupBy("_n").count().collect()), reverse=True)
    bounds, at = [], 0
    for (_, _), shares in zip(counts, dealt(counts, folds), strict=True):
        for f, share in enumerate(shares):
            if share:
                bounds.append((at, at + share, f))
                at += share
    told = df.sparkSession.createDataFrame(bounds, "_from long, _to long, fold int")
    return placed.join(F.broadcast(told), (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))).select(group, "fold")
