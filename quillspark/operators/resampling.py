"""Resampled means: bootstrap, Bayesian bootstrap and random signs, over any number of rows of a group.

What is drawn is a unit: a row, or a whole cluster. Units of a group with equal values are counted first, then dealt by
the hash of their value (or cluster) into parts of about :data:`PART` distinct ones. A part weighs its units for every
draw from a generator that the group and part seed, and returns a sum for each draw; sums of all parts add up. So a
group spreads over as many tasks as it has parts, none holds it whole, and results hang neither on the number of
partitions nor on which task runs a part.

Draws with replacement are dealt exactly: every part makes the same multinomial split of each draw among all parts, by
their sizes, from the group's own generator, and then splits its share among its own units.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct units of a part, and the most parts of a group (a part's own work grows beyond).
PART, PARTS = 1 << 14, 1 << 10
#: Weights that a part holds at a time.
CELLS = 1 << 20


def _generator(seed: int, key: tuple, part: int | None = None) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode()), *([] if part is None else [1 + part])])


def dirichlet(rng: np.random.Generator, k: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Gamma weights: those of k equal units sum to a gamma variable of shape k."""
    return rng.standard_gamma(k, (len(times), len(k)))


def signs(rng: np.random.Generator, k: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of random signs: of k equal units a binomial number keep theirs."""
    return 2 * rng.binomial(k, 0.5, (len(times), len(k))) - k


def replaced(rng: np.random.Generator, k: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often units are drawn when the part is drawn from as many ``times``."""
    return rng.multinomial(times, k / k.sum())


def units(df: DataFrame, groups: Sequence[str], cluster: Sequence[str], value: Column) -> DataFrame:
    """(groups, part, u, s, n, k): k units of equal sum ``s`` and ``n`` rows each; ``u`` orders a part. Only finite values count."""
    rows = df.select(*groups, *cluster, value.cast("double").alias("s")).where(F.abs("s") < float("inf"))
    if cluster:
        out = rows.groupBy(*groups, *cluster).agg(F.sum("s").alias("s"), F.count("*").alias("n")).select(*groups, F.xxhash64(*cluster).alias("u"), "s", "n", F.lit(1).cast("long").alias("k"))
    else:
        # Both zeros are one value.
        out = rows.groupBy(*groups, (F.col("s") + F.lit(0.0)).alias("s")).agg(F.count("*").alias("k")).select(*groups, F.xxhash64("s").alias("u"), "s", F.lit(1).cast("long").alias("n"), "k")
    sizes = out.groupBy(*[F.col(g).alias(f"_{g}") for g in groups]).agg(F.least(F.lit(PARTS), F.ceil(F.count("*") / PART)).alias("parts"))
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return out.join(sizes, same).select(*groups, F.pmod("u", "parts").cast("int").alias("part"), "u", "s", "n", "k")


def drawn_sums(found: DataFrame, groups: Sequence[str], weigh, draws: int, seed: int) -> DataFrame:
    """(groups, draw, ws, wn): for each draw the weighted sums of values and of rows over a group's units."""
    sizes = found.groupBy(*groups, "part").agg(F.sum("k").alias("k"))
    whole = sizes.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("part", "k"))).alias("sizes"))
    # At most PARTS rows of at most PARTS numbers a group.
    each = whole.select(*[F.col(c).alias(f"_{c}") for c in groups], "sizes", F.explode(F.col("sizes.part")).alias("_part"))
    kinds = found.select(*groups).schema
    g = len(groups)
    split = weigh is replaced

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        named = tuple(x.as_py() for x in key)
        own, part = named[:g], named[g]
        rows = rows.sort_by([("u", "ascending"), ("s", "ascending")])
        s, n, k = rows.column("s").to_numpy(), rows.column("n").to_numpy(), rows.column("k").to_numpy()
        times = np.zeros(draws, np.int64)
        if split:
            all_k = told.column("sizes")[0].as_py()
            share = np.array([x["k"] for x in all_k], float)
            at = [x["part"] for x in all_k].index(part)
            times = _generator(seed, own).multinomial(int(share.sum()), share / share.sum(), draws)[:, at]
        rng, step = _generator(seed, own, part), max(1, CELLS // len(k))
        ws, wn = np.empty(draws), np.empty(draws)
        for lo in range(0, draws, step):
            w = weigh(rng, k, times[lo : lo + step])
            ws[lo : lo + step], wn[lo : lo + step] = w @ s, w @ n
        columns = [pa.array([x] * draws, f) for x, f in zip(own, [x.type for x in key[:g]], strict=True)]
        return pa.table([*columns, np.arange(draws, dtype=np.int32), ws, wn], names=[*groups, "draw", "ws", "wn"])

    schema = T.StructType([*kinds.fields, T.StructField("draw", T.IntegerType()), T.StructField("ws", T.DoubleType()), T.StructField("wn", T.DoubleType())])
    parts = found.groupBy(*groups, "part").cogroup(each.groupBy(*[f"_{c}" for c in groups], "_part")).applyInArrow(run, schema)
    return parts.groupBy(*groups, "draw").agg(F.sum("ws").alias("ws"), F.sum("wn").alias("wn"))


def _resampled(df: DataFrame, groups: Sequence[str], cluster: Sequence[str], value: Column, weigh, draws: int, seed: int, *figures: Column) -> DataFrame:
    """n, with clusters n_clusters, the mean, and ``figures`` of the draws' ``ws`` and ``wn``, a row a group."""
    found = units(df, groups, cluster, value)
    counted = [F.sum(F.col("n") * F.col("k")).alias("n"), *([F.sum("k").alias("n_clusters")] if cluster else []), (F.sum(F.col("s") * F.col("k")) / F.sum(F.col("n") * F.col("k"))).alias("mean_")]
    own = found.groupBy(*[F.col(c).alias(f"_{c}") for c in groups]).agg(*counted)
    same = F.lit(True)
    for c in groups:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    drawn = drawn_sums(found, groups, weigh, draws, seed).join(own, same)
    kept = [F.first(c).alias(c) for c in own.columns if not c.startswith("_")]
    return drawn.groupBy(*groups).agg(*kept, *figures)


def _interval() -> tuple[Column, Column]:
    m = F.col("ws") / F.col("wn")
    return F.percentile(m, 0.025).alias("ci_low"), F.percentile(m, 0.975).alias("ci_high")


def bayes_bootstrap(df: DataFrame, groups: Sequence[str], value: Column, cluster: Sequence[str] = (), draws: int = 4000, rope: float = 0.1, seed: int = 42) -> DataFrame:
    """Posterior of the mean under Dirichlet weights: mean, 95 % interval, shares above 0 and within the region of equivalence."""
    m = F.col("ws") / F.col("wn")
    figures = [F.avg(m).alias("mean"), *_interval(), F.avg((m > 0).cast("double")).alias("p_positive"), F.avg((F.abs(m) <= rope).cast("double")).alias("p_rope")]
    return _resampled(df, groups, cluster, value, dirichlet, draws, seed, *figures).drop("mean_")


def sign_flip(df: DataFrame, groups: Sequence[str], value: Column, cluster: Sequence[str] = (), draws: int = 4000, seed: int = 42) -> DataFrame:
    """The mean and its two-sided p under random signs, with one added to both counts."""
    # Sums that only differ in the order of their terms count as equal.
    reached = F.abs(F.col("ws")) >= F.abs(F.col("mean_")) * F.col("n") * (1 - 1e-12) - 1e-12
    figures = [((1 + F.count(F.when(reached, 1))) / F.lit(draws + 1)).alias("p_value")]
    return _resampled(df, groups, cluster, value, signs, draws, seed, *figures).withColumnRenamed("mean_", "mean")


def bootstrap_mean(df: DataFrame, groups: Sequence[str], value: Column, cluster: Sequence[str] = (), draws: int = 4000, seed: int = 42) -> DataFrame:
    """The mean and its 95 % percentile interval over units drawn with replacement; a drawn cluster brings all its rows."""
    return _resampled(df, groups, cluster, value, replaced, draws, seed, *_interval()).withColumnRenamed("mean_", "mean")
