"""Factorial prompt designs: a scrambled Latin hypercube, factors from its points, crossed blocks, ids and shards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered, numbered_within

#: Points that one task puts together.
TASK_KEYS = 500_000


def latin_hypercube(n: int, d: int, seed: int = 42) -> np.ndarray:
    """n points of the unit cube, one in each of n slices of every dimension; the stream of a legacy ``seed``."""
    g = np.random.default_rng(seed)
    u = g.uniform(size=(n, d))
    slices = np.tile(np.arange(1, n + 1), (d, 1))
    for k in range(d):
        g.shuffle(slices[k])
    return (slices.T - u) / n


def points(spark: SparkSession, n: int, d: int, seed: int = 42) -> DataFrame:
    """The hypercube as (lhs_row, u array<double>)."""
    rows = [(k, [float(v) for v in p]) for k, p in enumerate(latin_hypercube(n, d, seed))]
    return spark.createDataFrame(rows, "lhs_row int, u array<double>")


def row_points(df: DataFrame, key: str, d: int, seed: int = 42) -> DataFrame:
    """A point of the unit cube for each row of a table, as (key, u array<double>): a Latin hypercube over all rows.

    In each dimension a salted hash of the key deals the rows to its slices, one each, and other digits of that hash
    place them inside; all dimensions are numbered by one sort in ranges. A repeated key fails.
    """
    n = df.count()
    digest = F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("dim").cast("string"), F.col(key).cast("string")), 256))
    # Eight bytes deal the ranges; the whole hash is made again behind the shuffle, and not stored.
    rows = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("dim")).withColumn("_begin", F.substring(digest, 1, 8))
    jitter = F.conv(F.substring(F.hex("_h"), 52, 13), 16, 10).cast("double") / float(1 << 52)
    placed = numbered(rows, ["dim", "_h", key], "_place", ["dim", "_begin"], {"_h": digest}, [key, "dim", jitter.alias("_jitter")])
    told = placed.select(key, "dim", ((F.col("_place") - F.col("dim") * n + F.col("_jitter")) / n).alias("u"))
    # A key's rows meet as they are: nothing of them could be summed before.
    met = told.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_KEYS), key)
    points = met.groupBy(key).agg(F.count("*").alias("_n"), F.array(*[F.max(F.when(F.col("dim") == k, F.col("u"))) for k in range(d)]).alias("u"))
    several = F.raise_error(F.concat(F.lit("several rows of "), F.col(key).cast("string"))).cast("array<double>")
    return points.select(key, F.when(F.col("_n") > d, several).otherwise(F.col("u")).alias("u"))


def level(u: Column, k: int, clamp: bool = True) -> Column:
    """Level 0 to k - 1 of a unit value."""
    at = F.floor(u * k).cast("int")
    return F.least(at, F.lit(k - 1)) if clamp else at


def pick(u: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), level(u, len(values)) + 1)


def context(u: Column, none: int | None = None) -> Column:
    """No context below one half, else context 0 to 4."""
    return F.when(u >= 0.5, F.least(F.floor((u - 0.5) * 10), F.lit(4)).cast("int")).otherwise(F.lit(none).cast("int"))


def _half(u: Column, a: str, b: str) -> Column:
    return F.when(u < 0.5, a).otherwise(b)


def choice_factors(u: Column, languages: Sequence[str], key_types: Sequence[str]) -> dict[str, Column]:
    """Factors of a multiple-choice point (8 dimensions)."""
    return {"language": pick(u[0], languages), "context_id": context(u[1]), "instr_type": _half(u[2], "question_first", "options_first"), "instr_idx": level(u[3], 5), "persona_class": _half(u[4], "short", "long"), "persona_idx": level(u[5], 5), "key_type": pick(u[6], key_types), "perm_id": level(u[7], 4)}


def chat_factors(u: Column, language: str, suffixes: int, modes: Sequence[str], instructions: int, key_types: Sequence[str]) -> dict[str, Column]:
    """Factors of a chat point (9 dimensions); the last three have no clamp."""
    return {"language": F.lit(language), "suffix_idx": level(u[0], suffixes), "context_id": context(u[1]), "instr_type": _half(u[2], "question_first", "options_first"), "reasoning_mode": pick(u[3], modes), "instr_idx": level(u[4], instructions), "persona_class": _half(u[5], "short", "long"), "persona_idx": level(u[6], 5, False), "key_type": F.element_at(F.array(*map(F.lit, key_types)), level(u[7], len(key_types), False) + 1), "perm_id": level(u[8], 4, False)}


def stance_factors(u: Column, key_types: Sequence[str]) -> dict[str, Column]:
    """Factors of a stance point (7 dimensions)."""
    return {"context_id": context(u[0]), "instr_type": _half(u[1], "question_first", "options_first"), "instr_idx": level(u[2], 5), "persona_class": _half(u[3], "short", "long"), "persona_idx": level(u[4], 5), "key_type": pick(u[5], key_types), "perm_id": level(u[6], 4)}


def target_factors(u: Column, targets: Sequence[str]) -> dict[str, Column]:
    """Factors of a target-detection point (8 dimensions, of which 2, 6 and 7 are not used)."""
    return {"language": F.lit("english"), "target": pick(u[0], targets), "context_id": context(u[1], -1), "instr_idx": level(u[3], 10), "persona_class": _half(u[4], "short", "long"), "persona_idx": level(u[5], 5)}


def crossed(samples: DataFrame, models: Sequence[str], personas: Sequence[str], base: str = "base") -> DataFrame:
    """Every sample for every model and persona; the base condition has no persona columns' values."""
    spark = samples.sparkSession
    m = spark.createDataFrame(list(enumerate(models)), "model_order int, model string")
    p = spark.createDataFrame(list(enumerate(personas)), "persona_order int, ideology string")
    out = samples.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(p))
    gone = {c: F.when(F.col("ideology") != base, F.col(c)) for c in ("persona_class", "persona_idx") if c in samples.columns}
    return out.withColumns(gone)


def with_config_id(design: DataFrame, offsets: dict[str, int], block: int, order: Sequence[str]) -> DataFrame:
    """``offset[model] * block`` plus the row's place in its model."""
    offset = F.create_map(*[x for m, k in offsets.items() for x in (F.lit(m), F.lit(k))])
    placed = numbered_within(design, ["model"], order, "_at")
    return placed.withColumn("config_id", (F.try_element_at(offset, F.col("model")) * block + F.col("_at")).cast("long")).drop("_at")


def variants(models: DataFrame, modes: Column) -> DataFrame:
    """A row for each mode of a model, ``model_variant`` named by it; a null or empty list keeps the plain model."""
    mode = F.explode_outer(modes).alias("generation_mode")
    return models.select("*", mode).withColumn("model_variant", F.when(F.col("generation_mode").isNull(), F.col("model")).otherwise(F.concat("model", F.lit("_"), "generation_mode")))


def items(design: DataFrame, questions: DataFrame, question_id: str, per_config: int) -> DataFrame:
    """Every item of every config, with its numeric and text ids; questions are a dimension table."""
    uid = F.col("config_id") * per_config + F.col(question_id)
    return design.crossJoin(questions).withColumns({"item_uid": uid.cast("long"), "item_id": F.concat(F.lit("cfg"), F.col("config_id").cast("string"), F.lit("_q"), F.col(question_id).cast("string"))})


def sharded(df: DataFrame, order: Sequence[str], n: int, groups: Sequence[str] = ()) -> DataFrame:
    """Round-robin shards after a sort: row k of the order (in its group) goes to shard k mod n."""
    return numbered_within(df, groups, order, "shard").withColumn("shard", F.pmod("shard", F.lit(n)).cast("int"))
