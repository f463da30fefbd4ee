"""Samples and shards that a hash decides, so that every run and every engine draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import hash_shard, salted_hash


def stratified(df: DataFrame, cell: Sequence[str], key: Column, salt: str, k: int) -> DataFrame:
    """The k rows of each cell whose salted hash is smallest."""
    w = Window.partitionBy(*cell).orderBy("sample_key")
    rows = df.withColumn("sample_key", salted_hash(F.lit(salt), key, digits=64))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def representations(df: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """A row for each non-empty text column: (keys, representation, text)."""
    rows = F.array(*[F.struct(F.lit(t).alias("representation"), F.col(t).alias("text")) for t in texts])
    return df.select(*keys, F.inline(rows)).where(F.length(F.trim("text")) > 0)


def embedding_queue(df: DataFrame, cell: Sequence[str], key: str, salt: str, k: int, always: DataFrame, texts: Sequence[str], shards: int) -> DataFrame:
    """A balanced sample and the rows of ``always`` (by key), each once, a row for each representation, with a shard."""
    sample = stratified(df, cell, F.col(key).cast("string"), salt, k).drop("sample_key")
    extra = df.join(always.select(key).distinct(), key, "left_semi")
    rows = sample.unionByName(extra).dropDuplicates([key])
    out = representations(rows, [key], texts)
    out = out.withColumn("queue_id", salted_hash(F.col(key).cast("string"), F.col("representation")))
    return out.withColumn("shard", hash_shard(F.col("queue_id"), shards))
