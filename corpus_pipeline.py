"""A corpus of documents in four stages: language ID, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame that is written as Parquet and read
again for the next. All but the last return the columns of ``documents``. SQL can't express the trained
classifier, so there is no SQL for the whole; tests/llm/test_pipeline.py holds each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import small, stored
from quillspark.llm.jaccard import jaccard_components
from quillspark.llm.langid import fit, identify
from quillspark.llm.lines import dedup_lines
from quillspark.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, with that language; rejected ones go."""
    columns = docs.columns
    # Columns go by number meanwhile, so that none is taken for the operator's own.
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    found = identify(plain, fit(docs), id_col=f"c{columns.index('doc_id')}", text_col=f"c{columns.index('text')}")
    kept = found.where(~F.col("rejected"))
    return kept.select(*[(F.coalesce(f"c{k}", "lang_pred") if c == "lang" else F.col(f"c{k}")).alias(c) for k, c in enumerate(columns)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; those of which no line is left go."""
    found = dedup_lines(docs).where(F.col("n_dropped") < F.greatest(F.col("n_lines"), F.lit(1)))
    return found.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that shingle similarity links, the one with the smallest id."""
    found = jaccard_components(docs)
    gone = stored(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "near-gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]

#: None: a trained classifier is the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
