"""The pipeline's stages against brute force on a small corpus, and queries with SQL against DuckDB."""

import random

import corpus_pipeline
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_lines, words

from quillspark.llm import langid, queries, tokens

FOLDER = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    """Texts of the table with copies, near copies and shared lines planted among them, and awkward rows."""
    rng = random.Random(4)
    own = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) between 200 and 1500").orderBy("doc_id").limit(60).collect()]
    shared = words(30, 900)
    out = []
    for k, t in enumerate(own):
        out.append((10 * k, t + ("\n" + shared if k % 7 == 0 else "")))
        if k % 5 == 0:
            out.append((10 * k + 1, t))
        if k % 6 == 0:
            near = t.split(" ")
            near[rng.randrange(len(near))] = "changed"
            out.append((10 * k + 2, " ".join(near)))
    return out + [(7001, None), (7002, ""), (7003, "12 34"), (7004, shared), (7004, shared)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], COLUMNS)


def plain_logits(model, text):
    """Mean of the n-grams' contributions, one n-gram at a time: from the space before the text to its last character."""
    points = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()}   "]
    total, size = np.zeros(len(model.languages)), len(model.table) // len(model.sizes)
    for k, n in enumerate(model.sizes):
        for at in range(len(points) - 3):
            h = 0
            for j in range(n):
                h = (h * 0x01000193 + points[at + j] * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            total += model.table[(h >> 13) % size + k * size]
    return total / ((len(points) - 3) * len(model.sizes)) + model.bias


def test_language_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(250).unionByName(frame(spark, [(9001, None), (9002, "12"), (9003, "это другой язык и буквы")]).withColumn("lang", F.lit("en")).select(*spark.read.parquet(f"{FOLDER}/documents.parquet").columns))
    model = langid.fit(docs)
    rows = docs.collect()
    together = model.logits([r["text"] or "" for r in rows[:25]])[0]
    for r, logits in zip(rows[:25], together, strict=True):
        assert np.allclose(logits, plain_logits(model, r["text"] or ""), atol=1e-6)
    want = sorted(r["doc_id"] for r in rows if not model.predict([r["text"] or ""])[2][0])
    got = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want and not {9001, 9002, 9003} & set(want)


@pytest.mark.parametrize("stage", ["language_id", "line_dedup", "near_duplicates"])
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 40").withColumns({c: F.lit(f"own {c}") for c in ("Score", "a.b", "N_Lines", "Rejected", "component_id")})
    got = getattr(corpus_pipeline, stage)(spark, docs, FOLDER)
    assert got.columns[:5] == docs.columns[:5] and {"a.b", "component_id"} <= set(got.columns)
    got.write.mode("overwrite").format("noop").save()
    if stage != "line_dedup":
        assert got.columns == docs.columns and {r["Score"] for r in got.collect()} == {"own Score"}


def test_line_and_duplicate_and_packing_stages(spark):
    rows = corpus(spark)
    docs = frame(spark, rows)
    kept = corpus_pipeline.line_dedup(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    want = [(i, t) for i, t, dropped, n in brute_lines(rows) if dropped < max(n, 1)]
    found = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
    assert sorted(map(repr, found)) == sorted(repr((i, t, None if t is None else len(t))) for i, t in want)
    after = corpus_pipeline.near_duplicates(spark, kept, FOLDER)
    component = brute_components(want)
    left = [(i, t) for i, t in want if component[i] == i]
    found = [(r["doc_id"], r["text"]) for r in after.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, left))
    # On the corpus as it was, whose copies are whole, too.
    component = brute_components(rows)
    found = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(found) == sorted(i for i, _ in rows if component[i] == i) and len(found) < len(rows) - 15
    packed = corpus_pipeline.packing(spark, after, FOLDER).collect()
    library = tokens.encoder(tokens.default_tokenizer())
    covered = {}
    for r in packed:
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert set(covered) == {i for i, _ in left}
    for i, t in left:
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at
            at += length
        assert at == (len(library.by_library(t)) if t else 0) + 1 or [x for x, _ in left].count(i) > 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(), name, queries.queries()[name], queries.oracle_sql()[name]) == ""
