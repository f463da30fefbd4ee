"""Phrase counts against plain Python, and what their plans shuffle."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import phrases
from quillspark.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(text, most, redacted, stopwords):
    words = [w.lower() for w in text.split() if len(w) >= 2] if text else []
    runs = {tuple(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}
    return {" ".join(r) for r in runs if not set(r) & {*redacted, *phrases.ANSWERS} and not set(r) <= set(stopwords)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "the", "and", "Sky", "x", "blue", "tree"]) for _ in range(rng.randrange(9))), rng.choice("uv"), rng.choice(["p", "q", None])) for i in range(60)]
    return [*rows, (60, None, "u", "p")]


def test_counts_equal_plain_ones(spark):
    rows = documents(spark)
    df = spark.createDataFrame(rows, "i int, text string, source string, lang string")
    p = phrases.document_phrases(F.col("text"), 3, F.array(F.lit("red")), ["the", "and"])
    own = {i: plain(t, 3, ["red"], ["the", "and"]) for i, t, _, _ in rows}
    assert {r["i"]: set(r["phrases"] or []) for r in phrases.with_phrases(df, p, "i").collect()} == own
    want = Counter((scope, i % 2 == 0, lang, w) for i, _, source, lang in rows for scope in ("all", source) for w in own[i])
    held = Counter((i % 2 == 0, w) for i, *_ in rows for w in own[i])
    only = spark.createDataFrame([("blue",), ("the sky",), ("nothing",)], "phrase string")

    def counted(**kept):
        counts, totals = phrases.phrase_counts(df, p, [F.lit("all"), F.col("source")], F.col("i") % 2 == 0, F.col("lang"), F.length("text"), **kept)
        assert {tuple(r)[:3]: r["total"] for r in totals.collect()} == Counter((s, i % 2 == 0, lang) for i, _, source, lang in rows for s in ("all", source))
        got = [tuple(r) for r in counts.select("scope", "half", "label", "phrase", "df").collect()]
        assert len({g[:4] for g in got}) == len(got)
        return {g[:4]: g[4] for g in got}

    assert counted() == want
    assert counted(least=4) == {k: n for k, n in want.items() if held[k[1], k[3]] >= 4} != want
    assert counted(only=only) == {k: n for k, n in want.items() if k[3] in ("blue", "the sky")}


def test_phrases_are_shuffled_once(spark):
    """All counts of a phrase are made where it lies: one exchange holds phrases, also up to each scope's found ones."""
    k05 = plan(registry.queries()["k05_phrase_frequencies"](spark, DATA))
    assert k05.count("Exchange hashpartitioning") == k05.count("Exchange hashpartitioning(phrase") == 1
    k06 = plan(registry.queries()["k06_discovered_phrases"](spark, DATA))
    assert sum("phrase#" in line.split("hashpartitioning")[1].split(")")[0] for line in k06.splitlines() if "Exchange hashpartitioning" in line) == 1


def test_phrases_are_made_once(spark):
    k04 = plan(registry.queries()["k04_document_phrases"](spark, DATA))
    assert k04.count("regexp_extract_all") == 1
