"""Importance resampling against plain Python and against SQL."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import resample

SCHEMA = "doc_id long, text string"


def features(text):
    own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return own, own + [f"{a} {b}" for a, b in zip(own, own[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def plain(docs, target, percent=25):
    def counted(texts):
        out = [0] * 10_000
        for t in texts:
            for f in features(t)[1]:
                out[bucket(f)] += 1
        return out

    s, t = counted(x for _, x in docs), counted(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, fit[: percent * len(fit) // 100]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ünder", "x9", "42", "DELTA", "e", "日本", "naïve", "zeta"]
    docs = [(i, rng.choice([" ", "\n", "--", "_"]).join(rng.choice(words) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(45)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " \x00 -- "), (None, "null id " * 30), (n + 3, "a" * 50_000), (n + 4, "lone " * 40_000)]


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resampling_equals_plain(spark, percent):
    docs, target = corpus(), ["alpha beta ünder", "x9 x9 beta", None, ""]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"Score": F.lit("own"), "rank": F.lit(1), "n_features": F.lit(2)}).repartition(4)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).collect()
    rows, drawn = plain(docs, target, percent)
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted([r[:4] for r in rows], key=repr)
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == [r[0] for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))


def test_repeated_rows_and_empty_tables(spark):
    docs = [(7, "one two " * 20)] * 10 + [(8, "one two " * 20)] * 2
    none = spark.createDataFrame([], "text string")
    got = resample.resample(spark.createDataFrame(docs, SCHEMA), none).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2, 3] and len(got) == 12
    assert resample.resample(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_runs_go_on_across_parts(monkeypatch):
    text = ("Ab cd9 ünd --ef " * 50).encode()
    whole = np.sort(np.concatenate([b for _, b in resample.buckets(text, 10_000, 3)]))
    cut = resample.byte_words
    monkeypatch.setattr(resample, "byte_words", lambda t, table: cut(t, table, 7))
    parts = list(resample.buckets(text, 10_000, 3))
    assert len(parts) > 20 and np.array_equal(whole, np.sort(np.concatenate([b for _, b in parts])))


def test_kth_key_finds_any_key(spark):
    rng = random.Random(5)
    edges = [-(1 << 63), (1 << 63) - 1, 0, -1, 1 << 40]
    rows = [(rng.choice([*edges, rng.randrange(-50, 50)]), rng.choice([0, 1]), rng.choice([*edges, rng.getrandbits(62)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 57, 143, 200):
        assert tuple(resample.kth_key(df, ["a", "b", "c"], k)) == sorted(rows)[k - 1]
    df.unpersist()

