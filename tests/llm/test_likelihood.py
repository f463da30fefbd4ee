"""LM scoring against sums over all segmentations in plain Python."""

import functools
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lattice, likelihood

SCHEMA = "doc_id long, text string, lang string"
PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "c", "▁c", "bc", "cab", None]


def vocabulary():
    return lattice.Vocabulary(PIECES, {}, 12)


def scores(seed=0):
    w = np.random.default_rng(seed).random(len(PIECES)) + 0.05
    return np.log(w / w.sum())


def brute(word, s, marked=True):
    """Log of the sum over all segmentations, and the expected uses of each piece."""
    text = ("▁" if marked else "") + word
    paths = []

    def walk(at, used):
        if at == len(text):
            paths.append(used)
        elif at < len(text):
            found = [k for k, p in enumerate(PIECES) if p and text.startswith(p, at) and "▁" not in text[1:]]
            for k in found:
                walk(at + len(PIECES[k]), [*used, k])
            if text[at] not in PIECES:
                walk(at + 1, [*used, 12])

    walk(0, [])
    weights = [math.exp(sum(s[k] for k in p)) for p in paths]
    uses = np.zeros(len(PIECES))
    for w, p in zip(weights, paths, strict=True):
        np.add.at(uses, p, w / sum(weights))
    return math.log(sum(weights)), uses


def test_lattice_sums_all_segmentations():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(9))) for _ in range(200)]
    s = scores()
    assert np.allclose(lattice.log_likelihoods(words, vocabulary(), s), [brute(w, s)[0] for w in words], atol=1e-12)
    counts = np.arange(1.0, 201)
    assert np.allclose(lattice.expected_uses(words, counts, vocabulary(), s), sum(n * brute(w, s)[1] for n, w in zip(counts, words, strict=True)))


def test_long_words_go_window_by_window(monkeypatch):
    rng, s, v = random.Random(2), scores(), vocabulary()
    word = "".join(rng.choice("abcé") for _ in range(1400))
    whole = lattice.log_likelihoods([word], v, s)[0]
    monkeypatch.setattr(lattice, "_WINDOW", 37)
    assert abs(lattice.long_likelihood(word, v, s) - whole) < 1e-8
    monkeypatch.setattr(lattice, "LONG", 50)
    assert abs(lattice.log_likelihoods([word, "ab"], v, s)[0] - whole) < 1e-8
    # Learning takes a long word in parts; each is used up whole.
    uses = lattice.expected_uses([word], np.ones(1), v, s)
    assert abs(sum(u * len(p or "x") for u, p in zip(uses, PIECES, strict=True)) - 1401) < 1e-6


def test_a_mark_in_a_text_is_no_boundary():
    v, s = vocabulary(), scores()
    assert lattice.log_likelihoods(["a▁a"], v, s)[0] < lattice.log_likelihoods(["a"], v, s)[0] + s[12] + 1e-9


def test_words_probabilities_sum_to_one():
    """Over all words, by length, where pieces with the mark begin and others follow."""
    v, s = lattice.Vocabulary(["▁", "▁a", "▁b", "a", "b", "ab"], {}, 0), np.log(np.array([0.1, 0.3, 0.2, 0.1, 0.1, 0.2]))
    # The word without letters is the mark alone.
    words = ["".join(x) for n in range(13) for x in itertools.product("ab", repeat=n)]
    assert 0.98 < np.exp(lattice.log_likelihoods(words, v, s)).sum() < 1 + 1e-9


def documents(seed=3):
    rng = random.Random(seed)
    own = {"xx": ["ab", "cab", "Abba", "bcab", "ba"], "yy": ["élan", "naïf", "ça", "où"], None: ["1", "2,3", "日本"]}
    docs = []
    for i in range(80):
        lang = rng.choice(list(own))
        docs.append((i, rng.choice([" ", "\n", "\t  "]).join(rng.choice([*own[lang], f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 40))), lang))
    return docs + [(80, None, "xx"), (81, "", None), (82, " \x0b\x0c ", "yy"), (83, "▁ <s> </s> \x00", "xx"), (84, "q" * 5000, "yy"), (None, "no id", None), (5, "twice", "xx"), (5, "twice", "xx")]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_scores_equal_plain(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"Score": F.lit(1), "block": F.lit("x"), "word": F.lit("y")}).repartition(3)
    got = likelihood.score_texts(df, block_bytes=300).toPandas()
    names, s = likelihood.load(likelihood.default_model(), "bpe")
    train = [d for d in docs if not held(d[0])]
    counts = {}
    by_class = {c: {} for c in ("xx", "yy", None)}
    for _, text, c in train:
        for w in tokens(text):
            counts[w] = counts.get(w, 0) + 1
            by_class[c][w] = by_class[c].get(w, 0) + 1
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    for _ in range(3):
        uses = lattice.expected_uses(list(counts), np.ones(len(counts)), names, s) + 0.1
        s = np.log(uses / uses.sum())

    @functools.cache
    def pieces(w):
        return lattice.log_likelihoods([w], names, s)[0]

    def class_log(c, text):
        own, m = by_class[c], sum(by_class[c].values())
        n = sum(x[2] == c for x in train)
        unseen, end = (sum(x == 1 for x in own.values()) + 0.5) / (m + 1), (n + 0.5) / (n + m + 1)
        out = math.log((n + 0.5) / (len(train) + 1.5)) + math.log(end)
        for w in tokens(text):
            out += math.log((1 - unseen) * own.get(w, 0) / m + unseen * math.exp(pieces(w))) if pieces(w) > -600 else math.log(unseen) + pieces(w) if not own.get(w) else math.log((1 - unseen) * own[w] / m)
            out += math.log(1 - end)
        return out

    expected = []
    for i, text, _ in docs:
        own = tokens(text)
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in own) + math.log10((len(train) + 1) / (total + distinct + 1))
        logs = [class_log(c, text) for c in by_class]
        score = (max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))) / math.log(10)
        expected.append((i, held(i), len(own) + 1, sum(w in counts for w in own) + 1, total, base, score, sum(map(pieces, own)) / math.log(10)))
    rows = sorted(((None if r[0] != r[0] else int(r[0]), *r[1:]) for r in got.itertuples(index=False)), key=repr)
    expected.sort(key=repr)
    assert [r[:5] for r in rows] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in rows], [r[5:] for r in expected], rtol=1e-9)


def test_held_out_texts_teach_nothing(spark):
    docs = documents()
    other = [(i, "other words entirely" if held(i) else t, c) for i, t, c in docs]
    a, b = (likelihood.score_texts(spark.createDataFrame(x, SCHEMA)).where("not held_out").toPandas().sort_values(["doc_id", "score"]) for x in (docs, other))
    assert len(a) > 50 and np.allclose(a.score, b.score, rtol=1e-12) and (a.train_tokens.to_numpy() == b.train_tokens.to_numpy()).all()


def test_empty_and_untrained_tables(spark):
    assert likelihood.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    one = next(i for i in range(100) if held(i))
    got = likelihood.score_texts(spark.createDataFrame([(one, "ab ab", "xx")], SCHEMA), class_col=None).collect()
    assert [tuple(r)[:5] for r in got] == [(one, True, 3, 0, 0)] and got[0]["score"] < got[0]["lattice_score"] < 0
    assert got[0]["base_score"] == 0


@pytest.mark.parametrize("classes", [1, 15])
def test_classes_beyond_the_most_frequent_are_one(spark, classes):
    got = likelihood.score_texts(spark.createDataFrame(documents(), SCHEMA), classes=classes, rounds=0).toPandas()
    assert len(got) == 88 and np.isfinite(got.score).all() and (got.score < 0).all()


def test_held_out_words_are_likelier_than_by_add_one(spark):
    """On larger tables: the mixture beats add-one words on documents that it hasn't seen."""
    got = likelihood.score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("lattice_score")).first()
    assert got[0] > got[1] > got[2]
