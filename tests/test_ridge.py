"""Ridge by folds against separate fits on explicit matrices, and folds against dealing group by group."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import numbering, ridge

SETS = {"text": {"text": "t"}, "kinds": {"categories": ["c", "e"]}, "numbers": {"numbers": ["x", "z"]}, "all": {"text": "t", "categories": ["c", "e"], "numbers": ["x", "z"]}}


def rows(n=160, seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta eta theta iota kappa Ünder x9".split()
    out = []
    for i in range(n):
        text = rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))]) if i % 9 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
        c, x, z = rng.choice(["p", "q", "r", None]), rng.choice([None, float("nan"), rng.gauss(3, 2)]) if i % 4 == 0 else rng.gauss(3, 2), float(i % 7)
        y = (text or "").count("alpha") + (c == "q") + 0.3 * (x if x and x == x else 0) + rng.gauss(0, 0.2)
        out.append((f"g{int(rng.random() ** 2 * 11)}", text, c, f"only{i}" if i % 40 == 0 else "e", x, z, y))
    return out + [("g1", "no target", "p", "e", 1.0, 1.0, None), (None, "null group alpha", "p", "e", 1.0, 1.0, 2.0)]


def frame(spark, data):
    return spark.createDataFrame(data, "g string, t string, c string, e string, x double, z double, y double").repartition(4)


def separate(train, test, text, kinds, numbers, alpha=10.0):
    """scikit-style: everything fitted on the training rows, a dense solve."""
    parts, held = [], []
    if text:
        counts = [ridge.terms_of(r[1]) for r in train]
        df = Counter(t for c in counts for t in c)
        names = sorted(t for t, n in df.items() if n >= 2)
        idf = [math.log((1 + len(train)) / (1 + df[t])) + 1 for t in names]
        for side, out in ((train, parts), (test, held)):
            out.append(np.array([[(1 + math.log(c[t])) * w if c[t] else 0.0 for t, w in zip(names, idf, strict=True)] for c in (ridge.terms_of(r[1]) for r in side)]).reshape(len(side), len(names)))
    for k in kinds:
        names = sorted({r[k] or "" for r in train})
        for side, out in ((train, parts), (test, held)):
            out.append(np.array([[float((r[k] or "") == v) for v in names] for r in side]).reshape(len(side), len(names)))
    for k in numbers:
        known = sorted(r[k] for r in train if r[k] is not None and r[k] == r[k])
        middle = known[(len(known) - 1) // 2]
        own = np.array([r[k] if r[k] is not None and r[k] == r[k] else middle for r in train])
        for side, out in ((train, parts), (test, held)):
            v = np.array([r[k] if r[k] is not None and r[k] == r[k] else middle for r in side])
            out.append(((v - own.mean()) / (own.std() or 1.0))[:, None])
    x, y = np.hstack(parts), np.array([r[6] for r in train])
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
    return np.hstack(held) @ w + y.mean() - x.mean(0) @ w


def test_all_folds_and_sets_equal_separate_fits(spark):
    data = rows()
    got = ridge.grouped_ridge(frame(spark, data), "y", "g", SETS, folds=4).collect()
    folds = {r["g"]: r["fold"] for r in got}
    assert sorted(Counter(folds.values())) == [0, 1, 2, 3] and len(got) == 4 * (len(data) - 1)
    use = {"text": (True, [], []), "kinds": (False, [2, 3], []), "numbers": (False, [], [4, 5]), "all": (True, [2, 3], [4, 5])}
    for name, columns in use.items():
        for f in range(4):
            own = [r for r in data if r[6] is not None]
            train, test = [r for r in own if folds[r[0]] != f], [r for r in own if folds[r[0]] == f]
            want = sorted(zip([r[6] for r in test], separate(train, test, *columns), strict=True))
            found = sorted((r["truth"], r["predicted"]) for r in got if r["features"] == name and r["fold"] == f)
            assert np.allclose(found, want, atol=1e-6), (name, f)


def test_one_reading(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = frame(spark, rows(60))
    ridge.ablation(df.mapInArrow(counted, df.schema), "y", "g", SETS, folds=3).collect()
    assert seen.value == 62


def test_cells_go_on_in_parts(spark, monkeypatch):
    df = frame(spark, rows(60))
    whole = ridge.grouped_ridge(df, "y", "g", SETS, folds=3).orderBy("features", "truth").collect()
    monkeypatch.setattr(ridge, "_CELLS", 10)
    again = ridge.grouped_ridge(df, "y", "g", SETS, folds=3).orderBy("features", "truth").collect()
    assert np.allclose([r["predicted"] for r in whole], [r["predicted"] for r in again], atol=1e-9)


def test_one_group_is_an_error(spark):
    with pytest.raises(ValueError, match="groups"):
        ridge.grouped_ridge(frame(spark, [r for r in rows(20) if r[0] == "g1"]), "y", "g", SETS)


@pytest.mark.parametrize("seed", range(20))
def test_dealing_is_greedy(seed):
    rng = random.Random(seed)
    folds = rng.randrange(2, 7)
    sizes = Counter(rng.choice([1, 1, 1, 2, 3, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 80)))
    counts = sorted(sizes.items(), reverse=True)
    loads = [0] * folds
    for size, n in counts:
        for _ in range(n):
            loads[loads.index(min(loads))] += size
    shares = numbering.dealt(counts, folds)
    assert [sum(s) for s in shares] == [n for _, n in counts]
    assert sorted(sum(c * own[f] for (c, _), own in zip(counts, shares, strict=True)) for f in range(folds)) == sorted(loads)


def test_numbers_follow_a_global_order(spark):
    df = spark.range(0, 5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("k")).repartition(6)
    got = numbering.numbered(df, ["k", F.desc("id")], "at").collect()
    want = sorted(((r["k"], -r["id"]) for r in got))
    assert [(r["k"], -r["id"]) for r in sorted(got, key=lambda r: r["at"])] == want and sorted(r["at"] for r in got) == list(range(5000))
