"""Resampling against drawing every row, as the reference does, and over parts and partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import resampling

RNG = np.random.default_rng(5)


def _frame(spark, values, clusters=None):
    return spark.createDataFrame(pd.DataFrame({"g": "a", "v": values, "c": np.arange(len(values)) % 7 if clusters is None else clusters}))


def _one(df, function, *cluster, **more):
    return function(df, ["g"], F.col("v"), cluster, **more).collect()[0]


@pytest.mark.parametrize("part", [1 << 14, 40])
def test_rows_are_drawn(spark, monkeypatch, part):
    """In one part and in many."""
    monkeypatch.setattr(resampling, "PART", part)
    for x in (RNG.choice([-1.0, 0.0, 1.0], 600, p=[0.2, 0.45, 0.35]), RNG.normal(0.3, 1, 500)):
        df = _frame(spark, [*x, None, float("nan"), float("inf")])
        w = RNG.dirichlet(np.ones(len(x)), 4000) @ x
        b = x[RNG.integers(0, len(x), (4000, len(x)))].mean(1)
        for function, m in ((resampling.bayes_bootstrap, w), (resampling.bootstrap_mean, b)):
            got = _one(df, function)
            assert got.n == len(x) and abs(got["mean"] - x.mean()) < 0.004
            assert np.allclose([got.ci_low, got.ci_high], np.quantile(m, [0.025, 0.975]), atol=0.009)


def test_signs_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PART", 64)
    for x in (RNG.choice([-1.0, 0.0, 1.0], 600, p=[0.27, 0.4, 0.33]), RNG.normal(0.06, 1, 400)):
        reached = abs((RNG.choice([-1.0, 1.0], (4000, len(x))) * x).mean(1)) >= abs(x.mean()) - 1e-12
        got = _one(_frame(spark, x), resampling.sign_flip)
        assert got.n == len(x) and abs(got["mean"] - x.mean()) < 1e-12 and abs(got.p_value - reached.mean()) < 0.04


def test_clusters_by_size(spark):
    sizes = [200, 20, 15, 12, 8, 5, 3, 2, 1]
    parts = [RNG.normal(k % 3, 1, n) for k, n in enumerate(sizes)]
    x = np.concatenate(parts)
    got = _one(_frame(spark, x, np.repeat(np.arange(len(sizes)), sizes)), resampling.bootstrap_mean, "c")
    m = [np.concatenate([parts[k] for k in RNG.integers(0, len(parts), len(parts))]).mean() for _ in range(4000)]
    assert (got.n, got.n_clusters) == (len(x), len(sizes)) and abs(got["mean"] - x.mean()) < 1e-9
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(m, [0.025, 0.975]), atol=0.1)


def test_every_draw_has_as_many_units_as_the_group(spark, monkeypatch):
    """The split among parts is one multinomial, so nothing is drawn twice or lost."""
    monkeypatch.setattr(resampling, "PART", 30)
    df = _frame(spark, RNG.normal(size=500))
    found = resampling.units(df, ["g"], [], F.col("v"))
    assert found.select("part").distinct().count() > 10
    sums = resampling.drawn_sums(found, ["g"], resampling.replaced, 300, 1).collect()
    assert len(sums) == 300 and {r["wn"] for r in sums} == {500.0}
    assert len({round(r["ws"], 9) for r in sums}) > 290


@pytest.mark.parametrize("name", ["bootstrap_mean", "bayes_bootstrap", "sign_flip"])
def test_partitions_change_nothing(spark, monkeypatch, name):
    monkeypatch.setattr(resampling, "PART", 50)
    df = _frame(spark, RNG.normal(size=600)).unionByName(_frame(spark, RNG.normal(1, 2, size=300)).withColumn("g", F.lit(None).cast("string")))
    results = []
    for parts in (1, 50):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = getattr(resampling, name)(df.repartition(parts), ["g"], F.col("v"), draws=500).orderBy("g").collect()
        results.append([[x for x in r[1:]] for r in got])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(results[0]) == 2 and np.allclose(results[0], results[1], rtol=1e-12, atol=1e-12)


def test_draws_in_blocks(spark, monkeypatch):
    df = _frame(spark, RNG.normal(size=40))
    whole = _one(df, resampling.sign_flip, draws=50)
    monkeypatch.setattr(resampling, "CELLS", 80)
    assert _one(df, resampling.sign_flip, draws=50) == whole


def test_no_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", float("nan"), 2)], "g string, v double, c long")
    for name in ("bootstrap_mean", "bayes_bootstrap", "sign_flip"):
        assert getattr(resampling, name)(df, ["g"], F.col("v")).collect() == []
