"""Tails and expectations as column expressions against plain Python, and against SQL-free brute force."""

import math
import random
from collections import Counter
from collections.abc import Sequence

import pytest
from pyspark.sql import functions as F

from quillspark.functions import laws, special
from quillspark.operators import models, stats


def expected_information(rows: Sequence[int], columns: Sequence[int]) -> float:
    """Expected mutual information of random tables with these margins (hypergeometric cells).

    Of a cell's counts those within 12 standard deviations of its mean are summed; the rest weighs less than 1e-30.
    """
    n = sum(rows)
    lf = lambda k: math.lgamma(k + 1)
    out = 0.0
    for a, classes_a in Counter(rows).items():
        for b, classes_b in Counter(columns).items():
            mean = a * b / n
            reach = 12 * math.sqrt(mean * (n - a) * (n - b) / n / max(1, n - 1)) + 12
            fixed = lf(a) + lf(b) + lf(n - a) + lf(n - b) - lf(n)
            for k in range(max(1, a + b - n, int(mean - reach)), min(a, b, int(mean + reach) + 1) + 1):
                log_p = fixed - lf(k) - lf(a - k) - lf(b - k) - lf(n - a - b + k)
                out += classes_a * classes_b * k / n * math.log(n * k / (a * b)) * math.exp(log_p)
    return out


def test_tails_of_t_and_f(spark):
    rows = [(t, d) for t in (0.0, 1e-9, 0.1, 1.0, -2.5, 10.0, 60.0, 1e4) for d in (1.0, 2.0, 3.0, 30.0, 997.0, 1e5)]
    df = spark.createDataFrame(rows, "t double, d double")
    found = df.select("*", laws.t_two_sided(F.col("t"), F.col("d")).alias("p"), laws.f_log_tail(F.abs("t"), F.lit(3.0), F.col("d")).alias("log_p")).collect()
    for r in found:
        assert r.p == pytest.approx(special.t_two_sided(r.t, r.d), rel=1e-9, abs=1e-300)
        assert r.log_p == pytest.approx(special.f_log_tail(abs(r.t), 3.0, r.d), rel=1e-9, abs=1e-10)


def test_edges_of_tails(spark):
    rows = [(math.nan, 3.0), (1.0, 0.0), (math.inf, 3.0), (None, 3.0), (1.0, None)]
    found = spark.createDataFrame(rows, "t double, d double").select(laws.t_two_sided(F.col("t"), F.col("d")).alias("p")).collect()
    assert math.isnan(found[0].p) and math.isnan(found[1].p) and found[2].p == 0.0 and found[3].p is None and found[4].p is None
    # Far degrees of freedom: the normal law's tail, and one term more.
    far = spark.range(1).select(laws.t_two_sided(F.lit(1.0), F.lit(1e7)).alias("p")).head().p
    assert far == pytest.approx(math.erfc(math.sqrt(0.5)) + math.exp(-0.5) / math.sqrt(2 * math.pi) / 1e7, abs=1e-13)


def test_log_beta(spark):
    rows = [(a, b) for a in (1e-3, 0.5, 1.0, 9.5, 300.0) for b in (0.5, 2.0, 40.0)]
    for r in spark.createDataFrame(rows, "a double, b double").select("*", laws.log_beta(F.col("a"), F.col("b")).alias("v")).collect():
        assert r.v == pytest.approx(special.log_beta(r.a, r.b), abs=1e-11)


def test_exact_tests(spark):
    rng = random.Random(1)
    rows = [(0, 0, 0, 0), (0, 5, 5, 0), (5, 0, 0, 5), (3, 0, 4, 0), (1, 0, 0, 0), (0, 3, 0, 9), (40_000, 5, 3, 60_000)]
    rows += [tuple(int(rng.expovariate(1) * 10 ** rng.randint(0, 4)) for _ in range(4)) for _ in range(200)]
    found = stats.exact_test(spark.createDataFrame([*rows, (None, 1, 1, 1)], "a long, b long, c long, d long"), "a", "b", "c", "d").collect()
    assert found[-1].p_value is None
    for r in found[:-1]:
        odds, p = special.fisher_exact_greater(r.a, r.b, r.c, r.d)
        assert r.odds_ratio == pytest.approx(odds, rel=1e-12, nan_ok=True)
        assert r.p_value == pytest.approx(p, abs=1e-9) and (p > 1e-3 or r.p_value == pytest.approx(p, rel=1e-7, abs=1e-300))


def test_no_python_workers(spark):
    df = spark.createDataFrame([("g", k % 5, float(k % 7), float(k % 11)) for k in range(60)], "g string, c int, x double, y double")
    tables = df.selectExpr("c as a", "2 as b", "3 as c", "4 as d")
    labels = models.contingency(df, "c", "x")
    plans = [stats.spearman_p(df, ["g"], "x", "y"), stats.cluster_contrast(df, ["g"], ["c"], F.col("x")), stats.exact_test(tables, "a", "b", "c", "d"), models.adjusted_information(labels, "c", "x")]
    for out in plans:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_adjusted_information(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(4) if rng.random() < 0.7 else rng.randrange(9), rng.randrange(6)) for k in range(500)]
    rows = [(k, a, a % 3 if k % 2 else b) for k, a, b in rows]
    got = models.adjusted_information(models.contingency(spark.createDataFrame(rows, "k int, a int, b int"), "a", "b"), "a", "b").head()
    ra, rb, cells = ({}, {}, {})
    for _, a, b in rows:
        ra[a], rb[b], cells[a, b] = ra.get(a, 0) + 1, rb.get(b, 0) + 1, cells.get((a, b), 0) + 1
    mi = sum(c / 500 * math.log(c * 500 / (ra[a] * rb[b])) for (a, b), c in cells.items())
    ha, hb = (-sum(v / 500 * math.log(v / 500) for v in r.values()) for r in (ra, rb))
    expected = expected_information(list(ra.values()), list(rb.values()))
    assert got.n == 500 and got.mi == pytest.approx(mi, abs=1e-12) and got.expected_mi == pytest.approx(expected, abs=1e-12)
    assert got.ami == pytest.approx((mi - expected) / ((ha + hb) / 2 - expected), abs=1e-11)
    assert expected_information([2, 2], [2, 2]) == pytest.approx(math.log(2) / 3)


def test_adjusted_information_of_many_classes(spark):
    rows = spark.range(300_000).selectExpr("id % 100000 as a", "id % 99991 as b")
    got = models.adjusted_information(models.contingency(rows, "a", "b"), "a", "b").head()
    # No two rows are alike, so every cell holds one: less is shared than by chance.
    sizes = [[300_000 // m + (k < 300_000 % m) for k in range(m)] for m in (100_000, 99_991)]
    mi = sum(math.log(300_000 / (sizes[0][k % 100_000] * sizes[1][k % 99_991])) for k in range(300_000)) / 300_000
    assert got.n == 300_000 and got.mi == pytest.approx(mi, rel=1e-9)
    assert got.expected_mi == pytest.approx(expected_information(*sizes), rel=1e-9)
    empty = models.contingency(rows.where("a < 0"), "a", "b")
    assert models.adjusted_information(empty, "a", "b").collect() == []
