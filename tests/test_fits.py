"""Fits over aggregated cells against least squares over every row, dummies and all."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions.special import f_log_tail
from quillspark.operators import sensitivity
from quillspark.plans.bindings import FACTORS, scores

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return scores(spark, SMALL)


@pytest.fixture(scope="module")
def plain(rows):
    return rows.toPandas()


def residual(df, columns):
    """Residual sum of squares and rank of an intercept and the given columns."""
    x = np.column_stack([np.ones(len(df)), *columns]).astype(float)
    y = df["score"].to_numpy(float)
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum()), int(rank)


def dummies(df, terms):
    return [c for t in terms for c in pd.get_dummies(df[t].astype(str), drop_first=True).to_numpy(float).T]


def terms_of(df, terms):
    """Residual, and per term its squares, degrees of freedom, F and log p given the others; None without a fit."""
    active = [t for t in terms if df[t].nunique() > 1]
    rss, rank = residual(df, dummies(df, active))
    left = len(df) - rank
    if not active or left <= 0:
        return None
    out = {"residual": (rss, left)}
    for t in active:
        less, own = residual(df, dummies(df, [a for a in active if a != t]))
        ss, free = max(less - rss, 0.0), rank - own
        f = ss / free / (rss / left) if free and rss > 0 else math.nan
        out[t] = (ss, free, f, f_log_tail(f, free, left) if f > 0 else math.nan)
    return out


@pytest.mark.parametrize("strata, terms", [(["model", "stratum"], FACTORS), (["model", "stratum"], ["block", *FACTORS]), (["model"], ["stratum", "block", *FACTORS])])
def test_sums_of_squares(rows, plain, strata, terms):
    found = sensitivity.anova_by(rows, strata, terms, "score").toPandas()
    assert len(found.groupby(strata)) == len(plain.groupby(strata))
    for key, own in plain.groupby(strata):
        want = terms_of(own, terms)
        mask = np.logical_and.reduce([found[s] == v for s, v in zip(strata, key, strict=True)])
        got = found[mask].set_index("term")
        if want is None:
            assert list(got.index) == ["unfitted"]
            continue
        assert set(got.index) == set(want) and (got.n == len(own)).all()
        assert got.total_ss.iloc[0] == pytest.approx(((own.score - own.score.mean()) ** 2).sum())
        for term, values in want.items():
            r = got.loc[term]
            assert r.df == values[1] and r.ss == pytest.approx(values[0], rel=1e-8, abs=1e-7)
            if term != "residual" and values[1] > 0:
                assert r.f == pytest.approx(values[2], rel=1e-6, abs=1e-9, nan_ok=True) and r.log_p == pytest.approx(values[3], rel=1e-6, abs=1e-8, nan_ok=True)


def test_variation_adds_up(rows, plain):
    found = {r["model"]: r for r in sensitivity.variation(rows, "model", "stratum", FACTORS, "score", "blur", "l_linenumber").collect()}
    for model, own in plain.groupby("model"):
        ss, rest, free = dict.fromkeys(FACTORS, 0.0), 0.0, 0
        for _, part in own.groupby("stratum"):
            fit = terms_of(part, FACTORS) or {"residual": (((part.score - part.score.mean()) ** 2).sum(), max(len(part) - 1, 0))}
            rest, free = rest + fit["residual"][0], free + fit["residual"][1]
            for f in FACTORS:
                ss[f] += fit[f][0] if f in fit else 0.0
        kept = sum(v for f, v in ss.items() if f != "l_linenumber")
        r = found[model]
        assert r["total_variation"] == pytest.approx(math.sqrt((kept + rest + own.blur.sum()) / len(own)))
        assert r["residual_jitter"] == pytest.approx(math.sqrt(rest / free)) and r["response_entropy"] == pytest.approx(math.sqrt(own.blur.mean()))
        assert all(r[f"{f}_sd"] == pytest.approx(math.sqrt(ss[f] / len(own)), abs=1e-6) for f in FACTORS)


def test_residual_of_one_fit(rows, plain):
    for r in sensitivity.residual_rmse(rows, "model", FACTORS, "score").collect():
        own = plain[plain.model == r["model"]]
        rss, rank = residual(own, dummies(own, [f for f in FACTORS if own[f].nunique() > 1]))
        assert (r["n"], r["rank"]) == (len(own), rank) and r["rmse"] == pytest.approx(math.sqrt(rss / (len(own) - rank)))


def test_one_term(rows, plain):
    for r in sensitivity.single_term_test(rows, "model", "stratum", ["block", *FACTORS], "score").collect():
        want = terms_of(plain[plain.model == r["model"]], ["stratum", "block", *FACTORS])["stratum"]
        assert r["df"] == want[1] and r["f"] == pytest.approx(want[2], rel=1e-6) and r["log10p"] == pytest.approx(want[3] / math.log(10), rel=1e-6)


def test_interaction(rows, plain):
    for r in sensitivity.interaction_test(rows.withColumn("size", F.col("l_linenumber")), "model", "stratum", "size", "score").collect():
        own = plain[plain.model == r["model"]]
        s, d = own.l_linenumber.to_numpy(float), dummies(own, ["stratum"])
        (reduced, r0), (full, r1) = residual(own, [s, *d]), residual(own, [s, *d, *[c * s for c in d]])
        f = (reduced - full) / (r1 - r0) / (full / (len(own) - r1))
        assert (r["df1"], r["df2"]) == (r1 - r0, len(own) - r1) and r["f"] == pytest.approx(f, rel=1e-6)
        assert r["p"] == pytest.approx(math.exp(f_log_tail(f, r1 - r0, len(own) - r1)), rel=1e-6)


def test_combined_p_values(rows):
    anovas = sensitivity.anova_by(rows, ["model", "stratum"], FACTORS, "score")
    own = anovas.toPandas()
    own = own[own.log_p.notna() & ~own.term.isin(["residual", "unfitted"])]
    for r in sensitivity.fisher_combined(anovas, ["model"]).collect():
        p = own[(own.model == r["model"]) & (own.term == r["term"])].log_p
        half = -p.sum()
        tail = math.log(sum(math.exp(i * math.log(half) - math.lgamma(i + 1)) for i in range(len(p)))) - half
        assert r["k"] == len(p) and r["chi2"] == pytest.approx(2 * half) and r["log10p"] == pytest.approx(tail / math.log(10), abs=1e-9)


def test_combination_of_many_p_values(spark):
    """Sums whose terms pass the largest double, as those of some 500 p-values do, against exact ones."""
    logs = [math.log((7919 * k % 1000 + 1) / 2000) for k in range(700)]
    df = spark.createDataFrame([("a", "x", v) for v in logs], "model string, term string, log_p double")
    r = sensitivity.fisher_combined(df, ["model"]).first()
    half = Fraction(r["chi2"]) / 2
    term = total = Fraction(1)
    for i in range(1, 700):
        term = term * half / i
        total += Fraction(round(term * 2**100), 2**100)
        term = Fraction(round(term * 2**100), 2**100)
    tail = math.log(total.numerator) - math.log(total.denominator) - float(half)
    assert r["chi2"] == pytest.approx(-2 * math.fsum(logs)) and total > 10**309
    assert r["log10p"] == pytest.approx(tail / math.log(10), abs=1e-9)


def test_combination_below_the_least_double(spark, tmp_path):
    """The query's tail keeps all its terms where p is less than 1e-308, as its SQL states it."""
    from quillspark.plans import registry

    path = str(tmp_path)
    spark.range(6000).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size"), F.lit("x").alias("p_brand")).write.parquet(f"{path}/part.parquet")
    r = registry.queries()["st06_combined_p_values"](spark, path).first()
    half = -math.fsum(math.log((7919 * k % 1000 + 1) / 2000) for k in range(6000))
    logs = [i * math.log(half) - math.lgamma(i + 1) for i in range(6000)]
    tail = max(logs) + math.log(math.fsum(math.exp(v - max(logs)) for v in logs)) - half
    assert r["k"] == 6000 and tail / math.log(10) < -308
    assert r["log10p"] == pytest.approx(tail / math.log(10), abs=1e-5)
