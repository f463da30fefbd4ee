"""How much of a score's variation each design factor carries.

Between-group sums of squares are grouped aggregates. Additive models need least squares, but only on a table of
factor-level cells: Spark sums n, y and y squared per cell, and one small solve per stratum follows in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.special import f_log_tail
from quillspark.operators.numbering import with_group


def stacked(df: DataFrame, factors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each factor: ``keep`` columns, factor, level (null levels stay levels of their own)."""
    levels = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    return df.select(*keep, F.explode(levels).alias("_f")).select(*keep, "_f.factor", "_f.level")


def between_ss(df: DataFrame, strata: Sequence[str], factors: Sequence[str], score: str) -> DataFrame:
    """Per stratum and factor: levels, n, and the sum of squares of level means about the stratum's mean."""
    sums = stacked(df.where(F.col(score).isNotNull()), factors, [*strata, score]).groupBy(*strata, "factor", "level").agg(F.count("*").alias("n"), F.avg(score).alias("m"))
    w = Window.partitionBy(*strata, "factor")
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    terms = sums.withColumn("ss", F.col("n") * F.pow(F.col("m") - grand, F.lit(2.0)))
    return terms.groupBy(*strata, "factor").agg(F.count("*").alias("levels"), F.sum("n").alias("n"), F.greatest(F.sum("ss"), F.lit(0.0)).alias("ss"))


def factor_spread(df: DataFrame, model: Sequence[str], stratum: str, factors: Sequence[str], score: str) -> DataFrame:
    """Per model and factor: sqrt of the pooled within-stratum sums of squares over n; strata with one level add nothing."""
    per = between_ss(df, [*model, stratum], factors, score)
    ss = F.sum(F.when(F.col("levels") >= 2, F.col("ss")).otherwise(0.0))
    return per.groupBy(*model, "factor").agg(F.sqrt(ss / F.sum("n")).alias("spread"), F.sum("n").alias("n"))


def spread_overview(df: DataFrame, model: Sequence[str], stratum: str, score: str, population: bool = True) -> DataFrame:
    """Per model: sd of the score and of stratum means, over n (descriptive) or n - 1."""
    sd = F.stddev_pop if population else F.stddev_samp
    means = df.groupBy(*model, stratum).agg(F.avg(score).alias("m")).groupBy(*model).agg(sd("m").alias("stratum_sd"))
    return df.groupBy(*model).agg(sd(score).alias("total_sd"), F.count(score).alias("n")).join(means, list(model))


def without_block(df: DataFrame, model: Sequence[str], block: str, score: str, out: str) -> DataFrame:
    """``df`` with its score less the block's mean, plus the model's, as ``out``: block means joined, no window of all rows."""
    blocks = df.groupBy(*model, block).agg(F.sum(score).alias("_sum"), F.count(score).alias("_n"))
    whole = Window.partitionBy(*model)
    shift = F.try_divide(F.sum("_sum").over(whole), F.sum("_n").over(whole).cast("double")) - F.try_divide("_sum", F.col("_n").cast("double"))
    return with_group(df, [*model, block], blocks.select(*model, block, shift.alias("_shift"))).withColumn(out, F.col(score) + F.col("_shift")).drop("_shift")


def cells(df: DataFrame, by: Sequence[str], factors: Sequence[str], score: str) -> DataFrame:
    """Sufficient statistics of additive models: n, sum and centred sum of squares per combination of levels."""
    rows = df.where(F.col(score).isNotNull()).select(*by, *[F.coalesce(F.col(f).cast("string"), F.lit("<null>")).alias(f) for f in factors], F.col(score).cast("double").alias("_y"))
    return rows.groupBy(*by, *factors).agg(F.count("*").alias("n"), F.avg("_y").alias("y"), (F.coalesce(F.var_pop("_y"), F.lit(0.0)) * F.count("_y")).alias("within"))


def additive_fit(cell: pd.DataFrame, terms: Sequence[str]) -> tuple[float, int]:
    """Residual sum of squares and rank of an intercept and the dummies of the terms, by weighted cells."""
    n = cell["n"].to_numpy(float)
    columns = [np.ones(len(cell))]
    for t in terms:
        codes, levels = pd.factorize(cell[t], sort=True)
        columns += [(codes == k).astype(float) for k in range(1, len(levels))]
    x, y = np.stack(columns, axis=1), cell["y"].to_numpy(float)
    root = np.sqrt(n)
    beta, _, rank, _ = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)
    return float((n * (y - x @ beta) ** 2).sum() + cell["within"].sum()), int(rank)


def anova(cell: pd.DataFrame, terms: Sequence[str]) -> pd.DataFrame | None:
    """Sums of squares, degrees of freedom and F of each term given the others; None if the fit isn't possible.

    In an additive model these are the type II and type III sums: the residual without a term less the full one.
    """
    active = [t for t in terms if cell[t].nunique(dropna=False) > 1]
    total = int(cell["n"].sum())
    if not active or total <= len(active):
        return None
    rss, rank = additive_fit(cell, active)
    df_resid = total - rank
    if df_resid <= 0:
        return None
    out = [("residual", rss, df_resid, math.nan, math.nan)]
    for t in active:
        less, less_rank = additive_fit(cell, [a for a in active if a != t])
        df = rank - less_rank
        ss = max(less - rss, 0.0)
        f = (ss / df) / (rss / df_resid) if df > 0 and rss > 0 else math.nan
        out.append((t, ss, df, f, f_log_tail(f, df, df_resid) if f > 0 else math.nan))
    return pd.DataFrame(out, columns=["term", "ss", "df", "f", "log_p"])


_ANOVA = "term string, ss double, df long, f double, log_p double, n long, total_ss double"


def anova_by(df: DataFrame, strata: Sequence[str], terms: Sequence[str], score: str) -> DataFrame:
    """Per stratum the table of :func:`anova`; where it isn't possible one residual row without terms."""
    own = cells(df, strata, terms, score)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*strata).schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        mean = float((pdf["n"] * pdf["y"]).sum() / n)
        total = float((pdf["n"] * (pdf["y"] - mean) ** 2).sum() + pdf["within"].sum())
        table = anova(pdf, terms)
        if table is None:
            table = pd.DataFrame([("unfitted", total, max(n - 1, 0), math.nan, math.nan)], columns=["term", "ss", "df", "f", "log_p"])
        return table.assign(n=n, total_ss=total, **{s: pdf[s].iloc[0] for s in strata})[[*strata, "term", "ss", "df", "f", "log_p", "n", "total_ss"]]

    return own.groupBy(*strata).applyInPandas(fit, f"{kinds}, {_ANOVA}")


def fisher_combined(anovas: DataFrame, by: Sequence[str], whole: bool = False) -> DataFrame:
    """Per term the p-values of the strata combined: number k, X = -2 sum ln p, log10 of its chi-square tail."""
    good = anovas.where("log_p is not null and not isnan(log_p) and term not in ('residual', 'unfitted')")
    out = good.groupBy(*by, "term").agg(F.count("*").alias("k"), (F.sum("log_p") * -2).alias("chi2"))
    return out.withColumn("log10p", log10_tail(F.col("chi2"), F.col("k"), whole))


def log10_tail(x: Column, k: Column, whole: bool = False) -> Column:
    """log10 of the chi-square tail with 2k degrees of freedom, an expression: k terms, each from the one before.

    Below 1e-308 the leading term alone, as published figures have it; all terms there too if ``whole``.
    """
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.ln(x / 2) - F.ln(i.cast("double"))

        def merged(t: Column) -> Column:
            top = F.greatest(acc["top"], t)
            return F.struct(t.alias("term"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(t - top)).alias("sum"))

        return F.transform(F.array(term), merged)[0]

    steps = F.when(k > 1, F.sequence(F.lit(1), k.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    exact = lambda acc: (-x / 2 + acc["top"] + F.ln(acc["sum"])) / math.log(10)
    leading = lambda acc: (-x / 2 + acc["term"]) / math.log(10)
    tail = F.aggregate(steps, start, add, lambda acc: exact(acc) if whole else F.when(exact(acc) >= -308, exact(acc)).otherwise(leading(acc)))
    return F.when(x <= 0, F.lit(0.0)).otherwise(tail)


def variation(df: DataFrame, model: str, stratum: str, factors: Sequence[str], score: str, blur: str, persona_factor: str | None = None) -> DataFrame:
    """Per model: sd of stratum means, total variation, residual jitter (over residual df), entropy, and factor sds.

    Total variation leaves the persona factor out and takes residual and blur in; strata that can't be fitted put
    their whole variation into the residual.
    """
    fits = anova_by(df, [model, stratum], factors, score)
    resid = F.col("term").isin("residual", "unfitted")
    per = fits.groupBy(model).agg(
        F.sum(F.when(resid, F.col("ss"))).alias("ss_resid"),
        F.sum(F.when(resid, F.col("df"))).alias("df_resid"),
        F.sum(F.when(~resid & (F.col("term") != F.lit(persona_factor or "")), F.col("ss")).otherwise(0.0)).alias("ss_factors"),
        *[F.sum(F.when(F.col("term") == f, F.col("ss")).otherwise(0.0)).alias(f"ss_{f}") for f in factors],
    )
    means = df.groupBy(model, stratum).agg(F.avg(score).alias("m")).groupBy(model).agg(F.stddev_samp("m").alias("stratum_sd"))
    whole = df.groupBy(model).agg(F.count(score).alias("n"), F.sum(blur).alias("ss_blur")).join(means, model).join(per, model)
    n = F.col("n")
    return whole.select(
        model,
        "stratum_sd",
        F.sqrt((F.col("ss_factors") + F.col("ss_resid") + F.col("ss_blur")) / n).alias("total_variation"),
        F.sqrt(F.try_divide(F.col("ss_resid"), F.col("df_resid").cast("double"))).alias("residual_jitter"),
        F.sqrt(F.col("ss_blur") / n).alias("response_entropy"),
        *[F.sqrt(F.col(f"ss_{f}") / n).alias(f"{f}_sd") for f in factors],
    )


def blocked_variation(df: DataFrame, model: str, stratum: str, block: str, factors: Sequence[str], score: str, blur: str) -> DataFrame:
    """The same with a block term in each fit whose effect isn't reported; jitter over n, total sd with mean blur."""
    fits = anova_by(df, [model, stratum], [block, *factors], score)
    resid = F.col("term").isin("residual", "unfitted")
    per = fits.groupBy(model).agg(F.sum(F.when(resid, F.col("ss"))).alias("ss_resid"), *[F.sum(F.when(F.col("term") == f, F.col("ss")).otherwise(0.0)).alias(f"ss_{f}") for f in factors])
    adjusted = without_block(df, [model], block, score, "_a")
    means = adjusted.groupBy(model, stratum).agg(F.avg("_a").alias("m")).groupBy(model).agg(F.stddev_samp("m").alias("stratum_sd"))
    whole = adjusted.groupBy(model).agg(F.count("_a").alias("n"), F.avg(score).alias("mean_score"), F.var_pop("_a").alias("v"), F.avg(blur).alias("blur")).join(means, model).join(per, model)
    n = F.col("n")
    return whole.select(model, "mean_score", F.sqrt(F.col("v") + F.col("blur")).alias("total_sd"), "stratum_sd", F.sqrt("blur").alias("intrinsic_blur"), F.sqrt(F.col("ss_resid") / n).alias("residual_jitter"), *[F.sqrt(F.col(f"ss_{f}") / n).alias(f"{f}_sd") for f in factors])


def single_term_test(df: DataFrame, model: str, term: str, others: Sequence[str], score: str) -> DataFrame:
    """Per model the F test of one term in a single additive fit, and log10 p."""
    fits = anova_by(df, [model], [term, *others], score).where(F.col("term") == term)
    return fits.select(model, "f", "df", (F.col("log_p") / math.log(10)).alias("log10p"))


def residual_rmse(df: DataFrame, model: str, factors: Sequence[str], score: str) -> DataFrame:
    """Per model the root of residual squares over n less the rank, of an additive fit with all factors that vary."""
    own = cells(df, [model], factors, score)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rss, rank = additive_fit(pdf, [f for f in factors if pdf[f].nunique(dropna=False) > 1])
        n = int(pdf["n"].sum())
        return pd.DataFrame({model: [pdf[model].iloc[0]], "n": [n], "rank": [rank], "rmse": [math.sqrt(rss / max(n - rank, 1))]})

    return own.groupBy(model).applyInPandas(fit, f"{model} {own.schema[model].dataType.simpleString()}, n long, rank long, rmse double")


def interaction_test(df: DataFrame, by: str, factor: str, size: str, score: str) -> DataFrame:
    """Per ``by``: whether a factor's effect changes with a numeric size: full against additive least squares."""
    rows = df.select(by, F.col(factor).cast("string").alias("_f"), F.col(size).cast("double").alias("_s"), F.col(score).cast("double").alias("_y")).dropna()
    stats = rows.groupBy(by, "_f", "_s").agg(F.count("*").alias("n"), F.avg("_y").alias("y"), (F.coalesce(F.var_pop("_y"), F.lit(0.0)) * F.count("*")).alias("within"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, levels = pd.factorize(pdf["_f"], sort=True)
        s, y, n = pdf["_s"].to_numpy(float), pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)
        dummies = [(codes == k).astype(float) for k in range(1, len(levels))]
        designs = [np.stack([np.ones(len(s)), s, *dummies], 1), np.stack([np.ones(len(s)), s, *dummies, *[d * s for d in dummies]], 1)]
        found = []
        for x in designs:
            root = np.sqrt(n)
            beta, _, rank, _ = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)
            found.append((float((n * (y - x @ beta) ** 2).sum() + pdf["within"].sum()), int(rank)))
        (reduced, r0), (full, r1) = found
        d1, d2 = r1 - r0, int(n.sum()) - r1
        f = ((reduced - full) / d1) / (full / d2) if d1 > 0 and d2 > 0 and full > 0 else math.nan
        return pd.DataFrame({by: [pdf[by].iloc[0]], "f": [f], "df1": [d1], "df2": [d2], "p": [math.exp(f_log_tail(f, d1, d2)) if f > 0 else math.nan]})

    return stats.groupBy(by).applyInPandas(fit, f"{by} {df.schema[by].dataType.simpleString()}, f double, df1 long, df2 long, p double")

