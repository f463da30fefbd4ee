"""Statistical operators: expressions and windows where SQL can say it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import laws


def benjamini_hochberg(df: DataFrame, groups: Sequence[str], p: str, out: str = "q_value") -> DataFrame:
    """Adjusted p-values within groups: p n / rank, the running minimum from the largest p, at most 1; nulls stay null."""
    has = F.col(p).isNotNull() & ~F.isnan(F.col(p))
    part = Window.partitionBy(*groups, has)
    rank = F.row_number().over(part.orderBy(p))
    raw = df.withColumns({"_n": F.count("*").over(part), "_r": rank}).withColumn("_raw", F.when(has, F.col(p) * F.col("_n") / F.col("_r")))
    least = F.min("_raw").over(part.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(out, F.when(has, F.least(least, F.lit(1.0)))).drop("_n", "_r", "_raw")


def empirical_logit(success: Column, n: Column) -> Column:
    return F.ln((success + 0.5) / (n - success + 0.5))


def log_odds(target: Column, target_n: Column, other: Column, other_n: Column, alpha: float = 0.5) -> Column:
    """Smoothed log odds ratio; absences are at least 0."""
    zero = F.lit(0)
    return F.ln((target + alpha) / (F.greatest(zero, target_n - target) + alpha)) - F.ln((other + alpha) / (F.greatest(zero, other_n - other) + alpha))


def differential_functioning(df: DataFrame, group: Sequence[str], question: str, success: str, n: str) -> DataFrame:
    """Cell logit less group's and question's logit, plus the grand one; counts are summed at each level."""
    cell = df.groupBy(*group, question).agg(F.sum(success).alias("s"), F.sum(n).alias("n"))
    by_group = cell.groupBy(*group).agg(empirical_logit(F.sum("s"), F.sum("n")).alias("group_logit"))
    by_question = cell.groupBy(question).agg(empirical_logit(F.sum("s"), F.sum("n")).alias("question_logit"))
    grand = cell.agg(empirical_logit(F.sum("s"), F.sum("n")).alias("grand_logit"))
    out = cell.withColumn("cell_logit", empirical_logit(F.col("s"), F.col("n"))).join(by_group, list(group)).join(by_question, question).join(F.broadcast(grand))
    dif = F.col("cell_logit") - F.col("group_logit") - F.col("question_logit") + F.col("grand_logit")
    return out.withColumns({"dif_logit": dif, "dif_abs": F.abs(dif)})


def mean_ranks(df: DataFrame, groups: Sequence[str], column: str, out: str) -> DataFrame:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*groups)
    ties = F.count("*").over(Window.partitionBy(*groups, column))
    return df.withColumn(out, F.rank().over(w.orderBy(column)) + (ties - 1) / 2)


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, least_pairs: int = 10) -> DataFrame:
    """Rank correlation per group with ``least_pairs`` pairs and two values on each side; n and rho."""
    rows = df.select(*groups, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = mean_ranks(mean_ranks(rows, groups, x, "_rx"), groups, y, "_ry")
    out = ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct(x).alias("nx"), F.countDistinct(y).alias("ny"), F.corr("_rx", "_ry").alias("rho"))
    return out.where((F.col("n") >= least_pairs) & (F.col("nx") >= 2) & (F.col("ny") >= 2)).select(*groups, "n", "rho")


def spearman_p(df: DataFrame, groups: Sequence[str], x: str, y: str, least_pairs: int = 10) -> DataFrame:
    """:func:`spearman` with the two-sided p of the t approximation."""
    free = (F.col("n") - 2).cast("double")
    t = F.col("rho") * F.sqrt(F.try_divide(free, 1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(laws.t_two_sided(t, free))
    return spearman(df, groups, x, y, least_pairs).withColumn("p_value", p)


def wasserstein(df: DataFrame, groups: Sequence[str], side: Column, left: str, right: str, value: str) -> DataFrame:
    """First Wasserstein distance between two sides' values: the area between their distribution functions.

    Counts per distinct value first, so windows run over values.
    """
    rows = df.select(*groups, side.alias("_s"), F.col(value).cast("double").alias("_v")).where(F.col("_s").isin(left, right) & F.col("_v").isNotNull())
    counts = rows.groupBy(*groups, "_v").agg(F.count_if(F.col("_s") == left).alias("a"), F.count_if(F.col("_s") == right).alias("b"))
    part = Window.partitionBy(*groups)
    upto = part.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    share = [F.try_divide(F.sum(c).over(upto).cast("double"), F.sum(c).over(part).cast("double")) for c in "ab"]
    area = counts.withColumn("area", F.abs(share[0] - share[1]) * (F.lead("_v").over(part.orderBy("_v")) - F.col("_v")))
    return area.groupBy(*groups).agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("distance"))


def linear_trend(df: DataFrame, groups: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    out = df.groupBy(*groups).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))
    return out.where(F.col("n") >= least)


def fisher_ratio(df: DataFrame, groups: Sequence[str], label: str, x: str, y: str) -> DataFrame:
    """Between-label over within-label sums of squares in two dimensions."""
    part, own = Window.partitionBy(*groups), Window.partitionBy(*groups, label)
    d2 = lambda a, b: F.pow(a, F.lit(2.0)) + F.pow(b, F.lit(2.0))
    rows = df.select(*groups, label, x, y).withColumns({"mx": F.avg(x).over(own), "my": F.avg(y).over(own), "gx": F.avg(x).over(part), "gy": F.avg(y).over(part)})
    rows = rows.withColumns({"between": d2(F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")), "within": d2(F.col(x) - F.col("mx"), F.col(y) - F.col("my"))})
    return rows.groupBy(*groups).agg(F.sum("between").alias("between"), F.sum("within").alias("within"), F.try_divide(F.sum("between"), F.sum("within")).alias("ratio"))


def centroid_ellipse(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Mean point, covariance, area sqrt(max(0, det)), and the ellipse of 2 sqrt(eigenvalue), for groups of 3 or more."""
    out = df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"))
    half, diff = (F.col("vx") + F.col("vy")) / 2, (F.col("vx") - F.col("vy")) / 2
    root = F.sqrt(diff * diff + F.col("cxy") * F.col("cxy"))
    big = F.col("n") >= 3
    return out.withColumns({
        "area": F.sqrt(F.greatest(F.lit(0.0), F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy"))),
        "width": F.when(big, 2 * F.sqrt(F.greatest(F.lit(0.0), half + root))),
        "height": F.when(big, 2 * F.sqrt(F.greatest(F.lit(0.0), half - root))),
        "angle": F.when(big, F.degrees(F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy")) / 2)),
    })


def cohen_dz(df: DataFrame, groups: Sequence[str], difference: Column) -> DataFrame:
    return df.select(*groups, difference.alias("_d")).groupBy(*groups).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("sd"), F.try_divide(F.avg("_d"), F.stddev_samp("_d")).alias("dz"))


def errors(df: DataFrame, groups: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """n, RMSE, MAE and R squared of the rows that have both sides: one pass of partial aggregates."""
    df = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    e2 = F.pow(F.col(truth) - F.col(predicted), F.lit(2.0))
    whole = F.var_pop(truth) * F.count(truth)
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.sqrt(F.avg(e2)).alias("rmse"), F.avg(F.abs(F.col(truth) - F.col(predicted))).alias("mae"), (1 - F.try_divide(F.sum(e2), whole)).alias("r2"))


def cluster_contrast(df: DataFrame, groups: Sequence[str], cluster: Sequence[str], difference: Column) -> DataFrame:
    """Mean of cluster means with its 1.96 se interval, and the p of a t test against 0 (one row of df per cluster first)."""
    means = df.select(*groups, *cluster, difference.alias("_d")).where("_d is not null").groupBy(*groups, *cluster).agg(F.avg("_d").alias("m"))
    out = means.groupBy(*groups).agg(F.count("*").alias("clusters"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    se = F.col("sd") / F.sqrt("clusters")
    p = F.when(se > 0, laws.t_two_sided(F.try_divide(F.col("mean"), se), (F.col("clusters") - 1).cast("double"))).otherwise(F.lit(float("nan")))
    return out.withColumns({"ci_low": F.col("mean") - 1.96 * se, "ci_high": F.col("mean") + 1.96 * se, "p_value": p})


def exact_test(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Odds ratio and one-sided p of each row's 2x2 table [[a, b], [c, d]]."""
    return df.withColumn("_t", laws.fisher_exact_greater(*map(F.col, (a, b, c, d)))).select("*", "_t.*").drop("_t")
