"""Classification, calibration and agreement metrics as single grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.labels import confusion, decile


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rates(tp: str = "tp", tn: str = "tn", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of confusion counts; null where undefined."""
    t, u, f, g = (F.col(c) for c in (tp, tn, fp, fn))
    precision, recall = ratio(t, t + f), ratio(t, t + g)
    return {"accuracy": ratio(t + u, t + u + f + g), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def confusion_summary(df: DataFrame, groups: Sequence[str], gold: Column, p: Column, predicted: Column | None = None) -> DataFrame:
    """Per group: n, prevalence, positive rate, mean p overall and given gold, confusion counts and their rates."""
    rows = df.select(*groups, gold.alias("_g"), p.alias("_p"), (p >= 0.5 if predicted is None else predicted).alias("_y"))
    counts = {k: F.count_if(v).alias(k) for k, v in confusion(F.col("_g"), F.col("_y")).items()}
    out = rows.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg(F.col("_g").cast("double")).alias("prevalence"),
        F.avg(F.col("_y").cast("double")).alias("positive_rate"),
        F.avg("_p").alias("mean_p"),
        F.avg(F.when(F.col("_g"), F.col("_p"))).alias("mean_p_gold"),
        F.avg(F.when(~F.col("_g"), F.col("_p"))).alias("mean_p_other"),
        *[counts[k] for k in ("tp", "tn", "fp", "fn")],
    )
    return out.withColumns(rates())


def pooled_rates(summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Micro averages: confusion counts summed, then the rates."""
    sums = summary.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in ("n", "tp", "tn", "fp", "fn")])
    return sums.withColumns(rates())


def calibration(df: DataFrame, groups: Sequence[str], gold: Column, p: Column) -> DataFrame:
    """Per group and decile of p: n, mean p and observed rate."""
    rows = df.select(*groups, gold.cast("double").alias("_g"), p.alias("_p"), decile(p).alias("bin"))
    return rows.groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg("_p").alias("mean_p"), F.avg("_g").alias("observed_rate"))


def f1_zero(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 that is 0 where it is undefined."""
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def two_label_metrics(df: DataFrame, groups: Sequence[str], gold: Column, predicted: Column, confidence: Column) -> DataFrame:
    """Accuracy, macro and per-label F1 of two fixed labels (True the positive one), mean confidence, positive rates."""
    rows = df.select(*groups, gold.alias("_g"), predicted.alias("_y"), confidence.alias("_c"))
    flags = confusion(F.col("_g"), F.col("_y"))
    tp, tn, fp, fn = (F.count_if(flags[k]) for k in ("tp", "tn", "fp", "fn"))
    positive, negative = f1_zero(tp, fp, fn), f1_zero(tn, fn, fp)
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"),
        ratio(tp + tn, F.count("*")).alias("accuracy"),
        ((positive + negative) / 2).alias("macro_f1"),
        negative.alias("negative_f1"),
        positive.alias("positive_f1"),
        F.avg("_c").alias("mean_confidence"),
        F.avg(F.col("_y").cast("double")).alias("positive_pred_rate"),
        F.avg(F.col("_g").cast("double")).alias("positive_gold_rate"),
    )


def auc(df: DataFrame, groups: Sequence[str], gold: Column, p: Column) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at their mean rank; null without both classes.

    Counts per distinct score come first, so the window runs over scores, not over rows.
    """
    counts = df.select(*groups, gold.alias("_g"), p.alias("_p")).groupBy(*groups, "_p").agg(F.count("*").alias("c"), F.count_if("_g").alias("pos"))
    w = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("c").over(w), F.lit(0))
    ranked = counts.withColumn("rank_sum", F.col("pos") * (below + (F.col("c") + 1) / 2))
    out = ranked.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("c") - F.col("pos")).alias("n_neg"), F.sum("rank_sum").alias("r"))
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return out.select(*groups, "n_pos", "n_neg", F.try_divide(F.col("r") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def agreement(df: DataFrame, groups: Sequence[str], first: Column, second: Column, error: Column) -> DataFrame:
    """Rows, errors, rows with both answers, equal answers, and both rates."""
    ok = ~F.coalesce(error, F.lit(False))
    both = ok & first.isNotNull() & second.isNotNull()
    out = df.groupBy(*groups).agg(F.count("*").alias("rows"), F.count_if(~ok).alias("error_rows"), F.count_if(both).alias("comparable_rows"), F.count_if(both & (first == second)).alias("agreement_rows"))
    return out.withColumns({"comparable_rate": ratio(F.col("comparable_rows"), F.col("rows")), "conditional_agreement_rate": ratio(F.col("agreement_rows"), F.col("comparable_rows"))})


def summarize(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """count, mean, median and sd of each metric, as ``metric__stat``."""
    stats = {"count": F.count, "mean": F.avg, "median": F.median, "std": F.stddev_samp}
    return df.groupBy(*groups).agg(*[f(F.col(m)).alias(f"{m}__{name}") for m in metrics for name, f in stats.items()])


def grouping_sets(df: DataFrame, sets: dict[str, Sequence[str]], aggregates: dict[str, str]) -> DataFrame:
    """Several groupings in one pass; ``scope`` tells which, columns outside a grouping are null."""
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    df.createOrReplaceTempView(view := f"grouped_{abs(hash((tuple(df.columns), tuple(sets)))) % 10**9}")
    listed = ", ".join(f"({', '.join(cols)})" for cols in sets.values())
    # grouping_id has a bit for each column, the first the highest, set where the column is aggregated away.
    ids = {sum(0 if c in cols else 1 << (len(every) - 1 - k) for k, c in enumerate(every)): name for name, cols in sets.items()}
    scope = "CASE grouping_id() " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in ids.items()) + " END AS scope"
    chosen = ", ".join(f"{v} AS {k}" for k, v in aggregates.items())
    return df.sparkSession.sql(f"SELECT {scope}, {', '.join(every)}, {chosen} FROM {view} GROUP BY GROUPING SETS ({listed})")


def long_factor_summary(df: DataFrame, factors: Sequence[str], groups: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """The same aggregates for the levels of each factor, stacked as (factor, level)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    return df.withColumn("_f", F.explode(pairs)).select("*", "_f.*").groupBy(*groups, "factor", "level").agg(*aggregates)
