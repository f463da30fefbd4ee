"""Model-based operators on ``pyspark.ml``, with folds by group, and cluster agreement as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import laws
from quillspark.operators.numbering import group_folds
from quillspark.sources.scratch import stored


def vectors(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(F.col(array), lambda v: v.cast("double"))))


def principal_components(df: DataFrame, array: str, k: int, out: str = "pca") -> DataFrame:
    """Centred scores on the first k components; each component's largest loading is made positive."""
    rows = vectors(df, array, "_v")
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_s").fit(centre.transform(rows))
    loads = model.pc.toArray()
    signs = [float(np.sign(loads[np.abs(loads[:, j]).argmax(), j]) or 1.0) for j in range(k)]
    scores = vector_to_array(F.col("_s"))
    flipped = F.zip_with(scores, F.array(*map(F.lit, signs)), lambda a, b: a * b)
    return model.transform(centre.transform(rows)).withColumn(out, flipped).drop("_v", "_c", "_s")


def grouped_classification(df: DataFrame, array: str, label: str, group: str, folds: int = 10, components: int | None = None) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 of a class-balanced multinomial logistic regression, groups never split.

    Returns a row for each fold and one (fold null) over all held-out rows.
    """
    k = min(folds, df.select(group).distinct().count())
    rows = vectors(principal_components(df, array, components, "_x") if components else df, "_x" if components else array)
    rows = rows.join(group_folds(df, group, k), group)
    rows = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows).transform(rows).select("features", "_y", "fold")
    rows = stored(rows, "classified")
    parts = []
    for f in range(k):
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        weights = train.groupBy("_y").agg(F.count("*").alias("c"))
        n, classes = weights.agg(F.sum("c"), F.count("*")).first()
        train = train.join(F.broadcast(weights.select("_y", (F.lit(float(n)) / (classes * F.col("c"))).alias("w"))), "_y")
        scale = StandardScaler(inputCol="features", outputCol="x", withMean=True, withStd=True)
        fit = Pipeline(stages=[scale, LogisticRegression(featuresCol="x", labelCol="_y", weightCol="w", family="multinomial", regParam=1e-3, maxIter=50)]).fit(train)
        parts.append(fit.transform(test).select("fold", "_y", F.col("prediction").alias("_p")))
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    return classification_report(held, F.col("_y"), F.col("_p"), "fold")


def classification_report(df: DataFrame, truth: Column, predicted: Column, by: str) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 per value of ``by`` and, with null there, over all."""
    cells = df.select(by, truth.alias("t"), predicted.alias("p")).groupBy(by, "t", "p").agg(F.count("*").alias("n"))
    both = cells.unionByName(cells.groupBy("t", "p").agg(F.sum("n").alias("n")).withColumn(by, F.lit(None).cast(df.schema[by].dataType)))
    sides = both.select(by, F.inline(F.array(F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("gold"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("gold"), F.col("n").alias("said")))))
    per = sides.groupBy(by, "c").agg(F.sum("tp").alias("tp"), F.sum("gold").alias("gold"), F.sum("said").alias("said"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("gold") + F.col("said")).cast("double")), F.lit(0.0))
    return per.groupBy(by).agg(F.sum("gold").alias("n"), (F.sum("tp") / F.sum("gold")).alias("accuracy"), F.avg(F.try_divide(F.col("tp").cast("double"), F.col("gold").cast("double"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def contingency(df: DataFrame, a: str, b: str, noise: int | None = None) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return (rows if noise is None else rows.where(F.col(a) != noise)).groupBy(a, b).agg(F.count("*").alias("n"))


def mutual_information(table: DataFrame, a: str, b: str) -> DataFrame:
    """n, mutual information, both entropies and the normalised information (arithmetic mean) of a contingency table.

    Margins are windows over one class; the total is a row of its own that every cell is given.
    """
    total = table.agg(F.sum("n").alias("_t"))
    p = table.withColumns({"_a": F.sum("n").over(Window.partitionBy(a)), "_b": F.sum("n").over(Window.partitionBy(b))}).join(F.broadcast(total))
    mi = F.sum(F.col("n") / F.col("_t") * F.ln(F.col("n") / F.col("_a") * F.col("_t") / F.col("_b")))
    ha = F.sum(-F.col("n") / F.col("_t") * F.ln(F.col("_a") / F.col("_t")))
    hb = F.sum(-F.col("n") / F.col("_t") * F.ln(F.col("_b") / F.col("_t")))
    out = p.agg(F.sum("n").alias("n"), mi.alias("mi"), ha.alias("entropy_a"), hb.alias("entropy_b"))
    return out.withColumn("nmi", F.coalesce(F.try_divide(2 * F.col("mi"), F.col("entropy_a") + F.col("entropy_b")), F.lit(1.0)))


def adjusted_information(table: DataFrame, a: str, b: str) -> DataFrame:
    """n, mutual information, its expectation under the margins, and the information adjusted by it (arithmetic mean).

    Classes of one size have the same expectation, so sizes are paired, not classes: at most sqrt(2 n) sizes a side, and
    a fold for each pair.
    """
    sizes = [table.groupBy(c).agg(F.sum("n").alias(f"size_{k}")).groupBy(f"size_{k}").agg(F.count("*").alias(f"classes_{k}")) for c, k in ((a, "a"), (b, "b"))]
    own = mutual_information(table, a, b)
    paired = sizes[0].join(sizes[1]).join(F.broadcast(table.agg(F.sum("n").alias("_t"))))
    share = F.col("classes_a") * F.col("classes_b") * laws.expected_cell_information(F.col("size_a"), F.col("size_b"), F.col("_t"))
    expected = paired.agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("expected_mi"))
    down = (F.col("entropy_a") + F.col("entropy_b")) / 2 - F.col("expected_mi")
    ami = F.when(F.abs(down) < 1e-15, F.lit(1.0)).otherwise((F.col("mi") - F.col("expected_mi")) / down)
    return own.join(F.broadcast(expected)).where("n is not null").select("n", "mi", "expected_mi", ami.alias("ami"))


