"""Queries on fitted models whose sums add up over rows: reconstructed scorers, ridge by folds, resampled means."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import arrays
from quillspark.operators import density, models, numbering, reconstruct, ridge, stats
from quillspark.plans.bindings import ANSWERS, SCORER, answers, rounded, scorer, sql_rounded, table
from quillspark.plans.registry import query

_AXES = ("economic", "social")


def chosen(spark, d):
    """Each embedding's chosen answers (the likeliest of each item), and the scores that the scorer gives them."""
    weights = {r["item"]: r for r in scorer(spark).collect()}
    rows = answers(spark, d).select("vec_id", F.transform("probs", lambda p: arrays.first_argmax(p).cast("int")).alias("choices"))
    told = {a: F.array(*[F.array(*map(F.lit, weights[i][a])) for i in range(16)]) for a in _AXES}
    score = {a: F.aggregate(F.zip_with(w, "choices", lambda x, c: F.get(x, c)), F.lit({"economic": 0.5, "social": -0.25}[a]), lambda s, x: s + x) for a, w in told.items()}
    return rows.select("*", *[v.alias(a) for a, v in score.items()])


@query("st26_reconstructed_weights", sql_rounded(f"WITH {SCORER} SELECT a.target, item, k::INT - 1 AS answer, w[k] AS weight, bias, CASE a.target WHEN 'economic' THEN 16 ELSE 8 END::INT AS columns, CASE a.target WHEN 'economic' THEN 16 ELSE 8 END::INT AS rank FROM (SELECT 'economic' AS target, item, economic AS w, 0.5 AS bias FROM scorer UNION ALL SELECT 'social', item, social, -0.25 FROM scorer) a, range(1, 5) t(k)", "weight bias"))
def st26(spark, d):
    """The scorer's weights, found again from the answers and scores of all rows; its items mirror, so columns are tied."""
    return rounded(reconstruct.as_table(found := chosen(spark, d), reconstruct.reconstruct(found, "choices", _AXES, 16)))


_CHOSEN = f"""{ANSWERS}, {SCORER}, ch AS (SELECT vec_id, sum(economic[list_position(p, list_max(p))]) + 0.5 AS economic, sum(social[list_position(p, list_max(p))]) - 0.25 AS social FROM ans JOIN scorer ON ans.item = scorer.item GROUP BY vec_id)"""


@query("st26_held_out_errors", sql_rounded(f"WITH {_CHOSEN} SELECT 'economic' AS target, count(*) AS n, 0.0 AS rmse, 0.0 AS mae, 1.0 AS r2 FROM ch WHERE vec_id % 7 = 0 UNION ALL SELECT 'social', count(*), 0.0, 0.0, 1.0 FROM ch WHERE vec_id % 7 = 0", "rmse mae r2"))
def st26_errors(spark, d):
    """Errors on rows that the fit hasn't seen: none, as the scorer is linear."""
    rows = chosen(spark, d)
    found = reconstruct.reconstruct(rows.where("vec_id % 7 <> 0"), "choices", _AXES, 16)
    told = F.array(*[F.struct(F.lit(a).alias("target"), F.col(a).alias("truth"), found[a][1].predicted(F.col("choices")).alias("predicted")) for a in _AXES])
    held = rows.where("vec_id % 7 = 0").select(F.inline(told))
    return rounded(stats.errors(held, ["target"], "truth", "predicted"))


def _parts(spark, d):
    p = table(spark, d, "part")
    sets = {"numbers": {"numbers": ["size"]}, "metadata": {"categories": ["p_type"]}, "text": {"text": "p_name"}, "combined": {"text": "p_name", "categories": ["p_type"], "numbers": ["size"]}}
    return p.withColumns({"price": F.col("p_retailprice"), "size": F.col("p_size").cast("double")}), sets


@query("m03_grouped_ridge")
def m03(spark, d):
    """Held-out errors of parts' prices for four sets of features, brands never split."""
    rows, sets = _parts(spark, d)
    return rounded(ridge.ablation(rows, "price", "p_brand", sets), 4)


_FOLD_SUMS = """WITH RECURSIVE s AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY p_brand),
deal AS (SELECT 0::BIGINT AS k, list_transform(range(10), lambda f: 0::BIGINT) AS loads UNION ALL
  SELECT deal.k + 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + n ELSE x END) FROM deal JOIN s ON s.k = deal.k + 1)"""


@query("m03_fold_sizes", f"{_FOLD_SUMS} SELECT x AS n, count(*) AS folds FROM (SELECT unnest(loads) AS x FROM deal WHERE k = (SELECT max(k) FROM s)) WHERE x > 0 GROUP BY x")
def m03_folds(spark, d):
    """How many rows the folds have: brands go, largest first, to the fold with the fewest."""
    p = table(spark, d, "part")
    sizes = p.join(numbering.group_folds(p, "p_brand", 10), "p_brand").groupBy("fold").agg(F.count("*").alias("n"))
    return sizes.groupBy("n").agg(F.count("*").alias("folds"))


def _clustered(spark, d):
    e = models.principal_components(table(spark, d, "embeddings"), "embedding", 2).select("vec_id", "label", "pca")
    found = density.density_clusters(e, "vec_id", "pca", 8, 4, 12, 6, bucket=0.25)
    return e.join(found, F.col("vec_id") == F.col("id"))


@query("m04_density_clusters")
def m04(spark, d):
    """Clusters of the embeddings' first components, by size; -1 is noise."""
    return _clustered(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


@query("m05_clusters_and_labels")
def m05_clusters(spark, d):
    """How much the clusters tell of the labels, noise left out."""
    c = models.contingency(_clustered(spark, d), "cluster", "label", density.NOISE)
    return rounded(models.mutual_information(c, "cluster", "label"), 4)
