"""Queries on answer distributions: array expressions, coordinates, alignment, quadrants, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import arrays
from quillspark.operators import scoring
from quillspark.plans.bindings import ANSWERS, SCORER, answers, item_answers, rounded, scorer, sql_rounded, table
from quillspark.plans.registry import query


def _q(select: str, doubles: str, more: str = "", digits: int = 6) -> str:
    return sql_rounded(f"WITH {ANSWERS}{more} {select}", doubles, digits)


@query("x19_softmax", _q("SELECT vec_id, item::INT AS item, p[1] AS p0, p[4] AS p3 FROM ans", "p0 p3"))
def x19(spark, d):
    return rounded(item_answers(spark, d).select("vec_id", "item", F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(3)).alias("p3")))


@query("x19_softmax_map", sql_rounded("WITH e AS (SELECT event_type, map_from_entries(list((user_id % 3, value) ORDER BY event_id)) AS m FROM (SELECT event_type, user_id, value, event_id, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS r FROM events) WHERE r = 1 GROUP BY 1) SELECT event_type, exp(m[0] - list_max(map_values(m))) / list_sum(list_transform(map_values(m), lambda v: exp(v - list_max(map_values(m))))) AS p FROM e", "p"))
def x19_map(spark, d):
    from quillspark.operators.compaction import first_wins

    e = table(spark, d, "events").withColumn("key", (F.col("user_id") % 3).cast("string"))
    m = first_wins(e, ["event_type", "key"], ["event_id"]).groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return rounded(m.select("event_type", F.try_element_at(arrays.softmax_map(F.col("m")), F.lit("0")).alias("p")))


@query("x20_entropy_margin", _q("SELECT vec_id, item::INT AS item, -list_sum(list_transform(p, lambda v: v * ln(v))) AS entropy, list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] AS margin FROM ans", "entropy margin"))
def x20(spark, d):
    return rounded(item_answers(spark, d).select("vec_id", "item", arrays.entropy(F.col("p")).alias("entropy"), arrays.margin(F.col("p")).alias("margin")))


_CANON = "(CASE WHEN perm IN (2, 3) THEN list_reverse(p) ELSE p END)"


@query("x23_canonical_order", _q(f"SELECT vec_id, item::INT AS item, {_CANON}[1] / list_sum(p) AS c0, {_CANON}[4] / list_sum(p) AS c3 FROM ans", "c0 c3"))
def x23(spark, d):
    c = arrays.canonical(F.col("p"), F.col("perm"))
    return rounded(item_answers(spark, d).withColumn("c", c).select("vec_id", "item", F.get("c", F.lit(0)).alias("c0"), F.get("c", F.lit(3)).alias("c3")))


@query("x24_variation_distance", _q("SELECT a.vec_id, a.item::INT AS item, 0.5 * list_sum(list_transform(range(1, 5), lambda k: abs(a.p[k] - b.p[k]))) AS distance FROM ans a JOIN ans b ON a.vec_id = b.vec_id AND b.item = (a.item + 1) % 16", "distance"))
def x24(spark, d):
    rows = answers(spark, d)
    next_ = F.concat(F.slice("probs", 2, 15), F.slice("probs", 1, 1))
    pairs = rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("probs").alias("a"), next_.alias("b"))).alias("item", "z"))
    return rounded(pairs.select("vec_id", "item", arrays.variation_distance(F.col("z.a"), F.col("z.b")).alias("distance")))


@query("x25_argmax_and_expectation", _q("SELECT vec_id, item::INT AS item, list_position(p, list_max(p))::INT - 1 AS best, p[2] + 2 * p[3] + 3 * p[4] AS expected, list_position(p, list_max(p)) - 1 >= 2 AS agrees FROM ans", "expected"))
def x25(spark, d):
    best = arrays.first_argmax(F.col("p"))
    return rounded(item_answers(spark, d).select("vec_id", "item", best.alias("best"), arrays.expected_place(F.col("p")).alias("expected"), (best >= 2).alias("agrees")))


@query("x26_dispersion_and_variance", _q("SELECT vec_id, ans.item::INT AS item, list_sum(list_transform(p, lambda v: v * (1 - v))) AS dispersion, greatest(0, list_sum(list_transform(range(1, 5), lambda k: p[k] * economic[k] * economic[k])) - list_sum(list_transform(range(1, 5), lambda k: p[k] * economic[k])) ** 2) AS variance FROM ans JOIN scorer ON ans.item = scorer.item", "dispersion variance", f", {SCORER}"))
def x26(spark, d):
    rows = item_answers(spark, d).join(F.broadcast(scorer(spark)), "item")
    return rounded(rows.select("vec_id", "item", arrays.dispersion(F.col("p")).alias("dispersion"), arrays.weight_variance(F.col("p"), F.col("economic")).alias("variance")))


@query("x27_candidate_distribution", sql_rounded("SELECT o_orderkey, (1 + o_orderkey % 3) / (1 + o_orderkey % 3 + 1 + o_custkey % 4)::DOUBLE AS agree FROM orders", "agree"))
def x27(spark, d):
    o = table(spark, d, "orders")
    p = F.create_map(F.lit("A"), (1 + F.col("o_orderkey") % 3).cast("double"), F.lit("B"), (1 + F.col("o_custkey") % 4).cast("double"))
    texts = F.array(F.lit("AGREE "), F.lit("disagree"))
    out = arrays.candidate_distribution(F.array(F.lit("A"), F.lit("B")), texts, p, F.array(F.lit("agree"), F.lit("Disagree")))
    return rounded(o.select("o_orderkey", F.get(out, F.lit(0)).alias("agree")))


@query("x28_present_counts", _q("SELECT vec_id, item::INT AS item, len(list_filter(p, lambda v: v > 0.2)) AS present, list_sum(p) AS total FROM ans", "total"))
def x28(spark, d):
    return rounded(item_answers(spark, d).select("vec_id", "item", F.size(F.filter("p", lambda v: v > 0.2)).cast("long").alias("present"), arrays.total(F.col("p")).alias("total")))


@query("a27_row_mean", sql_rounded("SELECT l_orderkey, l_linenumber, (l_discount + l_tax) / 2 AS m FROM lineitem", "m"))
def a27(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", arrays.nan_mean(F.col("l_discount"), F.lit(None).cast("double"), F.col("l_tax"), F.lit(float("nan"))).alias("m")))


_EXP = "list_sum(list_transform(range(1, 5), lambda k: {p}[k] * {w}[k]))"
_COORD = f", {SCORER}, co AS (SELECT vec_id, label, sum({_EXP.format(p=_CANON, w='economic')}) + 0.5 AS score_economic, sum({_EXP.format(p=_CANON, w='social')}) - 0.25 AS score_social FROM ans JOIN scorer ON ans.item = scorer.item GROUP BY vec_id, label)"


def _coordinates(spark, d):
    rows = item_answers(spark, d)
    return scoring.coordinates(rows, ["vec_id", "label"], "item", arrays.canonical(F.col("p"), F.col("perm")), F.broadcast(scorer(spark)), ["economic", "social"], {"economic": 0.5, "social": -0.25})


@query("a09_coordinates", _q("SELECT * FROM co", "score_economic score_social", _COORD))
def a09(spark, d):
    return rounded(_coordinates(spark, d).select("vec_id", "label", "score_economic", "score_social"))


@query("p15_distance_from_origin", _q("SELECT vec_id, sqrt(score_economic ** 2 + score_social ** 2) AS distance FROM co", "distance", _COORD))
def p15(spark, d):
    return rounded(_coordinates(spark, d).select("vec_id", scoring.distance(F.col("score_economic"), F.col("score_social")).alias("distance")))


@query("p17_quadrants", _q("SELECT vec_id, score_economic * (CASE WHEN label % 4 IN (0, 2) THEN -1 ELSE 1 END) > 0 AND score_social * (CASE WHEN label % 4 IN (0, 1) THEN -1 ELSE 1 END) > 0 AS in_quadrant FROM co", "", _COORD).replace("SELECT * REPLACE () FROM", "SELECT * FROM"))
def p17(spark, d):
    sign_x = F.when((F.col("label") % 4).isin(0, 2), -1).otherwise(1)
    sign_y = F.when((F.col("label") % 4).isin(0, 1), -1).otherwise(1)
    return _coordinates(spark, d).select("vec_id", scoring.in_quadrant(F.col("score_economic"), F.col("score_social"), sign_x, sign_y).alias("in_quadrant"))


@query("p18_tolerant_signs", _q("SELECT vec_id, CASE WHEN label % 3 = 0 THEN abs(score_economic) <= 0.35 ELSE score_economic * (label % 3 * 2 - 3) > 0 END AS matches FROM co", "", _COORD).replace("SELECT * REPLACE () FROM", "SELECT * FROM"))
def p18(spark, d):
    from quillspark.functions.labels import sign_match

    target = F.when(F.col("label") % 3 == 0, 0).otherwise(F.col("label") % 3 * 2 - 3)
    return _coordinates(spark, d).select("vec_id", sign_match(F.col("score_economic"), target).alias("matches"))


@query("a10_centroids", _q("SELECT label, avg(score_economic) AS x, avg(score_social) AS y, count(*) AS n FROM co GROUP BY label", "x y", _COORD))
def a10(spark, d):
    return rounded(_coordinates(spark, d).groupBy("label").agg(F.avg("score_economic").alias("x"), F.avg("score_social").alias("y"), F.count("*").alias("n")))


@query("k10_centroid_shift", _q("SELECT c.label, sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2) AS shift FROM (SELECT label, avg(score_economic) x, avg(score_social) y FROM co GROUP BY label) c, (SELECT avg(score_economic) x, avg(score_social) y FROM co WHERE label = 0) b WHERE c.label <> 0", "shift", _COORD))
def k10(spark, d):
    rows = _coordinates(spark, d).withColumns({"all": F.lit(1), "level": F.col("label").cast("string")})
    return rounded(scoring.centroid_shifts(rows, ["all"], "level", "0", "score_economic", "score_social").select(F.col("level").cast("int").alias("label"), "shift"))


@query("st29_towards_base", _q("SELECT vec_id, sqrt((score_economic - x) ** 2 + (score_social - y) ** 2) AS to_base, sqrt((score_economic - x) ** 2 + (score_social - y) ** 2) < sqrt(x ** 2 + y ** 2) AS nearer_than_origin FROM co, (SELECT avg(score_economic) x, avg(score_social) y FROM co WHERE label = 0) b", "to_base", _COORD))
def st29(spark, d):
    rows = _coordinates(spark, d)
    base = rows.where("label = 0").agg(F.avg("score_economic").alias("x"), F.avg("score_social").alias("y"))
    both = rows.join(F.broadcast(base))
    to_base = scoring.distance(F.col("score_economic"), F.col("score_social"), F.col("x"), F.col("y"))
    return rounded(both.select("vec_id", to_base.alias("to_base"), (to_base < F.hypot("x", "y")).alias("nearer_than_origin")))


@query("k01_question_axes", sql_rounded(f"WITH {SCORER}, r AS (SELECT item, list_max(economic) - list_min(economic) AS e, list_max(social) - list_min(social) AS s, economic, social FROM scorer) SELECT item, CASE WHEN e > 1e-9 THEN 'economic' WHEN s > 1e-9 THEN 'social' ELSE 'unweighted' END AS axis, CASE WHEN e > 1e-9 THEN e WHEN s > 1e-9 THEN s ELSE 0 END AS weight_range, CASE WHEN e > 1e-9 THEN sign(economic[4] - economic[1]) WHEN s > 1e-9 THEN sign(social[4] - social[1]) ELSE 0 END::INT AS direction FROM r", "weight_range"))
def k01(spark, d):
    return rounded(scoring.question_axes(scorer(spark), ["economic", "social"]).select("item", "axis", "weight_range", "direction"))


_AXIS = "(CASE WHEN list_max(economic) - list_min(economic) > 1e-9 THEN economic ELSE social END)"
_CENTRED = f"list_transform(range(1, 5), lambda k: {_AXIS}[k] - list_avg({_AXIS}))"


@query("k02_item_alignment", _q(f"SELECT vec_id, ans.item::INT AS item, coalesce(({_CENTRED})[list_position(p, list_max(p))] > 0, false) AS target_aligned, list_sum(list_transform(range(1, 5), lambda k: p[k] * ({_CENTRED})[k])) AS target_projection FROM ans JOIN scorer ON ans.item = scorer.item", "target_projection", f", {SCORER}"))
def k02(spark, d):
    axes = scoring.question_axes(scorer(spark), ["economic", "social"]).select("item", "axis")
    rows = item_answers(spark, d).join(F.broadcast(scorer(spark).join(axes, "item")), "item")  # 16 items
    weights = F.when(F.col("axis") == "economic", F.col("economic")).otherwise(F.col("social"))
    return rounded(rows.select("vec_id", "item", *[v.alias(k) for k, v in scoring.aligned(F.col("p"), weights, F.lit(1)).items()]))


@query("k03_scores_from_wide", _q("SELECT label, avg(score_economic) AS economic, avg(score_social) AS social FROM co GROUP BY label", "economic social", _COORD))
def k03(spark, d):
    return rounded(_coordinates(spark, d).groupBy("label").agg(F.avg("score_economic").alias("economic"), F.avg("score_social").alias("social")))


@query("r02_wide_to_long", _q(f"SELECT vec_id, item::INT AS item, k::INT - 1 AS answer, {_CANON}[k] AS prob FROM ans, range(1, 5) t(k)", "prob"))
def r02(spark, d):
    c = arrays.canonical(F.col("p"), F.col("perm"))
    return rounded(item_answers(spark, d).select("vec_id", "item", F.posexplode(c).alias("answer", "prob")))


@query("r01_columns_to_rows", "SELECT c_custkey, t.i::INT AS item, CASE i WHEN 0 THEN c_acctbal ELSE c_nationkey END::DOUBLE AS v FROM customer, range(2) t(i)")
def r01(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("q0_v"), F.col("c_nationkey").cast("double").alias("q1_v"))
    return scoring.unstacked(c, ["c_custkey"], "q", ["v"], 2)


@query("r03_long_to_wide", _q("SELECT vec_id, list_sum(list_transform(list(p ORDER BY item), lambda q: q[1])) AS first_total, count(*) AS items FROM ans GROUP BY vec_id", "first_total"))
def r03(spark, d):
    wide = scoring.wide_items(item_answers(spark, d), ["vec_id"], "item", "p")
    return rounded(wide.select("vec_id", F.aggregate("probs", F.lit(0.0), lambda s, p: s + F.get(p, F.lit(0))).alias("first_total"), F.size("probs").cast("long").alias("items")))


@query("r08_replicate", "SELECT r_regionkey, i::INT AS copy FROM region, range(3) t(i)")
def r08(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))


@query("r10_one_hot", "SELECT label, count(*) FILTER (WHERE label % 4 = 0) AS a0, count(*) FILTER (WHERE label % 4 = 3) AS a3 FROM embeddings GROUP BY label")
def r10(spark, d):
    hot = table(spark, d, "embeddings").select("label", arrays.one_hot(F.col("label") % 4, 4).alias("h"))
    return hot.groupBy("label").agg(F.sum(F.get("h", F.lit(0))).alias("a0"), F.sum(F.get("h", F.lit(3))).alias("a3"))


@query("r09_pairwise_upper_triangle", _q("SELECT a.label AS a, b.label AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM (SELECT label, avg(score_economic) x, avg(score_social) y FROM co GROUP BY label) a, (SELECT label, avg(score_economic) x, avg(score_social) y FROM co GROUP BY label) b WHERE a.label < b.label", "distance", _COORD))
def r09(spark, d):
    c = _coordinates(spark, d).groupBy("label").agg(F.avg("score_economic").alias("x"), F.avg("score_social").alias("y"))
    a, b = (c.select(*[F.col(n).alias(f"{n}_{s}") for n in c.columns]) for s in "ab")
    # Labels are a small closed set: the pairs of centroids, not of rows.
    pairs = a.join(b, F.col("label_a") < F.col("label_b"))
    return rounded(pairs.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"), scoring.distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")).alias("distance")))


@query("a29_centroid_ellipse", _q("SELECT label, count(*) AS n, avg(score_economic) AS mean_x, avg(score_social) AS mean_y, sqrt(greatest(0, var_samp(score_economic) * var_samp(score_social) - covar_samp(score_economic, score_social) ** 2)) AS area, CASE WHEN count(*) >= 3 THEN 2 * sqrt(greatest(0, (var_samp(score_economic) + var_samp(score_social)) / 2 + sqrt(((var_samp(score_economic) - var_samp(score_social)) / 2) ** 2 + covar_samp(score_economic, score_social) ** 2))) END AS width FROM co GROUP BY label", "mean_x mean_y area width", _COORD, 5))
def a29(spark, d):
    from quillspark.operators.stats import centroid_ellipse

    return rounded(centroid_ellipse(_coordinates(spark, d), ["label"], "score_economic", "score_social").select("label", "n", "mean_x", "mean_y", "area", "width"), 5)


@query("a30_dispersion_ratio", _q("SELECT label, sqrt(greatest(0, var_samp(score_economic) FILTER (WHERE vec_id % 2 = 0) * var_samp(score_social) FILTER (WHERE vec_id % 2 = 0) - (covar_samp(score_economic, score_social) FILTER (WHERE vec_id % 2 = 0)) ** 2)) / sqrt(greatest(0, var_samp(score_economic) FILTER (WHERE vec_id % 2 = 1) * var_samp(score_social) FILTER (WHERE vec_id % 2 = 1) - (covar_samp(score_economic, score_social) FILTER (WHERE vec_id % 2 = 1)) ** 2)) AS ratio FROM co GROUP BY label", "ratio", _COORD, 4))
def a30(spark, d):
    from quillspark.operators.stats import centroid_ellipse

    e = centroid_ellipse(_coordinates(spark, d).withColumn("side", F.col("vec_id") % 2), ["label", "side"], "score_economic", "score_social")
    wide = e.groupBy("label").agg(F.max(F.when(F.col("side") == 0, F.col("area"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("area"))).alias("b"))
    return rounded(wide.select("label", F.try_divide("a", "b").alias("ratio")), 4)


@query("st23_fisher_ratio", _q("SELECT sum((mx - gx) ** 2 + (my - gy) ** 2) AS \"between\", sum((score_economic - mx) ** 2 + (score_social - my) ** 2) AS within, sum((mx - gx) ** 2 + (my - gy) ** 2) / sum((score_economic - mx) ** 2 + (score_social - my) ** 2) AS ratio FROM (SELECT *, avg(score_economic) OVER (PARTITION BY label) mx, avg(score_social) OVER (PARTITION BY label) my, avg(score_economic) OVER () gx, avg(score_social) OVER () gy FROM co)", "\"between\" within ratio", _COORD, 4))
def st23(spark, d):
    from quillspark.operators.stats import fisher_ratio

    rows = _coordinates(spark, d).withColumn("every", F.lit(1))
    return rounded(fisher_ratio(rows, ["every"], "label", "score_economic", "score_social").drop("every"), 4)
