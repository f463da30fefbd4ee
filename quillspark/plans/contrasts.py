"""Queries on matched pairs, contrasts, sensitivity and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.labels import outcome
from quillspark.operators import pairs, resampling, sensitivity, stats
from quillspark.plans.bindings import FACTORS, ORDER_SIDES, PREDICTIONS, SCORES, STANCES, order_sides, predictions, rounded, scores, sql_rounded, stances, table
from quillspark.plans.registry import query

KEYS = ["o_custkey", "o_orderpriority"]
_PAIRS = f"{ORDER_SIDES}, pr AS (SELECT l.o_custkey, l.o_orderpriority, l.price AS price_left, r.price AS price_right, l.large AS large_left, r.large AS large_right FROM os l JOIN os r ON l.o_custkey = r.o_custkey AND l.o_orderpriority = r.o_orderpriority WHERE l.o_orderstatus = 'F' AND r.o_orderstatus = 'O')"


def _pairs(spark, d):
    return pairs.matched(order_sides(spark, d), KEYS, F.col("o_orderstatus"), "F", "O", ["price", "large"])


@query("j01_matched_pairs", sql_rounded(f"WITH {_PAIRS} SELECT * FROM pr", "price_left price_right"))
def j01(spark, d):
    return rounded(_pairs(spark, d))


@query("j02_one_to_one_join", sql_rounded(f"WITH {ORDER_SIDES} SELECT l.o_custkey, l.o_orderpriority, l.price AS price_f, r.price AS price_o FROM os l JOIN os r ON l.o_custkey = r.o_custkey AND l.o_orderpriority = r.o_orderpriority WHERE l.o_orderstatus = 'F' AND r.o_orderstatus = 'O'", "price_f price_o"))
def j02(spark, d):
    sides = order_sides(spark, d)
    f, o = (sides.where(F.col("o_orderstatus") == s).select(*KEYS, "price") for s in "FO")
    return rounded(pairs.one_to_one(f, o, KEYS, ("_f", "_o")))


@query("j05_pooled_benchmark", sql_rounded(f"WITH {ORDER_SIDES}, m AS (SELECT o_custkey, o_orderstatus, avg(price) AS v FROM os GROUP BY ALL), b AS (SELECT o_custkey, avg(v) FILTER (WHERE o_orderstatus = 'F') AS one, avg(v) FILTER (WHERE o_orderstatus <> 'F') AS others, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_others FROM m GROUP BY 1) SELECT *, one - others AS difference FROM b WHERE one IS NOT NULL AND others IS NOT NULL", "one others difference", 8))
def j05(spark, d):
    return rounded(pairs.pooled_benchmark(order_sides(spark, d), ["o_custkey"], F.col("o_orderstatus"), "F", "price"), 8)


@query("j06_each_against_reference", sql_rounded(f"WITH {ORDER_SIDES}, m AS (SELECT o_orderpriority, o_orderstatus, avg(price) AS v FROM os GROUP BY ALL) SELECT a.o_orderpriority, a.o_orderstatus, a.v - b.v AS difference FROM m a JOIN m b ON a.o_orderpriority = b.o_orderpriority AND b.o_orderstatus = 'F' WHERE a.o_orderstatus <> 'F'", "difference"))
def j06(spark, d):
    m = order_sides(spark, d).groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("price").alias("v"))
    base = F.max(F.when(F.col("o_orderstatus") == "F", F.col("v"))).over(Window.partitionBy("o_orderpriority"))
    return rounded(m.withColumn("base", base).where("o_orderstatus <> 'F' and base is not null").select("o_orderpriority", "o_orderstatus", (F.col("v") - F.col("base")).alias("difference")))


@query("j07_cell_means_joined", sql_rounded("WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT user_id AS k, avg(value) AS y FROM events GROUP BY 1) SELECT a.k, x, y FROM a JOIN b ON a.k = b.k", "x y"))
def j07(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("x"))
    b = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.avg("value").alias("y"))
    return rounded(a.join(b, "k"))


@query("p19_outcomes", f"WITH {_PAIRS} SELECT CASE WHEN large_left = 0 AND large_right = 1 THEN 'rescue' WHEN large_left = 1 AND large_right = 0 THEN 'harm' WHEN large_left = 1 THEN 'both_correct' ELSE 'both_incorrect' END AS outcome, count(*) AS n FROM pr GROUP BY 1")
def p19(spark, d):
    return _pairs(spark, d).groupBy(outcome(F.col("large_left") == 1, F.col("large_right") == 1).alias("outcome")).agg(F.count("*").alias("n"))


@query("p19_outcomes_comparable", f"WITH {_PAIRS} SELECT CASE WHEN o_custkey % 5 = 0 THEN 'not_comparable' WHEN large_left = 0 AND large_right = 1 THEN 'rescue' WHEN large_left = 1 AND large_right = 0 THEN 'harm' WHEN large_left = 1 THEN 'both_correct' ELSE 'both_incorrect' END AS outcome, count(*) AS n FROM pr GROUP BY 1")
def p19_comparable(spark, d):
    label = outcome(F.col("large_left") == 1, F.col("large_right") == 1, F.col("o_custkey") % 5 != 0)
    return _pairs(spark, d).groupBy(label.alias("outcome")).agg(F.count("*").alias("n"))


_CELLS = f"{_PAIRS}, ce AS (SELECT o_orderpriority, o_custkey % 4 AS grp, count(*) AS matched_pairs, sum(large_left)::BIGINT AS left_events, sum(large_right)::BIGINT AS right_events, avg(large_right - large_left) AS risk_difference, coalesce(stddev_samp(large_right - large_left), 0) AS sd, count(*) FILTER (WHERE large_left <> large_right) AS discordant_pairs FROM pr GROUP BY ALL), cx AS (SELECT *, risk_difference - 1.96 * sd / sqrt(matched_pairs) AS ci_low, risk_difference + 1.96 * sd / sqrt(matched_pairs) AS ci_high, left_events + right_events AS pooled_events, left_events + right_events >= 5 AS informative FROM ce), cells AS (SELECT *, informative AND abs(risk_difference) >= 0.05 AS substantive, CASE WHEN risk_difference > 0 THEN 'right_more' WHEN risk_difference < 0 THEN 'left_more' ELSE 'tie' END AS direction FROM cx)"


def _cells(spark, d):
    rows = _pairs(spark, d).withColumn("grp", F.col("o_custkey") % 4)
    return pairs.event_cells(rows, ["o_orderpriority", "grp"], F.col("large_left"), F.col("large_right"), 5, 0.05)


@query("a16_risk_differences", sql_rounded(f"WITH {_CELLS} SELECT o_orderpriority, grp, matched_pairs, left_events, right_events, risk_difference, discordant_pairs, ci_low, ci_high, informative, substantive, direction FROM cells", "risk_difference ci_low ci_high"))
def a16(spark, d):
    return rounded(_cells(spark, d).select("o_orderpriority", "grp", "matched_pairs", "left_events", "right_events", "risk_difference", "discordant_pairs", "ci_low", "ci_high", "informative", "substantive", "direction"))


@query("a17_recurrence_support", f"WITH {_CELLS}, su AS (SELECT o_orderpriority, direction, count(DISTINCT grp) AS models, count(DISTINCT grp % 2) AS families FROM cells WHERE substantive GROUP BY ALL) SELECT c.o_orderpriority, c.grp, coalesce(models, 0) AS support_models, coalesce(families, 0) AS support_parent_families, CASE WHEN NOT informative THEN 'uninformative_low_exposure' WHEN NOT substantive THEN 'no_substantive_pocket' WHEN families >= 2 THEN 'cross_family_recurrence' WHEN models >= 2 THEN 'within_family_recurrence' ELSE 'isolated_model_pocket' END AS recurrence FROM cells c LEFT JOIN su ON c.o_orderpriority = su.o_orderpriority AND c.direction = su.direction")
def a17(spark, d):
    rows = _cells(spark, d).withColumns({"family": F.col("grp") % 2, "protocol": F.col("grp") % 3})
    return pairs.recurrence_support(rows, ["o_orderpriority"], "grp", "family", "family", "protocol").select("o_orderpriority", "grp", "support_models", "support_parent_families", "recurrence")


@query("a18_stability", sql_rounded(f"WITH {_CELLS}, w AS (SELECT l.risk_difference x, r.risk_difference y, l.substantive sx, r.substantive sy FROM cells l JOIN cells r ON l.o_orderpriority = r.o_orderpriority AND l.grp = 0 AND r.grp = 1) SELECT count(*) AS cells, count(*) FILTER (WHERE sx AND sy) AS both_substantive, count(*) FILTER (WHERE sx AND NOT sy) AS left_only, count(*) FILTER (WHERE NOT sx AND sy) AS right_only, count(*) FILTER (WHERE x * y > 0) AS same_direction, corr(x, y) AS correlation FROM w", "correlation"))
def a18(spark, d):
    rows = _cells(spark, d).withColumns({"side": F.col("grp").cast("string"), "every": F.lit(1)})
    return rounded(pairs.stability(rows, ["every"], ["o_orderpriority"], "side", "0", "1").drop("every"))


@query("k08_transitions", sql_rounded(f"WITH {_PAIRS} SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE large_left <> large_right) AS switched, count(*) FILTER (WHERE large_left <> large_right) / count(*)::DOUBLE AS switch_rate FROM pr GROUP BY 1", "switch_rate"))
def k08(spark, d):
    p = _pairs(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("large_left") != F.col("large_right")).alias("switched"))
    return rounded(p.withColumn("switch_rate", F.col("switched") / F.col("n")))


@query("k09_net_rescue", sql_rounded(f"WITH {_PAIRS} SELECT o_orderpriority, (count(*) FILTER (WHERE large_left = 0 AND large_right = 1) - count(*) FILTER (WHERE large_left = 1 AND large_right = 0)) / count(*)::DOUBLE AS net_rescue FROM pr GROUP BY 1", "net_rescue"))
def k09(spark, d):
    up, down = F.count_if((F.col("large_left") == 0) & (F.col("large_right") == 1)), F.count_if((F.col("large_left") == 1) & (F.col("large_right") == 0))
    return rounded(_pairs(spark, d).groupBy("o_orderpriority").agg(((up - down) / F.count("*")).alias("net_rescue")))


# Sensitivity.

_SS = f"WITH {SCORES}, u AS ({' UNION ALL '.join(f'SELECT model, stratum, {chr(39)}{f}{chr(39)} AS factor, {f}::VARCHAR AS level, score FROM sc' for f in FACTORS)}), g AS (SELECT model, stratum, factor, level, count(*) AS n, avg(score) AS m FROM u GROUP BY ALL), b AS (SELECT model, stratum, factor, count(*) AS levels, sum(n)::BIGINT AS n, sum(n * (m - gm) ** 2) AS ss FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS gm FROM g WINDOW w AS (PARTITION BY model, stratum, factor)) GROUP BY ALL)"


@query("st01_between_group_ss", sql_rounded(f"{_SS} SELECT * FROM b", "ss", 4))
def st01(spark, d):
    return rounded(sensitivity.between_ss(scores(spark, d), ["model", "stratum"], FACTORS, "score"), 4)


@query("st02_factor_spread", sql_rounded(f"{_SS} SELECT model, factor, sqrt(sum(CASE WHEN levels >= 2 THEN ss ELSE 0 END) / sum(n)) AS spread, sum(n)::BIGINT AS n FROM b GROUP BY ALL", "spread"))
def st02(spark, d):
    return rounded(sensitivity.factor_spread(scores(spark, d), ["model"], "stratum", FACTORS, "score"))


@query("st02_spread_overview", sql_rounded(f"WITH {SCORES}, m AS (SELECT model, stratum, avg(score) AS m FROM sc GROUP BY ALL) SELECT sc.model, stddev_pop(score) AS total_sd, count(score) AS n, any_value(s.v) AS stratum_sd FROM sc JOIN (SELECT model, stddev_pop(m) AS v FROM m GROUP BY 1) s ON sc.model = s.model GROUP BY 1", "total_sd stratum_sd"))
def st02_overview(spark, d):
    return rounded(sensitivity.spread_overview(scores(spark, d), ["model"], "stratum", "score"))


@query("a24_block_removed", sql_rounded(f"WITH {SCORES} SELECT model, stratum, avg(a) AS mean_adjusted, var_samp(a) AS variance FROM (SELECT *, score - avg(score) OVER (PARTITION BY model, block) + avg(score) OVER (PARTITION BY model) AS a FROM sc) GROUP BY ALL", "mean_adjusted variance"))
def a24(spark, d):
    adjusted = sensitivity.without_block(scores(spark, d), ["model"], "block", "score", "a")
    return rounded(adjusted.groupBy("model", "stratum").agg(F.avg("a").alias("mean_adjusted"), F.var_samp("a").alias("variance")))


@query("st03_residual_rmse")
def st03(spark, d):
    return rounded(sensitivity.residual_rmse(scores(spark, d), "model", FACTORS, "score"))


@query("st04_additive_variation")
def st04(spark, d):
    return rounded(sensitivity.variation(scores(spark, d), "model", "stratum", FACTORS, "score", "blur", "l_linenumber"))


@query("st05_blocked_variation")
def st05(spark, d):
    return rounded(sensitivity.blocked_variation(scores(spark, d), "model", "stratum", "block", FACTORS, "score", "blur"))


@query("st06_fisher_combined")
def st06(spark, d):
    return rounded(sensitivity.fisher_combined(sensitivity.anova_by(scores(spark, d), ["model", "stratum"], FACTORS, "score"), ["model"]))


@query("st07_chi_square_tail", sql_rounded("WITH x AS (SELECT p_partkey, p_retailprice / 10 AS x, 1 + p_partkey % 6 AS k FROM part) SELECT p_partkey, (-x / 2 + ln(list_sum(list_transform(range(k), lambda i: exp(i * ln(x / 2) - lgamma(i + 1)))))) / ln(10) AS log10p FROM x", "log10p"))
def st07(spark, d):
    k = 1 + F.col("p_partkey") % 6
    return rounded(table(spark, d, "part").select("p_partkey", sensitivity.log10_tail(F.col("p_retailprice") / 10, k).alias("log10p")))


@query("st08_single_fit_test")
def st08(spark, d):
    return rounded(sensitivity.single_term_test(scores(spark, d), "model", "stratum", ["block", *FACTORS], "score"))


@query("st24_interaction")
def st24(spark, d):
    return rounded(sensitivity.interaction_test(scores(spark, d), "model", "stratum", "l_linenumber", "score"))


@query("st25_type_two_anova")
def st25(spark, d):
    fits = sensitivity.anova_by(scores(spark, d), ["model"], FACTORS, "score")
    terms = fits.where("term <> 'residual'")
    return rounded(terms.withColumn("share", F.try_divide(F.col("ss"), F.sum("ss").over(Window.partitionBy("model")))).select("model", "term", "ss", "df", "f", "share"), 4)


# Statistics.


@query("w07_benjamini_hochberg", sql_rounded("WITH p AS (SELECT p_partkey, p_brand, (p_partkey * 7919 % 1000 + 1) / 2000.0::DOUBLE AS p FROM part), r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS raw, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k FROM p) SELECT p_partkey, least(1, min(raw) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM r", "q_value"))
def w07(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 1000 + 1) / 2000.0).cast("double").alias("p"))
    return rounded(stats.benjamini_hochberg(p, ["p_brand"], "p").select("p_partkey", "q_value"))


@query("x17_empirical_logit", sql_rounded(f"WITH {STANCES} SELECT model, topic, ln((count(*) FILTER (WHERE predicted) + 0.5) / (count(*) - count(*) FILTER (WHERE predicted) + 0.5)) AS logit FROM st GROUP BY ALL", "logit"))
def x17(spark, d):
    return rounded(stances(spark, d).groupBy("model", "topic").agg(stats.empirical_logit(F.count_if("predicted"), F.count("*")).alias("logit")))


@query("st14_differential_functioning", sql_rounded(f"WITH {STANCES}, c AS (SELECT model, topic, count(*) FILTER (WHERE predicted) AS s, count(*) AS n FROM st GROUP BY ALL) SELECT model, topic, s, n, ln((s + 0.5) / (n - s + 0.5)) - ln((sum(s) OVER m + 0.5) / (sum(n) OVER m - sum(s) OVER m + 0.5)) - ln((sum(s) OVER t + 0.5) / (sum(n) OVER t - sum(s) OVER t + 0.5)) + ln((sum(s) OVER () + 0.5) / (sum(n) OVER () - sum(s) OVER () + 0.5)) AS dif_logit FROM c WINDOW m AS (PARTITION BY model), t AS (PARTITION BY topic)", "dif_logit"))
def st14(spark, d):
    rows = stances(spark, d).withColumns({"s1": F.col("predicted").cast("long"), "n1": F.lit(1).cast("long")})
    return rounded(stats.differential_functioning(rows, ["model"], "topic", "s1", "n1").select("model", "topic", "s", "n", "dif_logit"))


_RANKS = "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2::DOUBLE AS rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2::DOUBLE AS ry FROM part)"


@query("st12_spearman", sql_rounded(f"{_RANKS} SELECT p_brand, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1 HAVING count(*) >= 10", "rho"))
def st12(spark, d):
    return rounded(stats.spearman(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice"))


@query("st12_spearman_p")
def st12_p(spark, d):
    return rounded(stats.spearman_p(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice"))


@query("st13_pearson", sql_rounded("SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1", "r"))
def st13(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r")))


@query("st15_normal_interval", sql_rounded(f"WITH {_PAIRS} SELECT o_orderpriority, avg(price_right - price_left) AS mean, avg(price_right - price_left) - 1.96 * stddev_samp(price_right - price_left) / sqrt(count(*)) AS ci_low, avg(price_right - price_left) + 1.96 * stddev_samp(price_right - price_left) / sqrt(count(*)) AS ci_high FROM pr GROUP BY 1", "mean ci_low ci_high", 2))
def st15(spark, d):
    x = F.col("price_right") - F.col("price_left")
    half = 1.96 * F.stddev_samp(x) / F.sqrt(F.count("*"))
    return rounded(_pairs(spark, d).groupBy("o_orderpriority").agg(F.avg(x).alias("mean"), (F.avg(x) - half).alias("ci_low"), (F.avg(x) + half).alias("ci_high")), 2)


@query("st18_cohen_dz", sql_rounded(f"WITH {_PAIRS} SELECT o_orderpriority, count(*) AS n, avg(price_right - price_left) / stddev_samp(price_right - price_left) AS dz FROM pr GROUP BY 1", "dz"))
def st18(spark, d):
    return rounded(stats.cohen_dz(_pairs(spark, d), ["o_orderpriority"], F.col("price_right") - F.col("price_left")).select("o_orderpriority", "n", "dz"))


@query("st19_wasserstein", sql_rounded("WITH v AS (SELECT l_linestatus, l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS b FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2), c AS (SELECT *, sum(a) OVER (PARTITION BY l_linestatus ORDER BY v) / sum(a) OVER (PARTITION BY l_linestatus)::DOUBLE AS fa, sum(b) OVER (PARTITION BY l_linestatus ORDER BY v) / sum(b) OVER (PARTITION BY l_linestatus)::DOUBLE AS fb, lead(v) OVER (PARTITION BY l_linestatus ORDER BY v) - v AS step FROM v) SELECT l_linestatus, sum(a)::BIGINT AS n_left, sum(b)::BIGINT AS n_right, coalesce(sum(abs(fa - fb) * step), 0) AS distance FROM c GROUP BY 1", "distance"))
def st19(spark, d):
    return rounded(stats.wasserstein(table(spark, d, "lineitem"), ["l_linestatus"], F.col("l_returnflag"), "A", "N", "l_quantity"))


@query("st22_linear_trend", sql_rounded("SELECT p_brand, regr_count(p_retailprice, p_size)::BIGINT AS n, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept, corr(p_size, p_retailprice) AS r FROM part GROUP BY 1 HAVING count(*) >= 3", "slope intercept r", 5))
def st22(spark, d):
    return rounded(stats.linear_trend(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice"), 5)


@query("st27_prediction_errors", sql_rounded("WITH m AS (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) SELECT l_returnflag, count(*) AS n, sqrt(avg((l_quantity - l_linenumber) ** 2)) AS rmse, avg(abs(l_quantity - l_linenumber)) AS mae, 1 - sum((l_quantity - l_linenumber) ** 2) / sum((l_quantity - m) ** 2) AS r2 FROM m GROUP BY 1", "rmse mae r2"))
def st27(spark, d):
    li = table(spark, d, "lineitem").withColumn("guess", F.col("l_linenumber").cast("double"))
    return rounded(stats.errors(li, ["l_returnflag"], "l_quantity", "guess"))


@query("st10_exact_tests")
def st10(spark, d):
    c = _cells(spark, d).select("o_orderpriority", "grp", "left_events", "right_events", "matched_pairs")
    c = c.withColumns({"a": F.col("right_events"), "b": F.col("matched_pairs") - F.col("right_events"), "c": F.col("left_events"), "d": F.col("matched_pairs") - F.col("left_events")})
    return rounded(stats.exact_test(c, "a", "b", "c", "d").select("o_orderpriority", "grp", "odds_ratio", "p_value"))


@query("st11_cluster_contrast")
def st11(spark, d):
    return rounded(stats.cluster_contrast(_pairs(spark, d), ["o_orderpriority"], ["o_custkey"], F.col("price_right") - F.col("price_left")), 4)


def _differences(spark, d):
    """Left and right outcome of matched pairs, by priority; customers' clusters."""
    return _pairs(spark, d).withColumn("cluster", F.col("o_custkey") % 97), F.col("large_right") - F.col("large_left")


@query("st16_bayes_bootstrap")
def st16(spark, d):
    rows, v = _differences(spark, d)
    return rounded(resampling.bayes_bootstrap(rows, ["o_orderpriority"], v))


@query("st17_sign_flip")
def st17(spark, d):
    rows, v = _differences(spark, d)
    return rounded(resampling.sign_flip(rows, ["o_orderpriority"], v))


@query("st20_cluster_bootstrap")
def st20(spark, d):
    rows, v = _differences(spark, d)
    return rounded(resampling.bootstrap_mean(rows, ["o_orderpriority"], v, ["cluster"]))


@query("st21_bootstrap_of_scores")
def st21(spark, d):
    return rounded(resampling.bootstrap_mean(predictions(spark, d), ["model"], F.col("p")))


@query("st21_bootstrap_of_prices")
def st21_prices(spark, d):
    """A continuous column with a group for each line status: all its values are different, and no task has a group whole."""
    rows = table(spark, d, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("v"))
    return rounded(resampling.bootstrap_mean(rows, ["l_linestatus"], F.col("v"), draws=400), 4)


@query("nq18_lowest_rate_per_model", f"WITH {PREDICTIONS}, m AS (SELECT model, target, avg((p >= 0.5)::INT) AS rate FROM pred GROUP BY ALL), w AS (SELECT model, target, row_number() OVER (PARTITION BY model ORDER BY rate, target) AS r FROM m) SELECT target, count(*) AS n FROM w WHERE r = 1 GROUP BY 1")
def nq18(spark, d):
    m = predictions(spark, d).groupBy("model", "target").agg(F.avg((F.col("p") >= 0.5).cast("double")).alias("rate"))
    w = m.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy("rate", "target")))
    return w.where("r = 1").groupBy("target").agg(F.count("*").alias("n"))
