"""Queries on predictions: confusion, calibration, two-label metrics, agreement, AUC, groupings, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.labels import rank_of
from quillspark.operators import metrics
from quillspark.operators.numbering import numbered_within, with_group
from quillspark.plans.bindings import PREDICTIONS, STANCES, predictions, rounded, sql_rounded, stances, table
from quillspark.plans.registry import query

_COUNTS = "count(*) FILTER (WHERE gold AND y) AS tp, count(*) FILTER (WHERE NOT gold AND NOT y) AS tn, count(*) FILTER (WHERE NOT gold AND y) AS fp, count(*) FILTER (WHERE gold AND NOT y) AS fn"
_RATES = "(tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1"


def _summary_sql(groups: str) -> str:
    inner = f"SELECT {groups}, count(*) AS n, avg(gold::INT) AS prevalence, avg(y::INT) AS positive_rate, avg(p) AS mean_p, avg(p) FILTER (WHERE gold) AS mean_p_gold, avg(p) FILTER (WHERE NOT gold) AS mean_p_other, {_COUNTS} FROM (SELECT *, p >= 0.5 AS y FROM pred) GROUP BY {groups}"
    return f"SELECT *, {_F1} FROM (SELECT *, {_RATES} FROM ({inner}))"


_DOUBLES = "prevalence positive_rate mean_p mean_p_gold mean_p_other accuracy precision recall f1"


@query("a02_confusion_summary", sql_rounded(f"WITH {PREDICTIONS} {_summary_sql('model, target')}", _DOUBLES))
def a02(spark, d):
    return rounded(metrics.confusion_summary(predictions(spark, d), ["model", "target"], F.col("gold"), F.col("p")))


@query("a03_micro_rates", sql_rounded(f"WITH {PREDICTIONS}, c AS (SELECT model, count(*) AS n, {_COUNTS} FROM (SELECT *, p >= 0.5 AS y FROM pred) GROUP BY model) SELECT *, {_F1} FROM (SELECT model, n, tp, tn, fp, fn, {_RATES} FROM c)", "accuracy precision recall f1"))
def a03(spark, d):
    per = metrics.confusion_summary(predictions(spark, d), ["model", "target"], F.col("gold"), F.col("p"))
    return rounded(metrics.pooled_rates(per, ["model"]))


@query("a04_calibration", sql_rounded(f"WITH {PREDICTIONS} SELECT model, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(gold::INT) AS observed_rate FROM pred GROUP BY 1, 2", "mean_p observed_rate"))
def a04(spark, d):
    return rounded(metrics.calibration(predictions(spark, d), ["model"], F.col("gold"), F.col("p")))


_TWO = """SELECT {g}, count(*) AS n, count(*) FILTER (WHERE gold = predicted) / count(*)::DOUBLE AS accuracy,
 (coalesce(2 * count(*) FILTER (WHERE gold AND predicted) / nullif(2 * count(*) FILTER (WHERE gold AND predicted) + count(*) FILTER (WHERE gold <> predicted), 0)::DOUBLE, 0)
 + coalesce(2 * count(*) FILTER (WHERE NOT gold AND NOT predicted) / nullif(2 * count(*) FILTER (WHERE NOT gold AND NOT predicted) + count(*) FILTER (WHERE gold <> predicted), 0)::DOUBLE, 0)) / 2 AS macro_f1,
 coalesce(2 * count(*) FILTER (WHERE NOT gold AND NOT predicted) / nullif(2 * count(*) FILTER (WHERE NOT gold AND NOT predicted) + count(*) FILTER (WHERE gold <> predicted), 0)::DOUBLE, 0) AS negative_f1,
 coalesce(2 * count(*) FILTER (WHERE gold AND predicted) / nullif(2 * count(*) FILTER (WHERE gold AND predicted) + count(*) FILTER (WHERE gold <> predicted), 0)::DOUBLE, 0) AS positive_f1,
 avg(confidence) AS mean_confidence, avg(predicted::INT) AS positive_pred_rate, avg(gold::INT) AS positive_gold_rate FROM st GROUP BY {g}"""
_TWO_DOUBLES = "accuracy macro_f1 negative_f1 positive_f1 mean_confidence positive_pred_rate positive_gold_rate"


def _two(df, groups):
    return metrics.two_label_metrics(df, groups, F.col("gold"), F.col("predicted"), F.col("confidence"))


@query("a05_two_label_metrics", sql_rounded(f"WITH {STANCES} {_TWO.format(g='model')}", _TWO_DOUBLES))
def a05(spark, d):
    return rounded(_two(stances(spark, d), ["model"]))


@query("a05_config_metrics", sql_rounded(f"WITH {STANCES} {_TWO.format(g='model, config')}", _TWO_DOUBLES))
def a05_config(spark, d):
    return rounded(_two(stances(spark, d), ["model", "config"]))


@query("a06_topic_table", sql_rounded(f"WITH {STANCES} SELECT model, topic, gold, count(*) AS n, avg((gold = predicted)::INT) AS accuracy, avg(predicted::INT) AS positive_rate, avg(confidence) AS mean_confidence FROM st GROUP BY ALL", "accuracy positive_rate mean_confidence"))
def a06(spark, d):
    rows = stances(spark, d).groupBy("model", "topic", "gold")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(F.col("predicted").cast("double")).alias("positive_rate"), F.avg("confidence").alias("mean_confidence")))


@query("a08_config_dispersion", sql_rounded(f"WITH {PREDICTIONS} SELECT model, target, avg(p) AS mean_p, avg(p * (1 - p)) AS mean_dispersion FROM pred GROUP BY ALL", "mean_p mean_dispersion"))
def a08(spark, d):
    return rounded(predictions(spark, d).groupBy("model", "target").agg(F.avg("p").alias("mean_p"), F.avg(F.col("p") * (1 - F.col("p"))).alias("mean_dispersion")))


@query("a01_metric_summary", sql_rounded("SELECT o_orderstatus, o_orderpriority, count(o_totalprice) AS o_totalprice__count, avg(o_totalprice) AS o_totalprice__mean, median(o_totalprice) AS o_totalprice__median, stddev_samp(o_totalprice) AS o_totalprice__std FROM orders GROUP BY ALL", "o_totalprice__mean o_totalprice__median o_totalprice__std", 3))
def a01(spark, d):
    return rounded(metrics.summarize(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]), 3)


_A14 = "count(*) AS n, avg(CAST(gold = predicted AS INT)) AS agreement, avg(confidence) AS mean_confidence"


@query("a14_grouping_sets", sql_rounded(f"WITH {STANCES} SELECT CASE WHEN grouping(model) = 1 AND grouping(topic) = 1 THEN 'all' WHEN grouping(topic) = 1 THEN 'model' WHEN grouping(model) = 1 THEN 'topic' ELSE 'model_topic' END AS scope, model, topic, {_A14} FROM st GROUP BY GROUPING SETS ((), (model), (topic), (model, topic))", "agreement mean_confidence"))
def a14(spark, d):
    sets = {"all": [], "model": ["model"], "topic": ["topic"], "model_topic": ["model", "topic"]}
    aggregates = dict(x.rsplit(" AS ", 1)[::-1] for x in _A14.split(", "))
    return rounded(metrics.grouping_sets(stances(spark, d), sets, aggregates))


def _mean(column: str, digits: int, duck: bool = False) -> str:
    """The mean of a column of cents, rounded half up in whole numbers: no sum hangs on its order, no tie on a last bit."""
    ten = 10 ** (digits - 2)
    if duck:
        return f"(sum(round({column} * 100)::BIGINT)::BIGINT * {2 * ten} + count({column})) // (2 * count({column})) / {10**digits}::DOUBLE"
    return f"(sum(cast(round({column} * 100) as bigint)) * {2 * ten} + count({column})) div (2 * count({column})) / {10**digits}d"


@query("a15_factor_summary", sql_rounded(f"WITH f AS (SELECT 'o_orderstatus' AS factor, o_orderstatus AS level, o_totalprice FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM orders) SELECT factor, level, count(*) AS n, {_mean('o_totalprice', 3, True)} AS mean_price FROM f GROUP BY ALL", "mean_price", 3))
def a15(spark, d):
    return rounded(metrics.long_factor_summary(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [], [F.count("*").alias("n"), F.expr(_mean("o_totalprice", 3)).alias("mean_price")]), 3)


@query("a12_family_rollup", sql_rounded("WITH c AS (SELECT p_brand, p_type, p_size, count(*) AS n, sum(round(p_retailprice * 100)::BIGINT)::BIGINT AS cents FROM part GROUP BY ALL) SELECT p_brand, count(DISTINCT p_type) AS types, sum(n)::BIGINT AS n, avg(n) AS mean_n, (200 * sum(cents)::BIGINT + sum(n)::BIGINT) // (2 * sum(n)::BIGINT) / 10000::DOUBLE AS mean_price FROM c GROUP BY p_brand", "mean_n mean_price", 4))
def a12(spark, d):
    cells = table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"), F.sum(F.expr("cast(round(p_retailprice * 100) as bigint)")).alias("cents"))
    return rounded(cells.groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.sum("n").alias("n"), F.avg("n").alias("mean_n"), F.expr("(200 * sum(cents) + sum(n)) div (2 * sum(n)) / 10000d").alias("mean_price")), 4)


@query("a11_question_cells", sql_rounded(f"WITH {STANCES} SELECT topic, model, gold, count(*) AS n, count(*) FILTER (WHERE predicted) AS positive_n, count(*) FILTER (WHERE predicted) / count(*)::DOUBLE AS positive_rate, avg(confidence) AS mean_confidence FROM st GROUP BY ALL", "positive_rate mean_confidence"))
def a11(spark, d):
    return rounded(stances(spark, d).groupBy("topic", "model", "gold").agg(F.count("*").alias("n"), F.count_if("predicted").alias("positive_n"), F.avg(F.col("predicted").cast("double")).alias("positive_rate"), F.avg("confidence").alias("mean_confidence")))


@query("a13_duplicate_texts", "SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS distinct_texts, count(*) FILTER (WHERE length(trim(text)) = 0) AS empty_texts FROM documents GROUP BY source")
def a13(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"), F.count_if(F.length(F.trim("text")) == 0).alias("empty_texts"))


@query("a20_outcome_shares", sql_rounded("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority)::DOUBLE AS share FROM orders GROUP BY 1, 2", "share"))
def a20(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority"))))


@query("a22_topic_ranges", sql_rounded(f"WITH {STANCES}, m AS (SELECT topic, model, avg((gold = predicted)::INT) AS acc FROM st GROUP BY ALL) SELECT topic, min(acc) AS least, max(acc) AS most, max(acc) - min(acc) AS span FROM m GROUP BY topic", "least most span"))
def a22(spark, d):
    m = stances(spark, d).groupBy("topic", "model").agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("acc"))
    return rounded(m.groupBy("topic").agg(F.min("acc").alias("least"), F.max("acc").alias("most"), (F.max("acc") - F.min("acc")).alias("span")))


@query("a23_prediction_skew", sql_rounded(f"WITH {STANCES} SELECT model, avg(predicted::INT) - avg(gold::INT) AS skew FROM st GROUP BY model", "skew"))
def a23(spark, d):
    return rounded(stances(spark, d).groupBy("model").agg((F.avg(F.col("predicted").cast("double")) - F.avg(F.col("gold").cast("double"))).alias("skew")))


@query("a25_mode_per_group", "SELECT bucket, l_linenumber AS mode FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY c DESC, l_linenumber) AS r FROM (SELECT l_orderkey % 100 AS bucket, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)) WHERE r = 1")
def a25(spark, d):
    rows = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("bucket"), "l_linenumber").agg(F.count("*").alias("c"))
    return rows.groupBy("bucket").agg(F.max_by("l_linenumber", F.struct("c", -F.col("l_linenumber"))).alias("mode"))


@query("a26_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand")
def a26(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("a28_mean_absolute_delta", sql_rounded("SELECT o_orderpriority, avg(abs(o_totalprice - m)) AS mad FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1", "mad", 3))
def a28(spark, d):
    m = F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority"))
    return rounded(table(spark, d, "orders").withColumn("m", m).groupBy("o_orderpriority").agg(F.avg(F.abs(F.col("o_totalprice") - F.col("m"))).alias("mad")), 3)


@query("a31_distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value) AS distinct_values FROM events GROUP BY 1")
def a31(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("value").alias("distinct_values"))


_AUC = "WITH {c}, r AS (SELECT model, gold, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM pred) SELECT model, count(*) FILTER (WHERE gold) AS n_pos, count(*) FILTER (WHERE NOT gold) AS n_neg, (sum(r) FILTER (WHERE gold) - count(*) FILTER (WHERE gold) * (count(*) FILTER (WHERE gold) + 1) / 2::DOUBLE) / nullif(count(*) FILTER (WHERE gold) * count(*) FILTER (WHERE NOT gold), 0)::DOUBLE AS auc FROM r GROUP BY model"


@query("st28_roc_auc", sql_rounded(_AUC.format(c=PREDICTIONS), "auc"))
def st28(spark, d):
    return rounded(metrics.auc(predictions(spark, d), ["model"], F.col("gold"), F.col("p")))


@query("w02_group_mean", sql_rounded("SELECT event_id, avg(value) OVER (PARTITION BY event_type) AS group_mean FROM events", "group_mean"))
def w02(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return rounded(with_group(e, ["event_type"], e.groupBy("event_type").agg(F.avg("value").alias("group_mean"))).select("event_id", "group_mean"))


@query("w04_ranks_across_columns", f"WITH {PREDICTIONS}, m AS (SELECT model, avg(p) AS a, avg(gold::INT) AS b, count(*) / 1000.0::DOUBLE AS c FROM pred GROUP BY model), u AS (SELECT model, 'a' AS name, a AS v FROM m UNION ALL SELECT model, 'b', b FROM m UNION ALL SELECT model, 'c', c FROM m) SELECT model, name, rank() OVER (PARTITION BY model ORDER BY v DESC)::INT AS place FROM u")
def w04(spark, d):
    m = predictions(spark, d).groupBy("model").agg(F.avg("p").alias("a"), F.avg(F.col("gold").cast("double")).alias("b"), (F.count("*") / 1000.0).cast("double").alias("c"))
    u = m.unpivot("model", ["a", "b", "c"], "name", "v")
    return u.select("model", "name", F.rank().over(Window.partitionBy("model").orderBy(F.desc("v"))).alias("place"))


@query("w05_monotone_by_size", "WITH m AS (SELECT p_brand, p_size, avg(p_retailprice) AS v FROM part GROUP BY ALL), s AS (SELECT *, v - lag(v) OVER (PARTITION BY p_brand ORDER BY p_size) AS step FROM m) SELECT p_brand, coalesce(bool_and(step > 0), true) AS rising FROM s GROUP BY 1")
def w05(spark, d):
    m = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    s = m.withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy("p_brand").orderBy("p_size")))
    return s.groupBy("p_brand").agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("rising"))


@query("w01_row_in_block", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT - 1 AS lhs_row FROM events")
def w01(spark, d):
    return numbered_within(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], "lhs_row").select("event_id", F.col("lhs_row").cast("int").alias("lhs_row"))


@query("w08_first_k_per_group", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
def w08(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("event_type", "event_id")


@query("t01_mixed_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def t01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.asc_nulls_last("o_orderpriority"), F.desc_nulls_last("o_totalprice"), "o_orderkey")


@query("t02_sort_by_magnitude", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def t02(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey")


@query("t03_categorical_rank", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS place, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY place")
def t03(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", rank_of(F.col("o_orderstatus"), ["O", "F"]).alias("place")).agg(F.count("*").alias("n")).orderBy("place")


@query("t09_winner_per_group", f"WITH {PREDICTIONS}, m AS (SELECT target, model, avg(p) AS v FROM pred GROUP BY ALL) SELECT target, model AS winner FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY v DESC, model) AS r FROM m) WHERE r = 1")
def t09(spark, d):
    m = predictions(spark, d).groupBy("target", "model").agg(F.avg("p").alias("v"))
    w = Window.partitionBy("target").orderBy(F.desc("v"), "model")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").select("target", F.col("model").alias("winner"))


@query("r05_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def r05(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in "FOP"])


@query("r06_melt", "SELECT c_custkey, 'acctbal' AS name, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey FROM customer")
def r06(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot("c_custkey", ["acctbal", "nation"], "name", "v")


@query("u01_union_with_missing", "SELECT c_custkey AS k, c_acctbal AS v, NULL::VARCHAR AS status FROM customer UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def u01(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u02(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("u03_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("j08_many_to_one", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j08(spark, d):
    from quillspark.operators.pairs import many_to_one

    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    out = many_to_one(table(spark, d, "customer"), nation, ["c_nationkey"])
    return many_to_one(out, table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select("c_custkey", "n_name", "r_name")
