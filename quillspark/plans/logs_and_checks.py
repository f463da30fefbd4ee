"""Queries on logs and constraints: compaction, coverage, uniqueness, balance, probability sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.labels import integer_or
from quillspark.operators import checks, compaction
from quillspark.plans.bindings import ANSWERS, STANCES, item_answers, predictions, rounded, sql_rounded, stances, table
from quillspark.plans.registry import query

KEY, ORDER = ["user_id"], ["ts", "event_id"]


def _log(spark, d):
    return table(spark, d, "events")


def _error():
    return F.col("event_type") == "error"


_LAST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events"
_COLUMNS = "event_id, user_id, event_type, value"


@query("d01_last_wins_then_errors", f"SELECT {_COLUMNS} FROM ({_LAST}) WHERE r = 1 AND event_type <> 'error'")
def d01(spark, d):
    return compaction.last_wins(_log(spark, d), KEY, ORDER, _error()).select(*_COLUMNS.split(", "))


@query("d02_compacted_log", f"SELECT {_COLUMNS} FROM ({_LAST}) WHERE r = 1")
def d02(spark, d):
    return compaction.last_wins(_log(spark, d), KEY, ORDER).select(*_COLUMNS.split(", ")).orderBy("user_id")


@query("d03_first_wins", "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def d03(spark, d):
    return compaction.first_wins(_log(spark, d), KEY, ORDER).select(*_COLUMNS.split(", "))


@query("d03_duplicate_count", "SELECT count(*) AS records, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def d03_count(spark, d):
    return compaction.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_sql(way: str) -> str:
    order = ", ".join(f"{c} {way}" for c in _LINE_ORDER)
    return f"SELECT {', '.join(_LINE)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS r FROM lineitem) WHERE r = 1"


@query("d04_keep_last_duplicates", _line_sql("DESC"))
def d04(spark, d):
    return compaction.last_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER).select(*_LINE)


@query("d05_keep_first_duplicates", _line_sql("ASC"))
def d05(spark, d):
    return compaction.first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER).select(*_LINE)


@query("d06_any_success", "SELECT DISTINCT user_id FROM events WHERE event_type <> 'error'")
def d06(spark, d):
    return compaction.any_success(_log(spark, d), KEY, _error())


@query("d07_latest_success", f"SELECT user_id FROM ({_LAST}) WHERE r = 1 AND event_type <> 'error'")
def d07(spark, d):
    return compaction.latest_success(_log(spark, d), KEY, ORDER, _error())


@query("f07_pending_items", f"SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM ({_LAST}) WHERE r = 1 AND event_type <> 'error'")
def f07(spark, d):
    log = _log(spark, d)
    return compaction.pending(log.select("user_id").distinct(), compaction.latest_success(log, KEY, ORDER, _error()), KEY)


@query("f02_error_and_domain_filter", "SELECT event_type, count(*) FILTER (WHERE value >= 1) AS kept, count(*) FILTER (WHERE NOT coalesce(value >= 1, false)) AS dropped FROM events WHERE event_type <> 'error' GROUP BY event_type")
def f02(spark, d):
    ok = F.coalesce(F.col("value") >= 1, F.lit(False))
    return _log(spark, d).where(~_error()).groupBy("event_type").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


_EXPECTED = [("click", 200), ("purchase", 200), ("view", 200), ("missing", 200)]
_VALUES = ", ".join(f"('{a}', {b})" for a, b in _EXPECTED)


@query("a07_coverage", f"WITH {STANCES}, ex(model, expected) AS (VALUES {_VALUES}), s AS (SELECT model, count(*) AS rows, count(*) FILTER (WHERE NOT gold AND NOT predicted) AS errors, count(DISTINCT config) AS configs, count(DISTINCT (config, item)) AS items FROM st GROUP BY model) SELECT ex.model, coalesce(rows, 0) AS rows, coalesce(errors, 0) AS errors, coalesce(configs, 0) AS configs, coalesce(items, 0) AS items, expected, round(coalesce(items, 0) / expected::DOUBLE, 6) AS ratio FROM ex LEFT JOIN s ON ex.model = s.model")
def a07(spark, d):
    expected = spark.createDataFrame(_EXPECTED, "model string, expected int")
    return compaction.coverage(stances(spark, d), ["model"], "config", "item", ~F.col("gold") & ~F.col("predicted"), expected, "expected")


@query("v01_key_uniqueness", "SELECT t AS table_name, rows, keys, rows = keys AS \"unique\" FROM (SELECT 'events' t, count(*) AS rows, count(DISTINCT event_id) AS keys FROM events UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey) FROM orders)")
def v01(spark, d):
    out = None
    for t, keys in (("events", ["event_id"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("orders", ["o_orderkey"])):
        part = checks.key_counts(table(spark, d, t), keys).select(F.lit(t).alias("table_name"), "rows", "keys", "unique")
        out = part if out is None else out.unionByName(part)
    return out


@query("v01_composite_key", "SELECT count(*) AS rows, count(DISTINCT l_orderkey * 100 + l_linenumber) AS keys FROM lineitem")
def v01_composite(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("rows"), F.countDistinct(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("keys"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("v02_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _TABLES))
def v02(spark, d):
    out = None
    for t in _TABLES:
        part = table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("v03_probability_sums", f"WITH {ANSWERS} SELECT label, count(*) AS rows, count(*) FILTER (WHERE list_min(p) < 0 OR list_max(p) > 1) AS out_of_range, count(*) FILTER (WHERE abs(list_sum(p) - 1) > 1e-8) AS bad_sum FROM ans GROUP BY label")
def v03(spark, d):
    return checks.probability_violations(item_answers(spark, d), ["label"], F.col("p"), 1e-8)


@query("v04_unbalanced_cells", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM c WHERE n <> (SELECT max(n) FROM c)")
def v04(spark, d):
    return checks.unbalanced(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("a21_group_sizes", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a21(spark, d):
    return _log(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("v07_pair_completeness", "WITH l AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O') SELECT count(*) FILTER (WHERE l.o_custkey IS NOT NULL AND r.o_custkey IS NOT NULL) AS pairs, count(*) FILTER (WHERE r.o_custkey IS NULL) AS left_only, count(*) FILTER (WHERE l.o_custkey IS NULL) AS right_only, 0::BIGINT AS different FROM l FULL JOIN r ON l.o_custkey = r.o_custkey AND l.o_orderpriority = r.o_orderpriority")
def v07(spark, d):
    o = table(spark, d, "orders")
    sides = [o.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority").distinct() for s in "FO"]
    return checks.pair_completeness(*sides, ["o_custkey", "o_orderpriority"])


@query("v10_outside_domain", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_mktsegment IS NULL GROUP BY 1 ORDER BY 1 LIMIT 5")
def v10(spark, d):
    return checks.outside_domain(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("v11_label_counts", "WITH st AS (SELECT model, gold, target FROM (SELECT d.lang AS model, l.toxic = 1 AS gold, d.source AS target FROM documents d JOIN labels l ON d.doc_id = l.doc_id)) SELECT target, count(*) AS n, count(*) FILTER (WHERE gold) AS positive, count(*) FILTER (WHERE NOT gold) AS negative FROM st GROUP BY target")
def v11(spark, d):
    return predictions(spark, d).groupBy("target").agg(F.count("*").alias("n"), F.count_if("gold").alias("positive"), F.count_if(~F.col("gold")).alias("negative"))


@query("x29_json_defaults", "SELECT event_id, coalesce((props::JSON->>'$.k')::INT, -1) AS k, coalesce(props::JSON->>'$.none', '') AS missing FROM events")
def x29(spark, d):
    return _log(spark, d).select("event_id", integer_or(F.get_json_object("props", "$.k")).alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("")).alias("missing"))


@query("j15_design_agreement", "SELECT count(*) AS rows, count(*) FILTER (WHERE o.o_orderstatus IS NOT DISTINCT FROM l.l_linestatus) AS equal FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def j15(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus").eqNullSafe(F.col("l_linestatus"))).alias("equal"))


@query("j16_membership", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1")
def j16(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a19_stage_agreement", sql_rounded(f"WITH {STANCES} SELECT model, count(*) AS rows, count(*) FILTER (WHERE topic = 0) AS error_rows, count(*) FILTER (WHERE topic <> 0 AND confidence > 0.6) AS comparable_rows, count(*) FILTER (WHERE topic <> 0 AND confidence > 0.6 AND gold = predicted) AS agreement_rows, count(*) FILTER (WHERE topic <> 0 AND confidence > 0.6) / count(*)::DOUBLE AS comparable_rate, count(*) FILTER (WHERE topic <> 0 AND confidence > 0.6 AND gold = predicted) / nullif(count(*) FILTER (WHERE topic <> 0 AND confidence > 0.6), 0)::DOUBLE AS conditional_agreement_rate FROM st GROUP BY model", "comparable_rate conditional_agreement_rate"))
def a19(spark, d):
    from quillspark.operators.metrics import agreement

    second = F.when(F.col("confidence") > 0.6, F.col("predicted"))
    return rounded(agreement(stances(spark, d), ["model"], F.col("gold"), second, F.col("topic") == 0))
