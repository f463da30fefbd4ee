"""Queries of alignments, dimensions, ledgers, templates and record shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import arrays, labels, text
from quillspark.operators import checks, metrics, pairs, sensitivity
from quillspark.plans.bindings import ORDER_SIDES, PREDICTIONS, answers, order_sides, predictions, rounded, sql_rounded, table
from quillspark.plans.registry import query
from quillspark.session import scratch
from quillspark.sources import tables

_NAMES = ["Gemma-3", "Qwen3", "Llama_2", "phi"]
_NAME = "'org/' || CASE p_partkey % 4 WHEN 0 THEN 'Gemma-3' WHEN 1 THEN 'Qwen3' WHEN 2 THEN 'Llama_2' ELSE 'phi' END || CASE WHEN p_partkey % 5 = 0 THEN '-base' ELSE '-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE '.5b' END END"


@query("p26_sort_key", f"WITH m AS (SELECT p_partkey, {_NAME} AS name FROM part) SELECT p_partkey, lower(regexp_extract(regexp_extract(name, '[^/]*$'), '^[^-_0-9]*')) AS family, coalesce(try_cast(nullif(regexp_extract(name, '([0-9]+\\.?[0-9]*)\\s*[BbMm]', 1), '') AS DOUBLE), 0) AS size FROM m")
def p26(spark, d):
    m = table(spark, d, "part").select("p_partkey", F.expr(_NAME).alias("name"))
    return m.select("p_partkey", labels.sort_key(F.col("name")).alias("key")).select("p_partkey", "key.*")


#: Models with family, protocol and size in billions.
FAMILIES = [
    ("gemma-3-1b-it", "Gemma-3", "standard", 1.0),
    ("gemma-3-4b-it", "Gemma-3", "standard", 4.0),
    ("gemma-3-12b-it", "Gemma-3", "standard", 12.0),
    ("gemma-3-27b-it", "Gemma-3", "standard", 27.0),
    ("gemma-3-27b-it-abliterated-normpreserve-v1", "Gemma-3-abliterated", "standard", 27.0),
    *[(f"Qwen3-{n}B_{mode}", "Qwen3", mode, float(n)) for mode in ("no_think", "think") for n in (4, 8, 14, 32)],
]
_MODEL = "element_at(array({names}), cast(o_orderkey % 14 + 1 as int))".format(names=", ".join(f"'{f[0]}'" for f in FAMILIES) + ", 'other'")
_VALUES = ", ".join(str(f) for f in FAMILIES)


@query("p04_families", f"WITH f(model, family, protocol, size) AS (VALUES {_VALUES}), o AS (SELECT o_totalprice, ([{', '.join(repr(f[0]) for f in FAMILIES)}, 'other'])[o_orderkey % 14 + 1] AS model FROM orders) SELECT family, protocol, size::DOUBLE AS size, count(*) AS n, min(o_totalprice) AS least FROM o LEFT JOIN f USING (model) GROUP BY ALL")
def p04(spark, d):
    rows = table(spark, d, "orders").select(F.expr(_MODEL).alias("model"), "o_totalprice")
    dimension = spark.createDataFrame(FAMILIES, "model string, family string, protocol string, size double")
    met = pairs.many_to_one(rows, dimension, ["model"])
    return met.groupBy("family", "protocol", "size").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"))


@query("p13_confidence", "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE list_max(list_filter(list_transform(embedding, lambda v: CASE WHEN v < 0 THEN NULL ELSE v::DOUBLE END), lambda v: v IS NOT NULL)) END AS confidence FROM embeddings")
def p13(spark, d):
    odd = F.transform("embedding", lambda v: F.when(v < 0, None).when(F.col("vec_id") % 11 == 0, F.lit(float("nan"))).otherwise(v.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", arrays.confidence(odd).alias("confidence"))


@query("p23_polarity", "SELECT event_id, CASE event_id % 3 - 1 WHEN -1 THEN 'NEGATIVE' WHEN 1 THEN 'POSITIVE' END AS gold FROM events")
def p23(spark, d):
    return table(spark, d, "events").select("event_id", labels.polarity(F.col("event_id") % 3 - 1).alias("gold"))


@query("p24_chosen_text", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_name END AS chosen FROM part")
def p24(spark, d):
    keys, texts = F.array(*[F.lit(k) for k in "0123"][:3]), F.array("p_brand", "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", labels.chosen_text(keys, texts, (F.col("p_partkey") % 4).cast("string")).alias("chosen"))


@query("f03_equal_and_folded", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND lower(c_mktsegment) = 'building'")
def f03(spark, d):
    return table(spark, d, "customer").where((F.col("c_nationkey") == 3) & (F.lower("c_mktsegment") == "building")).select("c_custkey", "c_name")


@query("f06_complete_groups", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0")
def f06(spark, d):
    return checks.complete_groups(table(spark, d, "lineitem"), ["l_orderkey"], 4, F.col("l_returnflag") == "R")


@query("f10_stratified_exclusion", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' GROUP BY ALL")
def f10(spark, d):
    kept = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O"))
    return kept.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


_REGIMES = {"settled": ("F", "O"), "partial": ("P", "O")}


@query("j03_two_regimes", f"WITH {ORDER_SIDES} " + " UNION ALL ".join(f"SELECT a.o_custkey, a.o_orderpriority, a.large AS large_left, b.large AS large_right, a.n AS n_left, b.n AS n_right, '{name}' AS regime FROM os a JOIN os b USING (o_custkey, o_orderpriority) WHERE a.o_orderstatus = '{x}' AND b.o_orderstatus = '{y}'" for name, (x, y) in _REGIMES.items()))
def j03(spark, d):
    return pairs.regimes(order_sides(spark, d), ["o_custkey", "o_orderpriority"], F.col("o_orderstatus"), _REGIMES, ["large", "n"])


@query("j04_agreeing_facts", "WITH o AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS p, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL) SELECT a.o_custkey, list_concat(CASE WHEN a.n <> b.n THEN ['n'] ELSE [] END, CASE WHEN a.p <> b.p THEN ['p'] ELSE [] END) AS differs FROM o a JOIN o b USING (o_custkey) WHERE a.s = 'F' AND b.s = 'O'")
def j04(spark, d):
    sides = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.countDistinct("o_orderpriority").alias("n"), F.min("o_orderpriority").alias("p"))
    left, right = (sides.where(F.col("o_orderstatus") == s) for s in "FO")
    return pairs.agreeing(left, right, ["o_custkey"], ["n", "p"])


_NUMBERED = "SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS item_index FROM events"


@query("j14_positional_alignment", f"WITH s AS ({_NUMBERED}) SELECT event_type, item_index::INT AS item_index, CASE WHEN event_id % 10 = 0 THEN -1 ELSE user_id END AS user_id, event_id % 10 <> 0 AS aligned FROM s")
def j14(spark, d):
    from pyspark.sql.window import Window

    source = table(spark, d, "events").select("event_type", "event_id", "user_id")
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    rows = source.select("event_type", place.alias("item_index"), F.when(F.col("event_id") % 10 == 0, -1).otherwise(F.col("user_id")).alias("user_id"))
    return pairs.positional(rows, source, "event_type", "item_index", ["event_id"], ["user_id"])


@query("u04_unique_union", "SELECT doc_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]) AS parts FROM (SELECT doc_id, list_concat(string_split(lang, ''), list_concat(string_split(source, ''), string_split(lang, ''))) AS w FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)")
def u04(spark, d):
    docs = table(spark, d, "documents").where("lang is not null and source is not null")
    letters = [F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)) for c in ("lang", "source", "lang")]
    return docs.select("doc_id", arrays.unique_union(*letters).alias("parts"))


_KINDS = {"context": 5, "instruction": 10, "short": 5, "long": 5}
_KIND = "CASE item_id % 5 WHEN 0 THEN 'context' WHEN 1 THEN 'instruction' WHEN 2 THEN 'short' ELSE 'other' END"
_TEMPLATE = "CASE WHEN item_id % 15 = 1 THEN text ELSE text || ' {text}' END"


@query("v08_template_faults", f"WITH t AS (SELECT {_KIND} AS kind, {_TEMPLATE} AS text FROM benchmark), e(kind, expected) AS (VALUES {', '.join(str(x) for x in _KINDS.items())}), f AS (SELECT kind, count(t.text) AS n, count(*) FILTER (WHERE kind = 'instruction' AND NOT contains(t.text, '{{text}}')) AS without_placeholder, any_value(expected)::BIGINT AS expected FROM e FULL JOIN t USING (kind) GROUP BY kind) SELECT * FROM f WHERE n IS DISTINCT FROM expected OR without_placeholder > 0")
def v08(spark, d):
    templates = table(spark, d, "benchmark").selectExpr(f"{_KIND} AS kind", f"{_TEMPLATE} AS text")
    return checks.template_faults(templates, "kind", "text", _KINDS, {"instruction": "{text}"})


# Published figures and the tolerances they are held to.
_LEDGER = [("accuracy_of_first_model", 0.523556, 5e-7), ("agreement_of_stages", 0.950929, 5e-7), ("calibration_total", 19180800.0, 0.0), ("highest_target_auc", 0.692709, 5e-7), ("lowest_target_auc", 0.568837, 5e-7)]
_AUC = "SELECT target, (sum(r) FILTER (WHERE gold) - count(*) FILTER (WHERE gold) * (count(*) FILTER (WHERE gold) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE gold) * count(*) FILTER (WHERE NOT gold)) AS auc FROM (SELECT target, gold, rank() OVER (PARTITION BY target ORDER BY p) + (count(*) OVER (PARTITION BY target, p) - 1) / 2.0::DOUBLE AS r FROM pred) GROUP BY 1 HAVING bool_or(gold) AND bool_or(NOT gold)"


@query("v09_ledger", sql_rounded(f"WITH {PREDICTIONS}, au AS ({_AUC}), f(name, found) AS (SELECT 'accuracy_of_first_model', avg(((p >= 0.5) = gold)::INT) FROM pred WHERE model = (SELECT min(model) FROM pred) UNION ALL SELECT 'calibration_total', count(*)::DOUBLE FROM pred UNION ALL SELECT 'highest_target_auc', max(auc) FROM au UNION ALL SELECT 'lowest_target_auc', min(auc) FROM au), l(name, value, tolerance) AS (VALUES {', '.join(map(str, _LEDGER))}) SELECT name, value::DOUBLE AS value, tolerance::DOUBLE AS tolerance, found, coalesce(abs(found - value) <= tolerance, false) AS holds FROM l LEFT JOIN f USING (name)", "found tolerance", 9))
def v09(spark, d):
    """Published figures against those of the same kind that the given tables have; no table holds two stages."""
    rows = predictions(spark, d)
    first = rows.join(F.broadcast(rows.agg(F.min("model").alias("model"))), "model").agg(F.avg(((F.col("p") >= 0.5) == F.col("gold")).cast("double")))
    aucs = metrics.auc(rows, ["target"], F.col("gold"), F.col("p"))
    found = first.toDF("value").withColumn("name", F.lit("accuracy_of_first_model"))
    for name, own in (("calibration_total", rows.agg(F.count("*").cast("double"))), ("highest_target_auc", aucs.agg(F.max("auc"))), ("lowest_target_auc", aucs.agg(F.min("auc")))):
        found = found.unionByName(own.toDF("value").withColumn("name", F.lit(name)))
    return rounded(checks.against_ledger(found, spark.createDataFrame(_LEDGER, "name string, value double, tolerance double")), 9)


# Closed tables, arithmetic and combined tests.

_PERSONA = "CASE c_custkey % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'libertarian_left' WHEN 2 THEN 'libertarian_right' WHEN 3 THEN 'authoritarian_left' WHEN 4 THEN 'authoritarian_right' END"


@query("p16_target_signs", f"SELECT c_custkey, persona, CASE WHEN persona LIKE '%left' THEN -1 WHEN persona LIKE '%right' THEN 1 END AS economic, CASE WHEN persona LIKE 'lib%' THEN -1 WHEN persona LIKE 'auth%' THEN 1 END AS social FROM (SELECT c_custkey, {_PERSONA} AS persona FROM customer)")
def p16(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.expr(_PERSONA).alias("persona"))
    economic, social = labels.target_signs(F.col("persona"))
    return rows.withColumns({"economic": economic, "social": social})


@query("j10_looked_up", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS urgency FROM orders")
def j10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", labels.looked_up(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}).alias("urgency"))


@query("x16_arithmetic", sql_rounded("SELECT l_orderkey, l_linenumber, ln(l_extendedprice) AS log_price, ln(1 + l_discount) AS log1p_discount, exp(-l_tax) AS decay, sqrt(l_quantity) AS root, sqrt(l_quantity ** 2 + l_linenumber ** 2) AS length, abs(l_quantity - 25) AS off, least(greatest(l_quantity, 10), 40) AS clipped FROM lineitem", "log_price log1p_discount decay root length off clipped"))
def x16(spark, d):
    q = F.col("l_quantity").cast("double")
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("log_price"), F.log1p("l_discount").alias("log1p_discount"), F.exp(-F.col("l_tax")).alias("decay"), F.sqrt(q).alias("root"), F.hypot(q, F.col("l_linenumber").cast("double")).alias("length"), F.abs(q - 25).alias("off"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clipped")))


_PATH = "'data/' || CASE page_id % 6 WHEN 0 THEN '__pycache__/a.py' WHEN 1 THEN '.cache/b' WHEN 2 THEN 'c.pyc' WHEN 3 THEN 'd.csv.partial' WHEN 4 THEN 'pycache/e.py' ELSE 'f.parquet' END"


@query("f11_packaged_paths", f"SELECT page_id, {_PATH} AS path FROM pages WHERE page_id % 6 > 3")
def f11(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return rows.where(~tables.dropped(F.col("path")))


_P = "(p_partkey * 7919 % 1000 + 1) / 2000.0::DOUBLE"


@query("st06_combined_p_values", sql_rounded(f"WITH x AS (SELECT p_size % 10 AS size_class, p_brand AS term, count(*) AS k, -2 * sum(ln({_P})) AS chi2 FROM part GROUP BY ALL) SELECT *, (-chi2 / 2 + ln(list_sum(list_transform(range(k), lambda i: exp(i * ln(chi2 / 2) - lgamma(i + 1)))))) / ln(10) AS log10p FROM x", "chi2 log10p"))
def st06_values(spark, d):
    """The combination alone, of p-values that a table holds."""
    p = (F.col("p_partkey") * 7919 % 1000 + 1) / 2000.0
    rows = table(spark, d, "part").select((F.col("p_size") % 10).alias("size_class"), F.col("p_brand").alias("term"), F.ln(p.cast("double")).alias("log_p"))
    return rounded(sensitivity.fisher_combined(rows, ["size_class"], whole=True))


_LETTER = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"


@query("x03_word_counts_of_any_script", f"SELECT doc_id, len(regexp_extract_all(text, '[{_LETTER}]([{_LETTER}''-]*[{_LETTER}])?')) AS words FROM documents")
def x03_any(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"))


_SHAPES = "CASE event_id % 4 WHEN 0 THEN '{\"logprob\": -' || user_id || '.5}' WHEN 1 THEN '{\"7\": {\"logprob\": -' || user_id || '.25}}' WHEN 2 THEN '-' || user_id || '.75' ELSE '{\"note\": 1}' END"


@query("x31_log_probabilities", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN -user_id - 0.5 WHEN 1 THEN -user_id - 0.25 WHEN 2 THEN -user_id - 0.75 END::DOUBLE AS logprob FROM events")
def x31(spark, d):
    return table(spark, d, "events").select("event_id", tables.log_probability(F.expr(_SHAPES), F.lit("7")).alias("logprob"))


@query("i05_input_items", "SELECT item_id, text AS prompt, CASE WHEN item_id % 2 = 1 THEN ['yes', 'no'] ELSE NULL END AS candidates FROM benchmark WHERE length(trim(text)) > 0")
def i05(spark, d):
    told = F.when(F.col("item_id") % 2 == 1, F.to_json(F.struct(F.col("text").alias("prompt"), F.array(F.lit("yes"), F.lit("no")).alias("candidates")))).otherwise(F.col("text"))
    return tables.input_items(table(spark, d, "benchmark").select("item_id", told.alias("line")), "line")


@query("x30_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamped FROM events")
def x30(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("stamped"))


@query("s18_manifest", sql_rounded("SELECT o_orderstatus AS name, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1", "total", 0))
def s18(spark, d):
    import uuid

    path = f"{scratch(spark)}/manifest-{uuid.uuid4().hex}"
    own = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    tables.write_manifest(own, path, "name")
    return rounded(tables.read_manifest(spark, path, "name", "n: bigint, total: double"), 0)
