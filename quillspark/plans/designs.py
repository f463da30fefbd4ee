"""Queries on generated designs, sources, streams and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import labels
from quillspark.operators import design, models
from quillspark.plans.bindings import rounded, sql_rounded, table
from quillspark.plans.registry import query
from quillspark.session import scratch
from quillspark.sources import tables, wide
from quillspark.streaming import logs

# The designs' levels, in the order by which sampled points pick them.
LANGUAGES = ["bulgarian", "czech", "english", "french", "german", "italian", "persian", "polish", "portuguese", "romanian", "russian", "slovene", "spanish", "turkish"]
KEY_TYPES = ["numeric", "numeric_zero_index", "lowercase_start", "uppercase_start"]
PERSONAS = ["base", "libertarian_left", "libertarian_right", "authoritarian_left", "authoritarian_right", "centrism"]


def _u():
    return [F.get("u", F.lit(k)) for k in range(9)]


# Designs over the rows of a table, and the same points and factors as SQL.


def _points(name, key, d):
    return f"h AS (SELECT {key}, dim, sha256('42:' || dim || ':' || {key}) AS h FROM {name}, range({d}) t(dim)), pu AS (SELECT {key}, dim, (row_number() OVER (PARTITION BY dim ORDER BY h, {key}) - 1 + ('0x' || substr(h, 52, 13))::UBIGINT / 4503599627370496.0::DOUBLE) / count(*) OVER (PARTITION BY dim) AS u FROM h), pt AS (SELECT {key}, list(u ORDER BY dim) AS u FROM pu GROUP BY 1)"


def _level(k, n):
    return f"least(floor(u[{k + 1}] * {n}), {n - 1})::INT"


def _pick(k, values):
    return f"[{', '.join(repr(v) for v in values)}][{_level(k, len(values))} + 1]"


def _context(k, none="NULL"):
    return f"CASE WHEN u[{k + 1}] >= 0.5 THEN least(floor((u[{k + 1}] - 0.5) * 10), 4)::INT ELSE {none} END"


def _half(k, a, b):
    return f"CASE WHEN u[{k + 1}] < 0.5 THEN '{a}' ELSE '{b}' END"


def _design(name, key, d, **factors):
    return f"WITH {_points(name, key, d)} SELECT {key}, {', '.join(f'{v} AS {k}' for k, v in factors.items())} FROM pt"


_ORDER, _CLASS = ("question_first", "options_first"), ("short", "long")
_TARGETS = ["a", "b", "c", "d", "e"]


@query("g01_latin_hypercube", sql_rounded(f"WITH {_points('part', 'p_partkey', 8)} SELECT p_partkey, dim::INT AS dim, u FROM pu", "u", 9))
def g01(spark, d):
    return rounded(design.row_points(table(spark, d, "part"), "p_partkey", 8).select("p_partkey", F.posexplode("u").alias("dim", "u")), 9)


@query("g02_choice_design", _design("part", "p_partkey", 8, language=_pick(0, LANGUAGES), context_id=_context(1), instr_type=_half(2, *_ORDER), instr_idx=_level(3, 5), persona_class=_half(4, *_CLASS), persona_idx=_level(5, 5), key_type=_pick(6, KEY_TYPES), perm_id=_level(7, 4)))
def g02(spark, d):
    p = design.row_points(table(spark, d, "part"), "p_partkey", 8)
    return p.select("p_partkey", *[v.alias(k) for k, v in design.choice_factors(_u(), LANGUAGES, KEY_TYPES).items()])


_UNIT = "(p_partkey * {m} % 1009) / 1009.0::DOUBLE"


@query("g03_factor_mapping", f"WITH u AS (SELECT p_partkey, {_UNIT.format(m=7919)} AS a, {_UNIT.format(m=104729)} AS b FROM part) SELECT p_partkey, least(floor(a * 3), 2)::INT AS level3, CASE WHEN b >= 0.5 THEN least(floor((b - 0.5) * 10), 4)::INT END AS context_id, CASE least(floor(a * 3), 2)::INT WHEN 0 THEN 'english' WHEN 1 THEN 'french' ELSE 'german' END AS language FROM u")
def g03(spark, d):
    a, b = ((F.col("p_partkey") * m % 1009) / 1009.0 for m in (7919, 104729))
    return table(spark, d, "part").select("p_partkey", design.level(a, 3).alias("level3"), design.context(b).alias("context_id"), design.pick(a, ["english", "french", "german"]).alias("language"))


@query("g04_stance_design", _design("supplier", "s_suppkey", 7, context_id=_context(0), instr_type=_half(1, *_ORDER), instr_idx=_level(2, 5), persona_class=_half(3, *_CLASS), persona_idx=_level(4, 5), key_type=_pick(5, KEY_TYPES), perm_id=_level(6, 4)))
def g04(spark, d):
    p = design.row_points(table(spark, d, "supplier"), "s_suppkey", 7)
    return p.select("s_suppkey", *[v.alias(k) for k, v in design.stance_factors(_u(), KEY_TYPES).items()])


@query("g05_target_design", _design("customer", "c_custkey", 8, language="'english'", target=_pick(0, _TARGETS), context_id=_context(1, "-1"), instr_idx=_level(3, 10), persona_class=_half(4, *_CLASS), persona_idx=_level(5, 5)))
def g05(spark, d):
    p = design.row_points(table(spark, d, "customer"), "c_custkey", 8)
    return p.select("c_custkey", *[v.alias(k) for k, v in design.target_factors(_u(), _TARGETS).items()])


_CHAT = _design("orders", "o_orderkey", 9, language="'english'", suffix_idx=_level(0, 3), context_id=_context(1), instr_type=_half(2, *_ORDER), reasoning_mode=_pick(3, ["short", "neutral", "think"]), instr_idx=_level(4, 5), persona_class=_half(5, *_CLASS), persona_idx=_level(6, 5), key_type=_pick(7, KEY_TYPES), perm_id=_level(8, 4))


@query("g08_chat_design_with_variants", f"SELECT * FROM ({_CHAT}) CROSS JOIN (VALUES ('q8', 'think', 'q8_think'), ('q8', 'no_think', 'q8_no_think'), ('g4', NULL, 'g4')) m(model, generation_mode, model_variant)")
def g08(spark, d):
    p = design.row_points(table(spark, d, "orders"), "o_orderkey", 9).select("o_orderkey", *[v.alias(k) for k, v in design.chat_factors(_u(), "english", 3, ["short", "neutral", "think"], 5, KEY_TYPES).items()])
    m = spark.createDataFrame([("q8", ["think", "no_think"]), ("g4", None)], "model string, modes array<string>")
    return p.crossJoin(F.broadcast(design.variants(m, F.col("modes")).drop("modes")))


@query("g10_expected_items", "SELECT r_regionkey, count(*) AS expected, count(*) FILTER (WHERE (c_custkey, r_regionkey) NOT IN (SELECT o_custkey, o_orderkey % 5 FROM orders)) AS missing FROM customer, region GROUP BY 1")
def g10(spark, d):
    """Items that a design expects, a customer a config and a region a question, and those without a record."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("config_id"))
    expected = design.items(c, F.broadcast(table(spark, d, "region").select("r_regionkey")), "r_regionkey", 5)
    seen = table(spark, d, "orders").select((F.col("o_custkey") * 5 + F.col("o_orderkey") % 5).alias("item_uid")).distinct().withColumn("seen", F.lit(True))
    return expected.join(seen, "item_uid", "left").groupBy("r_regionkey").agg(F.count("*").alias("expected"), F.count_if(F.col("seen").isNull()).alias("missing"))


_MODELS = {"AUTOMOBILE": 2, "BUILDING": 0, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 1}


@query("g07_config_ids", "WITH m(model, k) AS (VALUES ('AUTOMOBILE', 2), ('BUILDING', 0), ('FURNITURE', 3), ('HOUSEHOLD', 4), ('MACHINERY', 1)) SELECT c_custkey, k * 100000 + row_number() OVER (PARTITION BY model ORDER BY c_custkey) - 1 AS config_id FROM customer JOIN m ON c_mktsegment = model")
def g07(spark, d):
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isin(list(_MODELS))).withColumnRenamed("c_mktsegment", "model")
    return design.with_config_id(c, _MODELS, 100000, ["c_custkey"]).select("c_custkey", "config_id")


@query("g06_crossed_design", "SELECT p_partkey, m.model, i.ideology, CASE WHEN i.ideology <> 'base' THEN p_size END AS persona_idx FROM part, (VALUES ('m1'), ('m2')) m(model), (VALUES ('base'), ('left')) i(ideology)")
def g06(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("persona_idx"))
    return design.crossed(p, ["m1", "m2"], ["base", "left"]).select("p_partkey", "model", "ideology", "persona_idx")


@query("g09_items", "SELECT c_custkey * 25 + n_nationkey AS item_uid, 'cfg' || c_custkey || '_q' || n_nationkey AS item_id FROM customer, nation")
def g09(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("config_id"))
    return design.items(c, F.broadcast(table(spark, d, "nation").select("n_nationkey")), "n_nationkey", 25).select("item_uid", "item_id")


@query("g11_round_robin_shards", "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 4)::INT AS shard FROM orders")
def g11(spark, d):
    return design.sharded(table(spark, d, "orders"), ["o_orderkey"], 4, ["o_orderstatus"]).select("o_orderkey", "shard")


@query("p02_names", "SELECT p_partkey, string_split('org/' || p_type, '/')[-1] AS short_name, regexp_replace(p_brand || CASE p_partkey % 3 WHEN 0 THEN '_no_think' WHEN 1 THEN '_think' ELSE '' END, '(_no_think|_think)$', '') AS base, CASE p_partkey % 3 WHEN 0 THEN 'no_think' WHEN 1 THEN 'think' ELSE 'standard' END AS method FROM part")
def p02(spark, d):
    variant = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "_no_think").when(F.col("p_partkey") % 3 == 1, "_think").otherwise(""))
    return table(spark, d, "part").select("p_partkey", labels.last_part(F.concat(F.lit("org/"), "p_type")).alias("short_name"), labels.base_name(variant).alias("base"), labels.method_of(variant).alias("method"))


@query("p03_size_labels", "SELECT p_partkey, p_size::DOUBLE AS size FROM part")
def p03(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.size_in_billions(F.concat(F.lit("m-"), F.col("p_size").cast("string"), F.lit("B-it"))).alias("size"))


@query("p08_combinations", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'base' ELSE p_brand || '_idx' || p_size END AS combo FROM part")
def p08(spark, d):
    kind = F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", labels.combination(kind, F.col("p_size"), "base").alias("combo"))


@query("p14_depth_relations", "SELECT p_partkey, CASE WHEN c IN (0, 1, 2) AND p_partkey % 2 = 0 THEN 'conflicting' WHEN c IN (0, 1, 2) AND p_partkey % 2 = 1 THEN 'congruent_short' WHEN c = -1 THEN 'no_context' WHEN c = 3 THEN 'anti_correction_context' WHEN c = 4 THEN 'spatial_context' END AS relation FROM (SELECT p_partkey, p_partkey % 6 - 1 AS c FROM part)")
def p14(spark, d):
    mode = F.when(F.col("p_partkey") % 2 == 0, "think").otherwise("short")
    return table(spark, d, "part").select("p_partkey", labels.depth_relation(F.col("p_partkey") % 6 - 1, mode).alias("relation"))


@query("p22_error_families", "SELECT event_type, CASE WHEN event_type = 'error' THEN 'worker_config_failed' ELSE 'success' END AS family, count(*) AS n FROM events GROUP BY ALL")
def p22(spark, d):
    message = F.when(F.col("event_type") == "error", "x worker_config_failed y")
    return table(spark, d, "events").groupBy("event_type", labels.error_family(message).alias("family")).agg(F.count("*").alias("n"))


_LOG = "(-(p_partkey % 700) / 100.0)"


@query("p25_p_value_text", f"WITH v AS (SELECT p_partkey, {_LOG}::DOUBLE AS l, 10.0::DOUBLE ** {_LOG}::DOUBLE AS p FROM part) SELECT p_partkey, CASE WHEN l > -4 THEN regexp_replace((CASE WHEN p >= 1 THEN round(p, 2) WHEN p >= 0.1 THEN round(p, 3) WHEN p >= 0.01 THEN round(p, 4) WHEN p >= 0.001 THEN round(p, 5) ELSE round(p, 6) END)::DECIMAL(12, 6)::VARCHAR, '\\.?0+$', '') ELSE '1e' || round_even(l, 0)::INT END AS p FROM v")
def p25(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.p_text(F.expr(_LOG).cast("double")).alias("p"))


# Sources and sinks: written to the shared folder and read again.


def _folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("s03_csv_null_rules", "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'None' WHEN r_regionkey % 3 = 0 THEN NULL ELSE 'NA' END AS factor FROM region")
def s03(spark, d):
    path = _folder(spark, "table") + ".csv"
    value = F.when(F.col("r_regionkey") % 2 == 0, "None").when(F.col("r_regionkey") % 3 == 0, F.lit(None)).otherwise("NA")
    table(spark, d, "region").select("r_regionkey", value.alias("factor")).write.options(header=True, nullValue="").csv(path)
    return tables.read_table(spark, path, "r_regionkey int, factor string")


@query("s04_csv_to_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s04(spark, d):
    source, target = _folder(spark, "nation") + ".csv", _folder(spark, "nation") + ".parquet"
    table(spark, d, "nation").write.option("header", True).csv(source)
    tables.convert(spark, source, target, "n_nationkey int, n_name string, n_regionkey int")
    return tables.read_table(spark, target)


@query("s05_jsonl_to_parquet", "SELECT c_custkey, c_name, [c_mktsegment, c_name] AS keys FROM customer")
def s05(spark, d):
    source, target = _folder(spark, "log") + ".jsonl", _folder(spark, "log") + ".parquet"
    table(spark, d, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", "c_name").alias("keys")).write.json(source)
    tables.convert(spark, source, target, "c_custkey long, c_name string, keys array<string>")
    return tables.read_table(spark, target)


@query("s08_lenient_log", "SELECT event_id, value FROM events WHERE event_id % 10 <> 0")
def s08(spark, d):
    path = _folder(spark, "log")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "value")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return tables.read_log(spark, path, "event_id long, value double", strict=False)


@query("s11_columns_from_file_names", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def s11(spark, d):
    path = _folder(spark, "results")
    for s in "FOP":  # a closed set of three files
        table(spark, d, "orders").where(F.col("o_orderstatus") == s).select("o_orderkey").write.parquet(f"{path}/results_{s}")
    both = spark.read.option("recursiveFileLookup", True).parquet(path)
    status = F.regexp_extract(F.col("_metadata.file_path"), r"results_(\w)/", 1)
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_ITEMS = 1665


@query("s12_wide_rows", f"SELECT i::INT AS item, count(*) AS n, round(sum(embedding[i % 64 + 1]::DOUBLE * (i + 1)), 4) + 0.0 AS total, count(DISTINCT label) AS labels, min('a,\"' || i || '\"') AS said FROM embeddings, range({_ITEMS}) t(i) GROUP BY i")
def s12(spark, d):
    """A CSV of 6,660 columns and the id, written in four files and read long."""
    path = _folder(spark, "wide")
    quoted = lambda i: F.concat(F.lit('"a,""'), i.cast("string"), F.lit('"""'))
    e = table(spark, d, "embeddings")
    item = lambda i: F.concat_ws(",", (F.get("embedding", i % 64).cast("double") * (i + 1)).cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("")), quoted(i), F.lit(""))
    line = F.concat_ws(",", F.col("vec_id").cast("string"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_ITEMS - 1)), item), ","))
    header = ",".join(["vec_id", *[f"q{i}_{s}" for i in range(_ITEMS) for s in ("value", "label", "said", "none")]])
    wide.lines(e.select("vec_id", "embedding", "label"), header, line, F.pmod("vec_id", F.lit(4)), 4).write.text(path)
    rows, names = wide.wide_rows(spark, wide.expected_files(spark, path, "part-*", 4))
    long = wide.unfolded(rows, names, {"vec_id": "long"}, r"q(\d+)_(\w+)", {"value": "double", "label": "int", "said": "string"})
    out = long.groupBy("item").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.countDistinct("label").alias("labels"), F.min("said").alias("said"))
    return rounded(out, 4)


@query("s16_append_sink", "SELECT n_nationkey, n_name FROM nation")
def s16(spark, d):
    path = _folder(spark, "appended")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    for k in range(2):
        tables.append_csv(n.where(F.col("n_nationkey") % 2 == k), path)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(path)


@query("s23_manifest")
def s23(spark, d):
    return tables.files_of(spark, f"{d}/nation.parquet")


@query("p01_numeric_projection", "SELECT event_id, value, event_type = 'error' AS has_error FROM events")
def p01(spark, d):
    e = table(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", "failed"))
    return tables.numeric_projection(e, ["event_id", "value"])


# Streams.


@query("e03_streaming_latest_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def e03(spark, d):
    source, folder = _folder(spark, "stream"), _folder(spark, "latest")
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    events.repartition(4, F.col("event_id") % 4).write.parquet(source)
    stream = logs.read_stream(spark, source, events.schema)
    return logs.keep_latest(stream, folder, f"{folder}/log", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("e02_streaming_resume", "SELECT DISTINCT user_id, event_type FROM events")
def e02(spark, d):
    source, folder = _folder(spark, "stream"), _folder(spark, "appended")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    events.repartition(3, F.col("event_id") % 3).write.parquet(source)
    logs.append_new(logs.read_stream(spark, source, events.schema), folder, f"{folder}-log", ["user_id", "event_type"])
    return spark.read.parquet(folder).select("user_id", "event_type")


@query("e01_log_by_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def e01(spark, d):
    """A log of JSON lines, a folder for each type, written by two runs of which the second goes on where the first ended."""
    source, folder = _folder(spark, "stream"), _folder(spark, "log")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for k in range(2):
        events.where(F.pmod("event_id", F.lit(2)) == k).write.mode("append").parquet(source)
        logs.append_new(logs.read_stream(spark, source, events.schema), folder, f"{folder}-log", ["user_id", "event_type"], ["event_type"], "json")
    return spark.read.schema("event_id long, user_id long, event_type string").json(folder).groupBy("event_type").agg(F.count("*").alias("users"))


@query("e04_attempts", "SELECT user_id, count(*) AS attempts, bool_or(event_type <> 'error') AS done, NOT bool_or(event_type <> 'error') AND count(*) >= 3 AS given_up FROM events GROUP BY 1")
def e04(spark, d):
    e = table(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", "failed"))
    return logs.attempts(e, ["user_id"], "error", 3)


@query("e05_running_counts", "SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def e05(spark, d):
    source, name = _folder(spark, "stream"), f"running_{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "failed").alias("error"))
    e.repartition(2, F.col("event_id") % 2).write.parquet(source)
    logs.drained(logs.running_counts(logs.read_stream(spark, source, e.schema), ["event_type"], "error", name))
    return spark.table(name)


@query("e06_progress", "SELECT count(*) AS rows, 3 AS batches, count(*) AS rows_so_far FROM events")
def e06(spark, d):
    """What a listener recorded of a stream of three files: rows of its batches, and so far at the last."""
    source, folder = _folder(spark, "stream"), _folder(spark, "progress")
    e = table(spark, d, "events").select("event_id", "event_type")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = logs.read_stream(spark, source, e.schema)
    found = logs.watched(spark, lambda: stream.writeStream.format("noop").option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start(), folder, e.count())
    return found.where("rows > 0").agg(F.sum("rows").alias("rows"), F.count("*").cast("int").alias("batches"), F.max("rows_so_far").alias("rows_so_far"))


# Models.


@query("m01_principal_components")
def m01(spark, d):
    e = models.principal_components(table(spark, d, "embeddings"), "embedding", 5)
    return rounded(e.select("vec_id", F.posexplode("pca").alias("component", "score")), 4)


@query("m02_grouped_classification")
def m02(spark, d):
    e = table(spark, d, "embeddings").withColumn("grp", F.pmod("vec_id", F.lit(10)))
    return rounded(models.grouped_classification(e, "embedding", "label", "grp", 3, 20), 4)


_MI = "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c)"


@query("m05_mutual_information", sql_rounded(f"{_MI} SELECT sum(n)::BIGINT AS n, sum(n / t::DOUBLE * ln(n * t::DOUBLE / (na * nb))) AS mi, sum(-n / t::DOUBLE * ln(na / t::DOUBLE)) AS entropy_a, sum(-n / t::DOUBLE * ln(nb / t::DOUBLE)) AS entropy_b, 2 * sum(n / t::DOUBLE * ln(n * t::DOUBLE / (na * nb))) / (sum(-n / t::DOUBLE * ln(na / t::DOUBLE)) + sum(-n / t::DOUBLE * ln(nb / t::DOUBLE))) AS nmi FROM p", "mi entropy_a entropy_b nmi"))
def m05(spark, d):
    c = models.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(models.mutual_information(c, "o_orderstatus", "o_orderpriority"))


@query("m05_adjusted_information")
def m05_adjusted(spark, d):
    c = models.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(models.adjusted_information(c, "o_orderstatus", "o_orderpriority"))
