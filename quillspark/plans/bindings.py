"""The driver's tables in the roles that operators take, in Spark and as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.arrays import softmax


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero: sums hang on their order beyond that."""
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def sql_rounded(sql: str, doubles: str, digits: int = 6) -> str:
    """The same in SQL for the named columns."""
    body, ctes = sql.strip(), ""
    if body.upper().startswith("WITH "):
        # The last top-level SELECT is the result; what stands before it stays in front.
        depth, at = 0, 0
        for k, c in enumerate(body):
            depth += (c == "(") - (c == ")")
            if depth == 0 and body[k : k + 7].upper() == "SELECT ":
                at = k
                break
        ctes, body = body[:at], body[at:]
    changed = ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in doubles.split())
    return f"{ctes} SELECT * REPLACE ({changed}) FROM ({body})"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Scored documents: model (language), target (source), gold, and a p that the id's hash gives."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    p = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 4), 16, 10).cast("double") / 65536
    return docs.select("doc_id", "lang", "source").join(labels, "doc_id").select("doc_id", F.col("lang").alias("model"), F.col("source").alias("target"), (F.col("toxic") == 1).alias("gold"), p.alias("p"))


PREDICTIONS = "pred AS (SELECT d.doc_id, d.lang AS model, d.source AS target, (l.toxic = 1) AS gold, ('0x' || substr(sha256(d.doc_id::VARCHAR), 1, 4))::INT / 65536::DOUBLE AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def stances(spark: SparkSession, d: str) -> DataFrame:
    """Events as two-label predictions: model (type), config (day), item (user), gold, predicted, confidence."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("event_type").alias("model"), F.to_date("ts").alias("config"), F.col("user_id").alias("item"), (F.col("user_id") % 30).alias("topic"), (F.col("value") >= 25).alias("gold"), (k >= 50).alias("predicted"), (F.greatest(k, 100 - k) / 100.0).cast("double").alias("confidence"))


STANCES = "st AS (SELECT event_id, event_type AS model, ts::DATE AS config, user_id AS item, user_id % 30 AS topic, value >= 25 AS gold, (props::JSON->>'$.k')::INT >= 50 AS predicted, greatest((props::JSON->>'$.k')::INT, 100 - (props::JSON->>'$.k')::INT) / 100::DOUBLE AS confidence FROM events)"

FACTORS = ["l_linestatus", "o_orderstatus", "c_mktsegment", "l_linenumber"]


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Config scores with factors: model, stratum (priority), block, four factors, two scores, blur."""
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    li = li.select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("l_returnflag").alias("model"), F.col("o_orderpriority").alias("stratum"), (F.col("c_nationkey") % 5).alias("block"), "l_linestatus", "o_orderstatus", "c_mktsegment", "l_linenumber", F.col("l_quantity").alias("score"), (F.col("l_discount") * 100).alias("score2"), (F.col("l_tax") * (1 - F.col("l_tax"))).alias("blur"))


SCORES = "sc AS (SELECT l_returnflag AS model, o_orderpriority AS stratum, c_nationkey % 5 AS block, l_linestatus, o_orderstatus, c_mktsegment, l_linenumber, l_quantity AS score, l_discount * 100 AS score2, l_tax * (1 - l_tax) AS blur FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answer distributions: an embedding as 16 items of 4 answers, each a softmax; perm from the id."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    probs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: softmax(F.slice(F.col("x"), k * 4 + 1, F.lit(4))))
    return e.select("vec_id", "label", F.pmod("vec_id", F.lit(4)).cast("int").alias("perm"), probs.alias("probs"))


_SLICE = "list_transform(list_slice(embedding, 4 * i + 1, 4 * i + 4), lambda v: v::DOUBLE)"
ANSWERS = f"""raw AS (SELECT vec_id, label, (vec_id % 4)::INT AS perm, i AS item, {_SLICE} AS x FROM embeddings, range(16) t(i)),
expd AS (SELECT vec_id, label, perm, item, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM raw),
ans AS (SELECT vec_id, label, perm, item, list_transform(e, lambda v: v / list_sum(e)) AS p FROM expd)"""


def item_answers(spark: SparkSession, d: str) -> DataFrame:
    """The distributions long: a row per item."""
    return answers(spark, d).select("vec_id", "label", "perm", F.posexplode("probs").alias("item", "p"))


def scorer(spark: SparkSession) -> DataFrame:
    """Fixed integer weights of 16 items on two axes; every fourth item has none, others vary on one axis."""
    rows = []
    for k in range(16):
        w = [float((k % 5 + 1) * v) for v in (-3, -1, 1, 3)]
        zero = [0.0] * 4
        rows.append((k, zero if k % 4 == 3 or k % 2 else w, w[::-1] if k % 4 == 1 else zero))
    return spark.createDataFrame(rows, "item int, economic array<double>, social array<double>")


SCORER = """scorer AS (SELECT i::INT AS item,
  CASE WHEN i % 4 = 3 OR i % 2 = 1 THEN [0.0, 0, 0, 0]::DOUBLE[] ELSE list_transform([-3, -1, 1, 3], lambda v: (v * (i % 5 + 1))::DOUBLE) END AS economic,
  CASE WHEN i % 4 = 1 THEN list_transform([3, 1, -1, -3], lambda v: (v * (i % 5 + 1))::DOUBLE) ELSE [0.0, 0, 0, 0]::DOUBLE[] END AS social FROM range(16) t(i))"""


def order_sides(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as conditions: key (customer, priority), side (status), mean price, large flag."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"), F.max((F.col("o_totalprice") > 250000).cast("int")).alias("large"), F.count("*").alias("n"))


ORDER_SIDES = "os AS (SELECT o_custkey, o_orderpriority, o_orderstatus, avg(o_totalprice) AS price, max((o_totalprice > 250000)::INT) AS large, count(*) AS n FROM orders GROUP BY ALL)"
