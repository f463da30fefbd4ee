"""Queries on texts, hashes, samples and phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import phrases, runs, sampling
from quillspark.plans.bindings import rounded, sql_rounded, table
from quillspark.plans.registry import query
from quillspark.sources.scratch import stored


def _docs(spark, d):
    return table(spark, d, "documents")


@query("x01_squeezed_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM documents")
def x01(spark, d):
    return _docs(spark, d).select("doc_id", text.squeezed(F.col("text")).alias("squeezed"))


_TRACE = "CASE doc_id % 3 WHEN 0 THEN '<think>' || left(text, 40) || '</think> ' || substr(text, 41) WHEN 1 THEN 'a <think>' || text ELSE text END"


@query("x02_hidden_and_visible", f"WITH t AS (SELECT doc_id, {_TRACE} AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(regexp_extract(t, '(?s)<think>(.*?)</think>', 1), ' \t\n') WHEN doc_id % 3 = 1 THEN trim(regexp_extract(t, '(?s)<think>(.*)$', 1), ' \t\n') ELSE '' END AS hidden, doc_id % 3 <> 2 AS has_hidden FROM t")
def x02(spark, d):
    t = _docs(spark, d).select("doc_id", F.expr(_TRACE).alias("t")).withColumn("s", text.hidden_and_visible(F.col("t")))
    return t.select("doc_id", F.btrim("s.hidden", F.lit(" \t\n")).alias("hidden"), "s.has_hidden")


@query("x03_word_counts", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z'']+')) AS words FROM documents")
def x03(spark, d):
    return _docs(spark, d).select("doc_id", text.word_count(F.col("text"), text.ASCII_WORD).cast("long").alias("words"))


@query("x04_last_lines", "SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), -2, -1), chr(10)) AS tail FROM documents")
def x04(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(text.last_lines(F.col("text"), 2), "\n").alias("tail"))


#: How a stance line begins.
PREFIXES = ["stance:", "answer:", "final answer:", "position:", "choice:"]


@query("x05_rationale", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS rationale FROM documents")
def x05(spark, d):
    t = F.concat(F.lit("Stance: x\n"), F.col("text"), F.lit("\nQQ statement QQ\n Answer: no"))
    return _docs(spark, d).select("doc_id", text.rationale(t, F.lit("QQ statement QQ"), PREFIXES).alias("rationale"))


_LEXICON = [r"\bthe\b", r"\band\b", r"\bof\b"]
_HITS = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in _LEXICON)


@query("x06_lexicon", sql_rounded(f"WITH c AS (SELECT doc_id, {_HITS} AS count, len(regexp_extract_all(text, '[A-Za-z'']+')) AS words FROM documents) SELECT doc_id, count, count > 0 AS present, coalesce(count * 100.0::DOUBLE / nullif(words, 0), 0) AS per_100_words FROM c", "per_100_words"))
def x06(spark, d):
    words = text.word_count(F.col("text"), text.ASCII_WORD)
    found = text.lexicon(F.col("text"), [f"(?i){p}" for p in _LEXICON], words)
    return rounded(_docs(spark, d).select("doc_id", found["count"].cast("long").alias("count"), found["present"].alias("present"), found["per_100_words"].alias("per_100_words")))


@query("x07_marker_counts", "SELECT doc_id, len(regexp_extract_all(text, '[.!?]')) AS sentences, len(regexp_extract_all(text, '(?i)[^A-Za-z]not?[^A-Za-z]')) AS negations FROM documents")
def x07(spark, d):
    c = F.regexp_count(F.col("text"), F.lit("[.!?]")).cast("long")
    return _docs(spark, d).select("doc_id", c.alias("sentences"), F.regexp_count("text", F.lit(r"(?i)[^A-Za-z]not?[^A-Za-z]")).cast("long").alias("negations"))


@query("x08_token_counts", "SELECT lang, lower(w) AS token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z'']+')) AS w FROM documents) GROUP BY ALL")
def x08(spark, d):
    return _docs(spark, d).select("lang", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


_VOCABULARY = ["the", "and", "que", "der", "los"]
_V = "[" + ", ".join(f"'{v}'" for v in _VOCABULARY) + "]"


@query("x09_vocabulary_overlap", sql_rounded(f"SELECT doc_id, len(list_intersect(list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)), {_V})) AS overlap, len(list_intersect(list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)), {_V})) / 5::DOUBLE AS share FROM documents", "share"))
def x09(spark, d):
    both, share = text.vocabulary_overlap(text.tokens(F.col("text")), F.array(*map(F.lit, _VOCABULARY)))
    return rounded(_docs(spark, d).select("doc_id", both.cast("long").alias("overlap"), share.alias("share")))


@query("x10_templates", "SELECT item_id, 'Item ' || item_id || ':' || chr(10) || chr(10) || text AS prompt FROM benchmark")
def x10(spark, d):
    t = text.filled(F.lit("Item {id}:\n\n{text}"), {"id": F.col("item_id").cast("string"), "text": F.col("text")})
    return table(spark, d, "benchmark").select("item_id", t.alias("prompt"))


@query("x11_permuted_options", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN '1. no' || chr(10) || '2. yes' WHEN 1 THEN '2. no' || chr(10) || '1. yes' WHEN 2 THEN '1. yes' || chr(10) || '2. no' ELSE '2. yes' || chr(10) || '1. no' END AS options FROM benchmark")
def x11(spark, d):
    keys, labels = F.array(F.lit("1"), F.lit("2")), F.array(F.lit("no"), F.lit("yes"))
    return table(spark, d, "benchmark").select("item_id", text.options(keys, labels, F.col("item_id") % 4).alias("options"))


#: Texts' ends, and the stance that each states.
_SAID = [("Stance: strongly agree", 3), ("I disagree.\nAnswer: 2", 1), ("So I agree.\nOr no: 1. Strongly disagree", 0), ("On balance\n3)", 2)]


@query("x12_explicit_stances", f"SELECT conv_id, turn, CASE turn % 4 {' '.join(f'WHEN {k} THEN {v}' for k, (_, v) in enumerate(_SAID))} END AS stance FROM conversations WHERE text IS NOT NULL")
def x12(spark, d):
    from quillspark.functions.stance import explicit_stance

    c = table(spark, d, "conversations").where("text is not null")
    said = F.element_at(F.array(*[F.lit(x) for x, _ in _SAID]), (F.col("turn") % 4 + 1).cast("int"))
    return c.select("conv_id", "turn", explicit_stance(F.concat("text", F.lit("\n"), said), ["1", "2", "3", "4"], ["strongly disagree", "disagree", "agree", "strongly agree"]).alias("stance"))


@query("x13_salted_hashes", "SELECT doc_id, substr(sha256('salt' || chr(31) || doc_id::VARCHAR), 1, 16) AS h FROM documents")
def x13(spark, d):
    return _docs(spark, d).select("doc_id", text.salted_hash(F.lit("salt"), F.col("doc_id").cast("string")).alias("h"))


@query("x14_prompt_hash", "SELECT item_id, sha1(text) AS h FROM benchmark")
def x14(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha1("text").alias("h"))


@query("x15_content_hash", "SELECT doc_id, substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 20) AS h FROM documents")
def x15(spark, d):
    return _docs(spark, d).select("doc_id", text.content_hash(F.col("text")).alias("h"))


@query("t06_stratified_sample", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('q' || chr(31) || doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 3")
def t06(spark, d):
    return sampling.stratified(_docs(spark, d), ["lang", "source"], F.col("doc_id").cast("string"), "q", 3).select("doc_id", "lang", "source")


@query("t07_hash_shards", "SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 7)::INT AS shard FROM documents")
def t07(spark, d):
    return _docs(spark, d).select("doc_id", text.hash_shard(text.salted_hash(F.col("doc_id").cast("string")), 7).alias("shard"))


_HALF = "CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT % 2 = 0 THEN 'discovery' ELSE 'confirmation' END"


@query("t08_hash_halves", f"SELECT doc_id, {_HALF} AS half FROM documents")
def t08(spark, d):
    return _docs(spark, d).select("doc_id", text.hash_half(F.col("doc_id").cast("string")).alias("half"))


@query("r07_representations", "SELECT conv_id, turn, representation, text FROM (SELECT conv_id, turn, 'text' AS representation, text FROM conversations UNION ALL SELECT conv_id, turn, 'role', role FROM conversations) WHERE length(trim(text)) > 0")
def r07(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", "role")
    return sampling.representations(rows, ["conv_id", "turn"], ["text", "role"])


_GRAMS = """ws AS (SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)), lambda x: length(x) >= 2) AS w FROM documents),
wr AS (SELECT doc_id, lang, list_transform(w, lambda t: CASE WHEN t IN ('the', 'of') THEN '<redacted>' ELSE t END) AS w FROM ws),
gr AS (SELECT DISTINCT doc_id, lang, g FROM (SELECT doc_id, lang, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]), list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])))) AS g FROM wr) WHERE NOT contains(g, '<redacted>') AND NOT regexp_full_match(g, '(and|in|to)( (and|in|to))*'))"""
_STOP = ["and", "in", "to"]


@query("k04_document_phrases", f"WITH {_GRAMS} SELECT doc_id, count(*) AS phrases FROM gr GROUP BY 1")
def k04(spark, d):
    p = phrases.document_phrases(F.col("text"), 3, F.array(F.lit("the"), F.lit("of")), _STOP)
    return phrases.with_phrases(_docs(spark, d), p, "doc_id").select("doc_id", F.size("phrases").cast("long").alias("phrases")).where("phrases > 0")


def _facts():
    """Scopes, half and label of a document, and its size."""
    return [F.lit("all"), F.concat(F.lit("source::"), F.col("source"))], text.hash_half(F.col("doc_id").cast("string")), F.col("lang"), F.octet_length("text")


def _phrases(spark, d, **kept):
    p = phrases.document_phrases(F.col("text"), 3, F.array(F.lit("the"), F.lit("of")), _STOP)
    return phrases.phrase_counts(_docs(spark, d), p, *_facts(), **kept)


_PHRASES = f"{_GRAMS}, sc AS (SELECT d.doc_id, d.lang, {_HALF.replace('doc_id', 'd.doc_id')} AS half, s.scope FROM documents d, (VALUES (0)) v(x), LATERAL (SELECT unnest(['all', 'source::' || d.source]) AS scope) s), tot AS (SELECT scope, half, lang AS label, count(*) AS total FROM sc GROUP BY ALL), cnt AS (SELECT scope, half, gr.lang AS label, g AS phrase, count(*) AS df FROM gr JOIN sc ON gr.doc_id = sc.doc_id GROUP BY ALL)"


@query("k05_phrase_frequencies", f"WITH {_PHRASES} SELECT * FROM cnt")
def k05(spark, d):
    words = phrases.known_words(F.col("text"), F.array(F.lit("the"), F.lit("of")))
    return runs.run_counts(_docs(spark, d), words, 3, _STOP, *_facts())


_FOUND = f"{_PHRASES}, p AS (SELECT scope, phrase, sum(df) AS total_df FROM cnt WHERE half = 'discovery' GROUP BY ALL), e AS (SELECT scope, sum(total) AS every FROM tot WHERE half = 'discovery' GROUP BY 1), x AS (SELECT t.scope, t.label, p.phrase, coalesce(c.df, 0) AS tdf, t.total AS tt, p.total_df - coalesce(c.df, 0) AS odf, e.every - t.total AS ot FROM p JOIN tot t ON t.scope = p.scope AND t.half = 'discovery' JOIN e ON e.scope = p.scope LEFT JOIN cnt c ON c.scope = p.scope AND c.half = 'discovery' AND c.label = t.label AND c.phrase = p.phrase WHERE p.total_df >= 5), y AS (SELECT *, ln((tdf + 0.5) / (greatest(0, tt - tdf) + 0.5)) - ln((odf + 0.5) / (greatest(0, ot - odf) + 0.5)) AS lo FROM x)"


@query("k06_discovered_phrases", sql_rounded(f"WITH {_FOUND} SELECT scope, label, phrase, lo AS discovery_log_odds, r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY scope, label ORDER BY lo DESC, phrase DESC) AS r FROM y) WHERE r <= 10", "discovery_log_odds"))
def k06(spark, d):
    return rounded(phrases.discovered(*_phrases(spark, d, least=5), 5, 10))


@query("k06_confirmed_phrases")
def k06_confirmed(spark, d):
    found = stored(phrases.discovered(*_phrases(spark, d, least=5), 5, 10), "phrases-found")
    return rounded(phrases.confirmed(*_phrases(spark, d, only=found), found, 3))


@query("k07_embedding_queue", "WITH s AS (SELECT doc_id, text, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('q' || chr(31) || doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 5 UNION SELECT doc_id, text, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), rep AS (SELECT doc_id, 'text' AS representation, text FROM s UNION ALL SELECT doc_id, 'source', source FROM s), q AS (SELECT *, substr(sha256(doc_id::VARCHAR || chr(31) || representation), 1, 16) AS queue_id FROM rep WHERE length(trim(text)) > 0) SELECT *, (('0x' || queue_id)::UBIGINT % 4)::INT AS shard FROM q")
def k07(spark, d):
    always = table(spark, d, "labels").where("toxic = 1")
    return sampling.embedding_queue(_docs(spark, d), ["lang"], "doc_id", "q", 5, always, ["text", "source"], 4)
