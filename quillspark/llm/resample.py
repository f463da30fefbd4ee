"""Operator 12, target-distribution importance resampling by hashed word features.

The raw corpus and the target texts are counted in buckets of hashed runs of words. A bucket's gain is how much more
likely the target makes it; a document's weight is the mean gain of its features, and its score that weight plus
Gumbel noise from its id's hash, so that the highest scores are a draw without replacement by weight.

The gains are one array, which scores the texts in a second reading. The draw's limit is found by a radix selection:
the composite key (score falling, id rising) is read digit by digit, each pass counting the rows that share the
prefix found so far by their next digit, until the key of the last row drawn is known. Only rows up to it are sorted by
range and ranked, by their place in their partition and the partitions' sizes.

Defined cases: null or empty text has no features, weight 0; a null id is hashed as empty text and stands behind all
others of its score; rows of equal id and score are drawn in any order, as many as are due; an empty table gives no
rows; an empty target gives gains by smoothing alone; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.tokens import byte_table, byte_words

_ALNUM = byte_table(lambda c: 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80)
_HALF = 1 << 63
#: A digit's counts come to the driver: at most so many rows, for any input.
_DIGIT = 12


def buckets(text: bytes, number: int, longest: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """For each part of a text its words and the buckets of the runs of 1 to ``longest`` words that end in it."""
    ended: list[list[int]] = [[] for _ in range(longest)]
    for words in byte_words(text, _ALNUM):
        spaced = [b" " + w for w in words]
        now = list(map(crc32, words))
        found = list(now)
        for k in range(longest - 1):
            # Each run goes on with the word after the one that it ends with.
            runs = ended[k] + now
            ended[k] = runs[-1:]
            now = list(map(crc32, spaced[1 - len(runs) :], runs[:-1])) if len(runs) > 1 else []
            found += now
        yield len(words), np.array(found, np.uint32) % np.uint32(number)


def counts(texts: DataFrame, text_col: str, number: int, longest: int = 2) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(number, np.int64)
        for b in batches:
            for text in b.column(0):
                for _, found in buckets(text.as_py() or b"", number, longest):
                    total += np.bincount(found, minlength=number)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "bucket int, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(number, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    s, t, size = raw.astype(float), target.astype(float), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weights(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, longest: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    told = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = told.value
        for b in batches:
            words, features, sums = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, text in enumerate(b.column(1)):
                for n, found in buckets(text.as_py() or b"", len(gain), longest):
                    words[i] += n
                    features[i] += len(found)
                    sums[i] += gain[found].sum()
            weight = np.floor_divide(sums, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the id's hash, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The ``k``-th smallest composite of long ``keys``: ``k`` from 1, at most the number of rows.

    Leading bits that all rows have in common are skipped; each pass counts the rows with the prefix so far by one digit.
    """
    bounds = rows.agg(*[x for c in keys for x in (F.min(c), F.max(c))]).first()
    key: list[int] = []
    held, left = F.lit(True), k
    for i, c in enumerate(keys):
        value = F.col(c).bitwiseXOR(F.lit(-_HALF))
        low, high = (x + _HALF for x in bounds[2 * i : 2 * i + 2])
        bits = -(-(low ^ high).bit_length() // _DIGIT) * _DIGIT
        prefix = low >> bits
        while bits:
            same = held & (F.shiftrightunsigned(value, bits) == prefix) if bits < 64 else held
            bits -= _DIGIT
            digit = F.shiftrightunsigned(value, bits).bitwiseAND(F.lit((1 << _DIGIT) - 1))
            for found, n in sorted(rows.where(same).groupBy(digit.alias("digit")).count().collect()):
                if n >= left:
                    break
                left -= n
            prefix = prefix << _DIGIT | found
        key.append(prefix - _HALF)
        held = held & (F.col(c) == key[-1])
    return key


def up_to(keys: list[str], key: list[int]) -> Column:
    """Rows whose composite isn't larger than ``key``."""
    out = F.lit(True)
    for c, x in zip(reversed(keys), reversed(key), strict=True):
        out = (F.col(c) < x) | ((F.col(c) == x) & out)
    return out


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` from 1 in order of the keys: sorted by range, each partition after those before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)])
    # A row a partition.
    offsets = rows.sparkSession.createDataFrame([(int(p), int(n)) for (p, _), n in zip(sizes, before, strict=False)], "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", place).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, least_words: int = 20, number: int = 10_000, longest: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the documents of ``least_words`` or more are ranked, others have none."""
    gain = gains(counts(docs, text_col, number, longest), counts(target, target_col, number, longest))
    keys = ["key_score", "key_null", "key_id"]
    scored = weights(docs, id_col, text_col, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumns({"key_score": -F.col("score"), "key_null": F.col("doc_id").isNull().cast("long"), "key_id": F.coalesce("doc_id", F.lit(0))})
    scored = stored(scored, "resample-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    k = percent * fit.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & up_to(keys, kth_key(fit, keys, k))
    # Rows equal to the last one in every key can be more than are due.
    first = ranked(scored.where(drawn), keys, "resample-drawn").select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return first.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    """The query: a quarter of the documents of 20 words or more, towards the benchmark's texts."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CRC = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) r(i)))"
_FEATURES = """SELECT {id}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"""

#: Features are counted by their text first, so that each text's crc32 is folded once.
ORACLE_SQL = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
runs AS MATERIALIZED (SELECT r, f, count(*) AS n FROM ({_FEATURES.format(id="r", table="docs")}) GROUP BY ALL),
aims AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_FEATURES.format(id="item_id", table="benchmark")}) GROUP BY f),
crc AS MATERIALIZED {_CRC},
told AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda x, y: xor(t[xor(x % 256, y) + 1], x // 256)), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM (SELECT f FROM runs UNION ALL SELECT f FROM aims)), crc),
raw AS (SELECT b, sum(n) AS s FROM runs JOIN told USING (f) GROUP BY b),
aim AS (SELECT b, sum(n) AS t FROM aims JOIN told USING (f) GROUP BY b),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM raw) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM aim) + 10000)::DOUBLE)))::BIGINT AS g FROM raw LEFT JOIN aim USING (b)),
mean AS (SELECT r, sum(n) AS n, floor(sum(n * g) / sum(n)::DOUBLE)::BIGINT AS w FROM runs JOIN told USING (f) JOIN gain USING (b) GROUP BY r),
scored AS MATERIALIZED (SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0) AS weight, coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN mean USING (r)),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS all_fit FROM scored WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * all_fit // 100 THEN k END AS rank FROM scored LEFT JOIN fit USING (r)"""
