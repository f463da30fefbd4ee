"""Operator 13, LM scoring: the marginal probability of texts under a subword lattice.

Texts are tokens: words between white space, A-Z in lower case, and one end. A word's probability is a lattice's sum
over all its segmentations, by a forward recursion in log space (:mod:`quillspark.llm.lattice`): paths of pieces of an
existing vocabulary, and one edge over the whole word if training documents hold it. The whole-word edge has the word's
share of a class's training tokens; the paths of pieces share what Good and Turing leave to unseen words (tokens of
words seen once, over all). Documents have classes (a language column), a text's probability is their mixture. Both
parts and the mixture are normalised, so ``score`` is the log10 of a probability over all texts.

Scores of a ``unigram`` vocabulary weight its pieces as they are. The given file is of the ``bpe`` kind, whose scores
are ranks of merges and no logarithms, so its pieces start from weights by rank (Zipf) and ``rounds`` steps of
expectation maximisation over the distinct training words set them; pieces are neither added nor dropped.

One scan of the texts makes, for each block of rows, its distinct words with their training counts by class, and the
documents as numbers of those words. Words are shuffled once, where a window sums their counts; every distinct word
meets the lattice once a batch; weights return to their blocks as compressed arrays. A frequent word costs a row a block.

Defined cases: null or empty text is its end alone; null ids aren't held out, repeated ones are rows like others; null
classes, and those beyond the ``classes`` most frequent, are one class more; without training documents the pieces'
starting weights score alone; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored
from quillspark.llm.lattice import Vocabulary, expected_uses, log_likelihoods
from quillspark.llm.pieces import default_model
from quillspark.llm.tokens import byte_table, byte_words

_LOWER = byte_table(lambda c: c != 32 and not 9 <= c <= 13)
_LN10 = math.log(10)
#: Rows of weights that a task gathers before it sends them to their blocks.
_SENT = 2_000_000


class _Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


@dataclass
class Classes:
    """Training figures by class: documents, word tokens, distinct words and words seen once; over all: ``distinct`` words."""

    documents: np.ndarray
    tokens: np.ndarray
    once: np.ndarray
    distinct: int

    @property
    def prior(self) -> np.ndarray:
        return (self.documents + 0.5) / (self.documents + 0.5).sum()

    @property
    def unseen(self) -> np.ndarray:
        """The mass of words that training hasn't seen."""
        return (self.once + 0.5) / (self.tokens + 1)

    @property
    def end(self) -> np.ndarray:
        return (self.documents + 0.5) / (self.documents + self.tokens + 1)

    @property
    def all_tokens(self) -> int:
        """With ends."""
        return int(self.tokens.sum() + self.documents.sum())

    @property
    def all_distinct(self) -> int:
        """With the end."""
        return self.distinct + (self.documents.sum() > 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of add-one probabilities of tokens with such counts."""
        return np.log10((counts + 1) / (self.all_tokens + self.all_distinct + 1))

    def words(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """Log probability of each word in each class, from its counts by class and its log probability by pieces."""
        with np.errstate(divide="ignore"):
            whole = np.log(counts) + np.log1p(-self.unseen) - np.log(np.maximum(self.tokens, 1))
        return np.logaddexp(whole, np.log(self.unseen) + lattice[:, None]) + np.log1p(-self.end)


def load(path: str, kind: str) -> tuple[Vocabulary, np.ndarray]:
    """A model's pieces, and the log weights that they start from."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    own = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
    vocabulary = Vocabulary([model.id_to_piece(i) if ok else None for i, ok in zip(ids, own, strict=True)], {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}, model.unk_id())
    scores = np.array([model.get_score(i) for i in ids])
    if kind == "bpe":
        rank = np.argsort(np.argsort(-scores, kind="stable"))
        weight = 1.0 / (rank + 10)
        scores = np.log(weight / weight.sum())
    return vocabulary, scores


def _remainder(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def blocks_of(rows: DataFrame, classes: int, block_bytes: int) -> DataFrame:
    """From (id, text, held_out, class): a block's words (block, k, word, class, n) and its documents (block, docs), in one table."""
    schema = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64()), ("docs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        words, docs = _Numbers(), []
        seen: list[array] = [array("i") for _ in range(classes)]

        def out() -> Iterator[pa.RecordBatch]:
            block = (part << 32) + number
            names = list(words)
            counts = [np.bincount(np.frombuffer(x, np.int32), minlength=len(names)) if len(x) else np.zeros(len(names), int) for x in seen]
            unseen = np.flatnonzero(sum(counts) == 0)
            for c, own in [*enumerate(counts), (0, None)]:
                where = unseen if own is None else np.flatnonzero(own)
                n = np.zeros(len(where), int) if own is None else own[where]
                for lo in range(0, len(where), 50_000):
                    some = where[lo : lo + 50_000]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(some.astype(np.int32)), pa.array([names[i] for i in some], pa.binary()), pa.array(np.full(m, c, np.int32)), pa.array(n[lo : lo + m]), pa.nulls(m, pa.binary())], schema=schema)
            ids, held, of = zip(*docs, strict=True)
            ends = np.cumsum([0, *map(len, of)])
            joined = array("i")
            for x in of:
                joined.extend(x)
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.Array.from_buffers(pa.int32(), len(joined), [None, pa.py_buffer(joined)]))
            sent = _packed(pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), lists], names=["doc_id", "held_out", "ids"]))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([sent], pa.binary())], schema=schema)

        for b in batches:
            for doc, text, held, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = array("i")
                data = text.as_py() or b""
                for some in byte_words(data, _LOWER):
                    own.extend(map(words.__getitem__, some))
                if not held:
                    seen[c].extend(own)
                docs.append((doc, held, own))
                size += len(data)
                if size >= block_bytes:
                    yield from out()
                    number, size, docs, words, seen = number + 1, 0, [], _Numbers(), [array("i") for _ in range(classes)]
        if docs:
            yield from out()

    return rows.mapInArrow(run, "block long, k int, word binary, class int, n long, docs binary")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _texts(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in column.to_pylist()]


def learn(words: DataFrame, vocabulary: Vocabulary, scores: np.ndarray, rounds: int, smoothing: float = 0.1) -> np.ndarray:
    """Log weights of the pieces after ``rounds`` of expectation maximisation; each row of ``words`` counts once."""
    context = words.sparkSession.sparkContext
    told = context.broadcast(vocabulary)
    for _ in range(rounds):
        now = context.broadcast(scores)

        def uses(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(told.value.size)
            for b in batches:
                own = _texts(b.column(0))
                total += expected_uses(own, np.ones(len(own)), told.value, now.value)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

        # At most a row a piece of the vocabulary comes back.
        found = words.mapInArrow(uses, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        if found.empty:
            return scores
        total = np.full(vocabulary.size, smoothing)
        total[found["piece"]] += found["uses"]
        scores = np.log(total / total.sum())
        now.destroy()
    return scores


def weigh(words: DataFrame, vocabulary: Vocabulary, scores: np.ndarray, classes: int) -> DataFrame:
    """From (block, k, word, c0, c1, ...), ordered by word or not: (block, weights), each an array of k, lattice and counts."""
    context = words.sparkSession.sparkContext
    told, now = context.broadcast(vocabulary), context.broadcast(scores)
    names = ["k", "lattice", *[f"c{j}" for j in range(classes)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            edges = np.flatnonzero(np.diff(columns[0], prepend=-1, append=-1))
            for i, j in zip(edges, edges[1:], strict=False):
                own = pa.record_batch([pa.array(c[i:j]) for c in columns[1:]], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0][i : i + 1]), pa.array([_packed(own)], pa.binary())], names=["block", "weights"])

        for b in batches:
            coded = b.column(2).dictionary_encode()
            logs = log_likelihoods(_texts(coded.dictionary), told.value, now.value)[coded.indices.to_numpy()] if b.num_rows else np.zeros(0)
            held.append([b.column(0).to_numpy(), b.column(1).to_numpy(), logs, *[b.column(3 + j).to_numpy() for j in range(classes)]])
            size += b.num_rows
            if size >= _SENT:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return words.mapInArrow(run, "block long, weights binary")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", model: str | None = None, kind: str = "bpe", rounds: int | None = None, classes: int = 15, block_bytes: int = 1 << 24) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score), a row a document.

    Learns from documents whose crc32(id) mod 7 isn't 2. ``base_score``: add-one word probabilities; ``lattice_score``:
    the words' log10 probability by pieces alone. ``rounds``: by default 3 for ``bpe`` and none for ``unigram`` models.
    """
    vocabulary, scores = load(model or default_model(), kind)
    rounds = (3 if kind == "bpe" else 0) if rounds is None else rounds
    label = F.lit(None).cast("string") if class_col is None else F.col(class_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), _remainder(F.col(id_col)).alias("held_out"), label.alias("label"))
    frequent = rows.where(~F.col("held_out")).groupBy("label").count().orderBy(F.desc("count"), F.col("label").asc_nulls_last()).limit(classes).collect()
    number = {r["label"]: j for j, r in enumerate(x for x in frequent if x["label"] is not None)}
    n = len(number) + 1
    of = F.coalesce(F.try_element_at(F.create_map(*[x for c, j in number.items() for x in (F.lit(c), F.lit(j))]), F.col("label")), F.lit(n - 1)) if number else F.lit(0)
    rows = rows.withColumn("class", of)
    blocks = stored(blocks_of(rows.select("doc_id", "text", "held_out", "class"), n, block_bytes), "lm-blocks")
    trained = {r["class"]: r["count"] for r in rows.where(~F.col("held_out")).groupBy("class").count().collect()}

    by = Window.partitionBy("word")
    counts = [f"c{j}" for j in range(n)]
    sums = [F.sum(F.when(F.col("class") == j, F.col("n")).otherwise(0)).over(by).alias(c) for j, c in enumerate(counts)]
    told = blocks.where("word is not null").select("block", "k", "word", *sums, F.row_number().over(by.orderBy("block", "k", "class")).alias("at"))
    words = stored(told, "lm-words")
    known = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    total = words.where("at = 1").agg(F.count(F.when(known > 0, 1)), *[F.sum(c) for c in counts], *[F.count(F.when(F.col(c) == 1, 1)) for c in counts]).first()
    figures = Classes(np.array([trained.get(j, 0) for j in range(n)]), np.array([x or 0 for x in total[1 : n + 1]]), np.array(total[n + 1 :]), total[0])
    scores = learn(words.where((F.col("at") == 1) & (known > 0)).select("word"), vocabulary, scores, rounds)
    weights = weigh(words.select("block", "k", "word", *counts), vocabulary, scores, n)

    def assemble(texts: pa.Table, sent: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in sent.column("weights")]
        k = np.concatenate([np.zeros(0, int), *[p.column("k").to_numpy() for p in parts]]).astype(int)
        lattice, count = np.full(k.max(initial=-1) + 1, np.nan), np.zeros((k.max(initial=-1) + 1, n))
        if parts:
            lattice[k] = np.concatenate([p.column("lattice").to_numpy() for p in parts])
            for j, c in enumerate(counts):
                count[k, j] = np.concatenate([p.column(c).to_numpy() for p in parts])
        every = count.sum(axis=1)
        by_class, base = figures.words(count, lattice), figures.base(every)
        end = float(figures.documents.sum())
        out: list[list] = [[] for _ in range(8)]
        for x in texts.column("docs"):
            own = pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()
            lists = own.column("ids").chunk(0)
            ids, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)

            def summed(values: np.ndarray, row=row, ids=ids, size=size) -> np.ndarray:
                return np.bincount(row, values[ids], len(size))

            logs = np.stack([summed(by_class[:, j]) for j in range(n)], axis=1) + np.log(figures.end) + np.log(figures.prior)
            top = logs.max(axis=1)
            score = (top + np.log(np.exp(logs - top[:, None]).sum(axis=1))) / _LN10
            columns = [own.column("doc_id"), own.column("held_out"), size + 1, summed(every > 0).astype(np.int64) + (end > 0), np.full(len(size), figures.all_tokens), summed(base) + figures.base(end), score, summed(lattice) / _LN10]
            for to, values in zip(out, columns, strict=True):
                to.append(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.array(values))
        return pa.table([pa.chunked_array(x) for x in out], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    texts = blocks.where("docs is not null").select("block", "docs")
    return texts.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")


def op13_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The query: all documents, classes by language."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
