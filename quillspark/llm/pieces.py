"""Operator 6, SentencePiece encoding and decoding: a relational lattice of words.

A text, its spaces written as the piece mark, is cut wherever no piece could cross: at word and line ends, and between
two characters that stand side by side in no piece. What lies between two cuts is a segment. The segments of a block
of rows are made distinct, then those of all blocks, so that a segment is folded once, in however many blocks it lies.
Each is exploded into its substrings of at most the longest piece's length, and an equi-join with the piece table keeps
the lattice's edges. Edges are grouped by segment, and a higher-order aggregate folds them:

* ``unigram`` models: Viterbi, the path of the largest sum of scores, by ends;
* ``bpe`` models (the given one): a sum of scores is not what such a model means, so the fold applies its merges
  instead. Edges come best score first, leftmost first; one whose ends are both still cuts, with one cut between
  them, merges. That is the model's own order if no piece is made of a later one, which :func:`in_order` checks.

Characters without a piece become byte pieces, or the unknown piece where the model has none. Segments longer than
``lattice_chars`` (at most 62, the bits of the fold's state), and all segments of a model that isn't in order, go
through the same rule by a heap in Python, which keeps the lattice's rows linear in the text. A block's segments are
joined with their cuts, a bit a cut, and meet the block's texts, which travel compressed; texts are cut and put together
in Arrow and numpy. A block ends at ``block_chars`` bytes of text. Where a source gives its rows in another order when it is read again, blocks can differ
between both reads; a segment that its block lacks then goes through the heap too, with the same ids.

Defined cases: null or empty text has no ids; repeated rows and null ids are rows like others; an empty table gives
no rows; other columns are ignored. Decoding gives the text itself wherever the model's pieces or bytes can.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
_WORDS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@dataclass
class Pieces:
    """A model's pieces: text to (id, score), byte pieces by byte, and the kind of the model."""

    kind: str
    table: dict[str, tuple[int, float]]
    bytes_: dict[int, int]
    unknown: int
    names: list[str]

    @property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @cached_property
    def neighbours(self) -> set[str]:
        """Pairs of characters that stand side by side in a piece; no piece crosses any other pair."""
        return {w[i : i + 2] for w in self.table for i in range(len(w) - 1)}

    @cached_property
    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``neighbours`` as bits: by code point, a row for a first character and a column for a second one (0: in no pair)."""
        a, b = (np.array([ord(x[k]) for x in self.neighbours], np.int64) for k in (0, 1))
        numbers = []
        for codes in (a, b):
            own = np.unique(codes)
            numbers.append(np.zeros(0x110000, np.int32))
            numbers[-1][own] = np.arange(1, len(own) + 1)
        rows, columns = numbers
        bits = np.zeros((rows.max() + 1, columns.max() // 8 + 1), np.uint8)
        np.bitwise_or.at(bits, (rows[a], columns[b] >> 3), (1 << (columns[b] & 7)).astype(np.uint8))
        return rows, columns, bits


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str, kind: str = "bpe") -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = {names[i]: (i, model.get_score(i)) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    return Pieces(kind, plain, {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}, model.unk_id(), names)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def segments_of(word: str, pieces: Pieces) -> list[str]:
    near = pieces.neighbours
    cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in near), len(word)]
    return [word] if len(cuts) == 2 else [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _strings(text: str, codes: np.ndarray, at: np.ndarray) -> pa.StringArray:
    """The strings between places ``at`` of a text, whose code points are ``codes``."""
    width = np.zeros(len(codes) + 1, np.int64)
    width[1:] = 1
    for least in (0x80, 0x800, 0x10000):
        width[1:] += codes >= least
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(np.cumsum(width)[at].astype(np.int32)), pa.py_buffer(text.encode()))


def _regrouped(lists: pa.ListArray, at: np.ndarray) -> pa.ListArray:
    """Lists put together: those between places ``at`` become one."""
    return pa.ListArray.from_arrays(lists.offsets.take(pa.array(at)), lists.values)


def cut_texts(texts: list[str | None], pieces: Pieces) -> tuple[pa.StringArray, np.ndarray]:
    """The segments of some texts, as :func:`words_of` and :func:`segments_of` cut them, and how many lie before the end of each text."""
    own = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    text, ends = "".join(own), np.cumsum([0, *map(len, own)])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    rows, columns, bits = pieces.near
    column, line, mark = columns[codes[1:]], codes == ord("\n"), codes == ord(MARK)
    cuts = np.ones(len(codes) + 1, bool)
    cuts[1:-1] = bits[rows[codes[:-1]], column >> 3] >> (column & 7) & 1 == 0
    cuts[1:-1] |= line[1:] | line[:-1] | mark[1:] & ~mark[:-1]
    cuts[ends] = True
    at = np.flatnonzero(cuts)
    return _strings(text, codes, at), np.searchsorted(at, ends[1:])


def ids_of_cuts(words: pa.StringArray, cuts: np.ndarray, pieces: Pieces) -> pa.ListArray:
    """Ids of words, from their cuts: bit k of ``cuts`` is one before character k."""
    text = "".join(words.to_pylist())
    codes, sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32), pc.utf8_length(words).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    places = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    at = np.append(np.flatnonzero(np.repeat(cuts, sizes) >> places & 1), len(codes))
    coded = _strings(text, codes, at).dictionary_encode()
    ids = [[pieces.table[x][0]] if x in pieces.table else [k for c in x for k in spelled(c, pieces)] for x in coded.dictionary.to_pylist()]
    return _regrouped(pa.array(ids, pa.list_(pa.int32())).take(coded.indices), np.searchsorted(at, np.append(0, ends)))


def spelled(c: str, pieces: Pieces) -> list[int]:
    """Ids of one character: its piece, else its bytes, else the unknown piece."""
    if c in pieces.table:
        return [pieces.table[c][0]]
    return [pieces.bytes_[b] for b in c.encode("utf-8", "surrogatepass")] if pieces.bytes_ else [pieces.unknown]


def merges(word: str, pieces: Pieces) -> Iterator[tuple[int, str, list[str | None]]]:
    """BPE by a heap, O(n log n): each merge's place and union, with the parts (None: merged into an earlier one) after it."""
    parts: list[str | None] = list(word)
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap: list[tuple] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) >= 0 and (both := parts[i] + parts[j]) in pieces.table:
            heapq.heappush(heap, (-pieces.table[both][1], i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
        yield i, both, parts


def merged(word: str, pieces: Pieces) -> list[int]:
    """BPE ids of a word of any length."""
    parts: list[str | None] = list(word)
    for _, _, parts in merges(word, pieces):  # noqa: B007
        pass
    return [k for p in parts if p is not None for k in ([pieces.table[p][0]] if p in pieces.table else spelled(p, pieces))]


def in_order(pieces: Pieces) -> bool:
    """Whether every piece that merges can make is made with scores that fall from merge to merge."""
    for word in pieces.table:
        scores = [pieces.table[both][1] for _, both, _ in merges(word, pieces)]
        if len(word) > 1 and scores != sorted(scores, reverse=True) and len(merged(word, pieces)) == 1:
            return False
    return True


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(k, i, float(s)) for k, (i, s) in pieces.table.items()], "piece string, id int, score double")


def lattice(words: DataFrame, table: DataFrame, least: int, longest: int, keys: list[str]) -> DataFrame:
    """``words`` (keys, word) with their edges of ``least`` characters or more, sorted: (cost, at, size). Words without any are left out."""
    n = F.char_length("word")
    # No sequence here is empty. The plain explode would have Spark filter for that, below what words came from.
    at = words.where(n >= least).select("*", n.alias("n"), F.explode_outer(F.sequence(F.lit(0), n - least)).alias("at"))
    spans = at.select(*keys, "word", "at", F.explode(F.sequence(F.lit(least), F.least(F.lit(longest), F.col("n") - F.col("at")))).alias("size"))
    # A vocabulary is of a fixed size, some ten thousands of rows.
    edges = spans.withColumn("piece", F.substr("word", F.col("at") + 1, F.col("size"))).join(F.broadcast(table), "piece")
    one = F.struct((-F.col("score")).alias("cost"), "at", "size")
    return edges.groupBy(*keys, "word").agg(F.sort_array(F.collect_list(one)).alias("edges"))


def _span(at: Column, size: Column) -> Column:
    return (at * 256 + size).cast("int")


def _bits(at: Column, size: Column) -> Column:
    """``size`` bits from bit ``at``."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", F.call_function("shiftleft", one, size) - 1, at)


def fold_merges(word: Column, edges: Column) -> Column:
    """Cuts of a word of at most 62 characters, 0 to its length, after all merges: a bit a cut while it folds."""
    n = F.char_length(word)

    def step(cuts: Column, e: Column) -> Column:
        within = cuts.bitwiseAND(_bits(e["at"] + 1, e["size"] - 1))
        ends = cuts.bitwiseAND(_bits(e["at"], F.lit(1)).bitwiseOR(_bits(e["at"] + e["size"], F.lit(1))))
        return F.when((F.bit_count(ends) == 2) & (F.bit_count(within) == 1), cuts.bitwiseXOR(within)).otherwise(cuts)

    def cuts(mask: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n), lambda i: mask.bitwiseAND(_bits(i, F.lit(1))) != 0)

    return F.aggregate(edges, _bits(F.lit(0), n + 1), step, cuts)


def fold_viterbi(word: Column, edges: Column, longest: int, unknown: float = -1e6) -> Column:
    """Cuts of the path with the largest sum of scores; a character without an edge costs ``unknown``; ties: the longer last piece."""
    n = F.char_length(word)
    scores = F.map_from_entries(F.transform(edges, lambda e: F.struct(_span(e["at"], e["size"]), -e["cost"])))
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.array(F.lit(0)).alias("cuts")))

    def step(best: Column, end: Column) -> Column:
        def path(size: Column) -> Column:
            prior = F.get(best, end - size)
            score = F.try_element_at(scores, _span(end - size, size))
            score = F.coalesce(score, F.when(size == 1, F.lit(unknown)))
            return F.when(score.isNotNull(), F.struct((prior["s"] + score).alias("s"), size.alias("size"), F.concat(prior["cuts"], F.array(end)).alias("cuts")))

        top = F.array_max(F.transform(F.sequence(F.lit(1), F.least(end, F.lit(longest))), path))
        return F.transform(F.array(top), lambda t: F.concat(best, F.array(F.struct(t["s"].alias("s"), t["cuts"].alias("cuts")))))[0]

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)["cuts"]


def cut_words(words: DataFrame, table: DataFrame, kind: str, longest: int, keys: list[str]) -> DataFrame:
    """(keys, word, cuts): where the word's pieces begin, and its end; words that no edge reaches are left out: each character is one piece."""
    if kind == "bpe":
        edges = lattice(words, table, 2, longest, keys)
        return edges.select(*keys, "word", fold_merges(F.col("word"), F.col("edges")).alias("cuts"))
    edges = lattice(words, table, 1, longest, keys)
    return edges.select(*keys, "word", fold_viterbi(F.col("word"), F.col("edges"), longest).alias("cuts"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, kind: str = "bpe", block_chars: int = 1 << 25, lattice_chars: int = 32) -> DataFrame:
    """(id, ids): each row's piece ids."""
    if not 1 < lattice_chars <= 62:
        raise ValueError("lattice_chars: 2 to 62")
    pieces = load(model or default_model(), kind)
    longest_segment = lattice_chars if kind != "bpe" or in_order(pieces) else 0
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = spark.sparkContext.broadcast(pieces)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Slices of at most about a sixteenth of a block, each with its block's number."""
        number, total, most = 0, 0, max(1, block_chars // 16)
        for b in batches:
            part, sizes = b.column(0)[0].as_py() if b.num_rows else 0, pc.binary_length(b.column(2)).to_pylist()
            start = own = 0
            for i, size in enumerate(sizes):
                own += size or 0
                if own >= most or i + 1 == len(sizes):
                    yield (part << 32) + number, b.slice(start, i + 1 - start)
                    total, start, own = total + own, i + 1, 0
                    if total >= block_chars:
                        number, total = number + 1, 0

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: int | None = None
        seen: list[pa.Array] = []

        def out() -> Iterator[pa.RecordBatch]:
            own = pc.unique(pa.chunked_array(seen, pa.string()))
            size = pc.utf8_length(own)
            own = own.filter(pc.and_(pc.greater(size, 1), pc.less_equal(size, longest_segment)))
            own = own.take(pc.sort_indices(own))
            for k in range(0, len(own), 50_000):
                some = own[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), some], names=["block", "word"])

        for k, b in blocks(batches):
            if k != block:
                yield from out()
                block, seen = k, []
            seen.append(pc.unique(cut_texts(b.column(2).to_pylist(), told.value)[0]))
        yield from out()

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as to:
                to.write_batch(pa.RecordBatch.from_arrays([b.column(1), b.column(2).cast(pa.string())], names=["doc_id", "text"]))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

    # Both uses of the blocks' segments read one exchange: what one side filters, the other does too, and each needs both columns.
    least = 2 if kind == "bpe" else 1
    placed = rows.mapInArrow(distinct, "block long, word string").where(F.char_length("word") >= least).repartition("word")
    once = placed.groupBy("word").agg(F.min("block").alias("first"))
    cut = cut_words(once, piece_table(spark, pieces), kind, pieces.longest, ["first"])
    bits = F.aggregate("cuts", F.lit(0).cast("long"), lambda x, k: x.bitwiseOR(_bits(k, F.lit(1))))
    found = placed.join(cut.select("word", bits.alias("cuts")).hint("shuffle_hash"), "word")

    def assemble(texts: pa.Table, spans: pa.Table) -> pa.Table:
        p = told.value
        doc_ids, segments, ends, total = [], [], [np.zeros(1, np.int64)], 0
        for sent in texts.column("texts"):
            own = pa.ipc.open_stream(sent.as_buffer()).read_all()
            some, at = cut_texts(own.column("text").to_pylist(), p)
            doc_ids += own.column("doc_id").chunks
            segments.append(some)
            ends.append(at + total)
            total += len(some)
        coded = pa.chunked_array(segments, pa.string()).dictionary_encode().combine_chunks()
        words = spans.column("word").combine_chunks().cast(pa.string())
        known = ids_of_cuts(words, spans.column("cuts").to_numpy(), p)
        at = pc.index_in(coded.dictionary, value_set=words)
        others = coded.dictionary.filter(at.is_null()).to_pylist()
        rest = pa.array([spelled(x, p) if len(x) == 1 else long_word(x, p) for x in others], pa.list_(pa.int32()))
        place = at.fill_null(0).to_numpy().copy()
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(words) + np.arange(len(others))
        lists = pa.concat_arrays([known, rest]).take(pa.array(place[coded.indices.to_numpy()]))
        return pa.table({"doc_id": pa.chunked_array(doc_ids, pa.int64()), "ids": _regrouped(lists, np.concatenate(ends))})

    sent = rows.mapInArrow(compressed, "block long, texts binary")
    return sent.groupBy("block").cogroup(found.select("block", "word", "cuts").groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def long_word(word: str, pieces: Pieces) -> list[int]:
    """Ids of a word beyond the lattice, by the model's own rule."""
    if pieces.kind == "bpe":
        return merged(word, pieces)
    best: list[tuple] = [(0.0, 0, 0)]
    longest = pieces.longest
    for end in range(1, len(word) + 1):
        options = [(best[a][0] + pieces.table[word[a:end]][1], end - a, a) for a in range(max(0, end - longest), end) if word[a:end] in pieces.table]
        if word[end - 1] not in pieces.table:
            options.append((best[end - 1][0] - 1e6, 1, end - 1))
        best.append(max(options, key=lambda x: x[:2]))
    out: list[list[int]] = []
    end = len(word)
    while end:
        a = best[end][2]
        out.append([pieces.table[word[a:end]][0]] if word[a:end] in pieces.table else spelled(word[a:end], pieces))
        end = a
    return [i for x in reversed(out) for i in x]


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of piece ids: byte pieces as UTF-8, marks as spaces, less the one that begins every text."""
    of_byte = {i: b for b, i in pieces.bytes_.items()}
    out = b"".join(bytes([of_byte[i]]) if i in of_byte else pieces.names[i].encode() for i in ids)
    return out.decode("utf-8", "replace").replace(MARK, " ")[1:]


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) of (id, ids); null ids give null."""
    pieces = load(model or default_model())
    told = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode_ids(x, told.value) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """The query: ids of all documents, their number and a digest of them in order."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha1(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("ids_sha1"))
