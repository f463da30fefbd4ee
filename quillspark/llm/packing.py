"""Operator 2, packing: bounded-space online packing of token sequences.

Every partition holds a fixed number of open windows. A document (ids and an end id) goes, whole, into
the open window that it fits best; what is longer than a window leaves full windows first. When no
open window fits, the fullest is topped up with the head of the document, emitted, and replaced by an
empty one. At the end of a partition its open windows are merged, so that less than one window is left
of it; these remainders are merged again in groups of partitions, and what a group has left is cut into
powers of two, which need no padding. A group's merge holds ``merge_group`` remainders at most.

Defined cases: null text counts as empty (its one piece holds the end id alone); null and repeated ids
are carried as they are, each row is a document of its own; columns other than id and text are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.tokens import default_tokenizer, encoder

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of merged remainders start here; those of partitions stay below.
_MERGED = 1 << 61


class Packer:
    """Best-fit packing into ``open_windows`` windows; pieces are (doc id, start, ids, tokens of the document)."""

    def __init__(self, window: int, open_windows: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.open: list[list] = [[0, []] for _ in range(open_windows)]
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.sequence, at))
            at += n
        self.sequence += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        while total - at >= self.window:
            self.emit([(doc, at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        while at < total:
            rest = total - at
            slot = max((w for w in self.open if self.window - w[0] >= rest), key=lambda w: w[0], default=None)
            if slot is None:
                slot = max(self.open, key=lambda w: w[0])
                rest = self.window - slot[0]
            slot[1].append((doc, at, ids[4 * at : 4 * (at + rest)], total))
            slot[0] += rest
            at += rest
            if slot[0] == self.window:
                self.emit(slot[1])
                slot[0], slot[1] = 0, []

    def merge(self) -> list[tuple]:
        """Empty the open windows, fullest first; full sequences are emitted, the pieces of the rest returned."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        full, rest = cut(pieces, self.window)
        for x in full:
            self.emit(x)
        return rest


def cut(pieces: list[tuple], window: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Full windows from pieces in order, cutting where a window ends, and the pieces that are left."""
    full: list[list[tuple]] = []
    now: list[tuple] = []
    room = window
    for doc, start, ids, total in pieces:
        while len(ids) // 4 >= room:
            full.append([*now, (doc, start, ids[: 4 * room], total)])
            start, ids, now, room = start + room, ids[4 * room :], [], window
        if ids:
            now.append((doc, start, ids, total))
            room -= len(ids) // 4
    return full, now


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces as sequences whose lengths are falling powers of two."""
    out = []
    while left := sum(len(p[2]) for p in pieces) // 4:
        head, rest = cut(pieces, size := 1 << (left.bit_length() - 1))
        out.append(head[0])
        pieces = [p for x in head[1:] for p in x] + rest
        assert size <= left
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


_LONGS = [pa.field(c, pa.int64()) for c in COLUMNS]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, open_windows: int = 16, end_id: int = 1, tokenizer: str | None = None, merge_group: int = 256) -> DataFrame:
    """One row per piece, as in the module's text: see :data:`COLUMNS`."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([*_LONGS, pa.field("part", pa.int64()), pa.field("ids", pa.binary())])
    end = end_id.to_bytes(4, "little")

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, encode = Packer(window, open_windows, part << 32), encoder(path).encode
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, encode(text.as_py() or "") + end)
                if len(packer.done) >= 4096:
                    yield _batch([(*x, part, None) for x in packer.done], schema)
                    packer.done = []
        rest = packer.merge()
        yield _batch([(*x, part, None) for x in packer.done], schema)
        yield _batch([(doc, start, len(ids) // 4, None, total, None, k, part, ids) for k, (doc, start, ids, total) in enumerate(rest)], schema)

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"]))
        packer = Packer(window, 0, _MERGED + (rows[0]["part"] // merge_group << 20) if rows else _MERGED)
        full, rest = cut([(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows], window)
        for x in [*full, *powers(rest)]:
            packer.emit(x)
        return pa.Table.from_batches([_batch(packer.done, pa.schema(_LONGS))])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = stored(source.mapInArrow(partition, f"{_PIECES}, part long, ids binary"), "packing")
    left = packed.where("ids is not null").groupBy(F.floor(F.col("part") / merge_group)).applyInArrow(merged, _PIECES)
    return packed.where("ids is null").select(*COLUMNS).unionByName(left)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """The query: all documents, windows of 2048."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
