"""Operator 10, WARC: records written as one gzip stream a file, normalised to a member a record, read back.

*Write.* Each partition's records become one archive of WARC/1.1 response and revisit records in a single gzip
stream, in the shared folder. *Normalise.* A monolithic archive is inflated once, as a stream; every record is
written as its own gzip member to a second file, beside it a JSON-lines index of offset, length, record id, type and
target. The monolithic file goes once the second is complete. *Read.* Spans of records, each with its byte range in
the index, are dealt evenly over tasks, and a task seeks to its records. Every attempt of a task writes files of its
own name, and only those of the attempt that Spark commits are listed, so a task that runs again does no harm.

A record's id holds its page id and payload digest; a revisit's, and that of every record that no revisit refers to,
its place too, so ids are unique (but for rows that repeat both page id and payload of a response), and what a revisit
refers to is the id of a record.

Which of the records with one payload is the response (the largest page_id) is settled in DataFrame operations
on digests before writing; payloads below ``least_revisit`` bytes are never revisits.

Defined cases: null html is an empty payload; a null url is an empty target; null page_ids are smaller than all
others; rows that repeat a payload's largest page_id are responses all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import shared_path, small, stored

_BLOCK = 1 << 18
_NAME = "https://records.invalid/page/"


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path there."""
    if "://" not in folder:
        folder = folder.removeprefix("file:")
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, place: str | None) -> bytes:
    """One record with its two closing line ends; revisits hold the digest and length, not the payload.

    ``place`` makes the id of a record unique that no other refers to.
    """
    revisit = refers_to is not None
    body, digest = b"" if revisit else payload, digest_of(payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{_NAME}{'null' if page_id is None else page_id}/{digest}{'' if place is None else '/' + place}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c for c in url if c not in "\r\n"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<{_NAME}{refers_to}/{digest}>"
    fields |= {"Content-Type": "text/html", "Content-Length": str(len(body))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record starts here: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:]) if k}


class Inflated:
    """A gzip stream (one member or several) read once, in blocks, without seeking."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.held, self.engine = source, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        data = self.engine.unused_data or self.source.read(_BLOCK)
        if self.engine.eof:
            if not data:
                return False
            self.engine = zlib.decompressobj(31)
        elif not data:
            raise EOFError("the gzip stream ends within a member")
        self.held += self.engine.decompress(data)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is skipped; None at the end."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held.strip():
                    raise EOFError("the last record is not complete")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise EOFError("a record's block is not complete")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Fields, head and block of each record of a gzip stream."""
    stream = Inflated(source)
    while (head := stream.upto(b"\r\n\r\n")) is not None:
        fields = parse_head(head.lstrip(b"\r\n"))
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, head.lstrip(b"\r\n"), block


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO, span: int = 2000) -> tuple[int, list[tuple[int, int]]]:
    """Rewrite a monolithic gzip stream with a member a record, and its index.

    The number of records, and the index's byte range of each ``span`` of them.
    """
    at = count = told = 0
    spans: list[tuple[int, int]] = []
    for fields, head, block in records(source):
        member = gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)
        target.write(member)
        entry = {"offset": at, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "target": fields["warc-target-uri"]}
        line = json.dumps(entry).encode() + b"\n"
        index.write(line)
        if count % span == 0:
            spans.append((told, told))
        told += len(line)
        spans[-1] = (spans[-1][0], told)
        at += len(member)
        count += 1
    return count, spans


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record's own member."""
    fields, _, block = next(records(io.BytesIO(data)))
    return fields, block


def decided(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Pages (page_id, url, payload) with ``refers``: the largest page_id of an equal payload, null for that page itself.

    Equal payloads are found by SHA-256 and length; of a hot payload only ids move, and its largest id is a
    partial aggregate.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    top = rows.where(F.col("size") >= least_revisit).groupBy("key", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies")).where("copies > 1 and largest is not null")
    shared = small(stored(top.select("key", "size", "largest"), "warc-shared"))
    largest = F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(shared, ["key", "size"], "left").select("page_id", "url", "payload", F.when(~largest, F.col("largest")).alias("refers"), (F.col("largest").isNotNull() & largest).alias("is_referred"))


def write_archives(rows: DataFrame, folder: str, span: int = 2000) -> DataFrame:
    """Write normalised archives of ``decided`` rows; the files' name and the index's byte range of each span of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.{context.taskAttemptId()}"
        fs.create_dir(base)
        count = 0
        with fs.open_output_stream(f"{base}/{name}.mono") as raw:
            engine = zlib.compressobj(1, zlib.DEFLATED, 31)
            for b in batches:
                for page, url, payload, refers, referred in zip(*(b.column(k) for k in range(5)), strict=True):
                    place = None if referred.as_py() else f"{context.partitionId()}-{count}"
                    raw.write(engine.compress(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), place)))
                    count += 1
            raw.write(engine.flush())
        with fs.open_input_stream(f"{base}/{name}.mono", compression=None) as source, fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as target, fs.open_output_stream(f"{base}/{name}.index.jsonl") as index:
            written, spans = normalise(source, target, index, span)
        if written != count:
            raise ValueError("normalising lost records")
        fs.delete_file(f"{base}/{name}.mono")
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(spans), pa.string()), pa.array([x for x, _ in spans], pa.int64()), pa.array([y for _, y in spans], pa.int64())], names=["name", "begins", "ends"])

    return rows.mapInArrow(run, "name string, begins long, ends long")


def read_archives(spans: DataFrame, folder: str, most_tasks: int = 20_000) -> DataFrame:
    """Every record of spans (name, begins, ends): page_id, payload length and digest, type, what it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for b in batches:
            for name, begins, ends in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                out = []
                with fs.open_input_file(f"{base}/{name}.index.jsonl") as index:
                    index.seek(begins)
                    wanted = [json.loads(x) for x in index.read(ends - begins).splitlines()]
                with fs.open_input_file(f"{base}/{name}.warc.gz") as archive:
                    for entry in wanted:
                        archive.seek(entry["offset"])
                        fields, payload = read_member(archive.read(entry["length"]))
                        told = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if fields["warc-record-id"] != entry["id"] or not revisit and digest_of(payload) != told:
                            raise ValueError(f"{name}: the record at {entry['offset']} isn't what its index or digest says")
                        page = fields["warc-record-id"].removeprefix(f"<{_NAME}").split("/")[0]
                        refers = fields["warc-refers-to"].removeprefix(f"<{_NAME}").split("/")[0] if revisit else None
                        out.append((None if page == "null" else int(page), int(fields["x-payload-length"]) if revisit else len(payload), told, fields["warc-type"], refers and int(refers)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # A task takes one span, or as many as keep the tasks' number bounded; a count that is given is not merged at run time.
    tasks = max(1, min(spans.count(), most_tasks))
    return spans.repartition(tasks, "name", "begins").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Write the pages' archives and read them back: a row per page."""
    folder = shared_path(pages.sparkSession, "warc")
    spans = stored(write_archives(decided(pages, least_revisit), folder), "warc-spans")
    return read_archives(spans, folder)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """The query: all pages; equal payloads of any size become revisits."""
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_BITS = "list_aggregate(list_transform(string_split(sha1(p), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][1 + strpos('0123456789abcdef', c) - 1]), 'string_agg', '')"

ORACLE_SQL = f"""
WITH w AS (SELECT page_id, coalesce(html, '') p FROM pages),
b AS (SELECT page_id, p, {_BITS} bits FROM w),
d AS (SELECT page_id, p, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
          + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') digest,
        max(page_id) OVER (PARTITION BY p) top FROM b)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d
"""
