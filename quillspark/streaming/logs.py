"""Result logs as streams: append, resume without repeating, keep the latest record of a key."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quillspark.operators.compaction import last_wins
from quillspark.sources.tables import exists


def drained(query: StreamingQuery) -> None:
    """Wait until a query that takes what is available has ended; its failure is raised."""
    query.awaitTermination()


def append_new(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], by: Sequence[str] = (), form: str = "parquet") -> None:
    """Append the first record of each key to a log, in folders by the columns ``by``; ended or killed, it resumes.

    Keys that were written are state of the stream, held beside its keys' partitions, so no batch reads the target. The
    file sink lists the files of whole batches only: a batch that runs again after a failure adds nothing twice. Both
    belong to ``checkpoint``, which must stay with its target. Nulls are equal keys. For many keys a session keeps state
    on disk (``session.STATE_ON_DISK``).
    """
    fresh = stream.dropDuplicates(list(keys))
    writer = fresh.writeStream.format(form).option("path", target).option("checkpointLocation", checkpoint)
    drained((writer.partitionBy(*by) if by else writer).trigger(availableNow=True).start())


def _version(spark: SparkSession, folder: str, epoch: int) -> dict[int, str]:
    """The newest version up to ``epoch``: each bucket's folder (one small row a bucket)."""
    while epoch >= 0 and not exists(spark, f"{folder}/versions/v{epoch}/_SUCCESS"):
        epoch -= 1
    return {r["bucket"]: r["path"] for r in spark.read.parquet(f"{folder}/versions/v{epoch}").collect()} if epoch >= 0 else {}


def upsert(batch: DataFrame, epoch: int, folder: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> list[int]:
    """Merge a batch into the latest records by key; the buckets that it rewrote.

    State is dealt by the keys' hash. A version lists a folder for each bucket; a batch reads and writes those that its
    keys fall into, and its version keeps the others' folders. A batch that runs again starts from the version before
    it, so it changes nothing.
    """
    spark = batch.sparkSession
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    before = _version(spark, folder, epoch - 1)
    rows = batch.withColumn("_bucket", at)
    touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
    if held := [before[b] for b in touched if b in before]:
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*held).withColumn("_bucket", at))
    last_wins(rows, keys, order).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/data/v{epoch}")
    now = before | {b: f"{folder}/data/v{epoch}/_bucket={b}" for b in touched}
    spark.createDataFrame(sorted(now.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/v{epoch}")
    return touched


def keep_latest(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> DataFrame:
    """Latest-wins compaction of a stream, batch by batch (:func:`upsert`): the result of the batch operator on the whole log."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(lambda batch, epoch: upsert(batch, epoch, folder, keys, order, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    drained(query)
    last = query.lastProgress["batchId"] if query.lastProgress else 1 << 16
    paths = sorted(_version(spark, folder, last).values())
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


class ProgressLog(StreamingQueryListener):
    """Records of running queries: rows of a batch and so far, rows a second, and the seconds left if their total is told."""

    def __init__(self, total: int | None = None) -> None:
        self.total, self.records, self.rows, self.ended = total, [], {}, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        run = str(p.runId)
        self.rows[run] = so_far = self.rows.get(run, 0) + p.numInputRows
        rate = float(p.processedRowsPerSecond)
        left = None if self.total is None or not rate > 0 else max(0, self.total - so_far) / rate
        self.records.append((run, p.batchId, p.numInputRows, so_far, rate, left, p.timestamp))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


PROGRESS = "run string, batch long, rows long, rows_so_far long, rows_per_second double, seconds_left double, at string"


def watched(spark: SparkSession, start: Callable[[], StreamingQuery], folder: str, total: int | None = None) -> DataFrame:
    """Run the query that ``start`` begins to its end and append its progress to JSON lines in ``folder``: one record a batch."""
    log = ProgressLog(total)
    spark.streams.addListener(log)
    try:
        drained(start())
        # Events come on a bus of their own, the end last.
        log.ended.wait(60)
    finally:
        spark.streams.removeListener(log)
    spark.createDataFrame(log.records, PROGRESS).coalesce(1).write.mode("append").json(folder)
    return spark.read.schema(PROGRESS).json(folder)


def attempts(log: DataFrame, keys: Sequence[str], error: str, most: int) -> DataFrame:
    """Per key: attempts, whether one succeeded, and whether it is out of attempts."""
    out = log.groupBy(*keys).agg(F.count("*").alias("attempts"), F.bool_or(F.col(error).isNull()).alias("done"))
    return out.withColumn("given_up", ~F.col("done") & (F.col("attempts") >= most))


def running_counts(stream: DataFrame, groups: Sequence[str], error: str, name: str) -> StreamingQuery:
    """Rows and errors so far per group, kept as state and shown in an in-memory table."""
    counts = stream.groupBy(*groups).agg(F.count("*").alias("rows"), F.count_if(F.col(error).isNotNull()).alias("errors"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, width: str, late: str, groups: Sequence[str], value: str) -> DataFrame:
    """Event-time windows with a watermark: n and sum of a value."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
