"""Shared helpers of the text operators: tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three longs that may be broadcast (about 32 MB); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000

_written: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local folder only in local mode with that unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = os.path.join(tempfile.gettempdir(), f"quillspark-{os.getuid()}")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete(df: DataFrame) -> None:
    """Delete a table that :func:`stored` returned and that nothing reads any more."""
    own = (df.sparkSession, df._stored_path)
    _remove(*own)
    _written.remove(own)


@atexit.register
def release() -> None:
    """Delete what :func:`stored` wrote, at the end of the driver program."""
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # the session has ended; its scratch folder is the cluster's to clear
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Hint a broadcast of a stored table of fixed-size rows if it has at most ``rows``; else leave the join to shuffle.

    Rows of no fixed size give their bytes as ``weight``; of these, 16 a row of the bound are allowed.
    """
    n, extra = df.agg(F.count("*"), F.sum(F.lit(0) if weight is None else weight)).first()
    return F.broadcast(df) if n <= rows and (extra or 0) <= 16 * rows else df


def free(taken: list[str], *names: str) -> list[str]:
    """Names for own columns that no column of a table has, whatever its case."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
