"""Session settings that the library's results rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC keeps dates equal on every machine; adaptive execution sizes and splits shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
}

#: State of streams in files on the executors instead of their memory.
STATE_ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def local(cores: int | str = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A session of one machine, for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quillspark").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores))
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that executors share, for intermediate tables: ``spark.checkpoint.dir``; a local one in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/") if base else f"/tmp/quillspark-{os.getuid()}"
