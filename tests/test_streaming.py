"""Streamed upserts by bucket and recorded progress."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.sources import tables
from quillspark.streaming import logs

SCHEMA = "k long, at long, v string"


def state(spark, version):
    return sorted(repr(tuple(r)) for r in spark.read.schema(SCHEMA).parquet(*version.values()).select("k", "at", "v").collect())


def test_a_batch_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    folder = str(tmp_path)
    first = spark.createDataFrame([(k, 1, f"a{k}") for k in range(300)] + [(None, 1, "null key")], SCHEMA)
    assert len(logs.upsert(first, 0, folder, ["k"], ["at"], 32)) > 25
    before = logs._version(spark, folder, 0)
    second = spark.createDataFrame([(7, 2, "new"), (7, 1, "late"), (900, 1, "more"), (8, 0, "old")], SCHEMA)
    touched = logs.upsert(second, 1, folder, ["k"], ["at"], 32)
    after = logs._version(spark, folder, 1)
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(touched)
    want = {k: (k, 1, f"a{k}") for k in range(300)} | {7: (7, 2, "new"), 900: (900, 1, "more"), None: (None, 1, "null key")}
    assert state(spark, after) == sorted(map(repr, want.values()))
    # The batch again: the same buckets, the same rows.
    assert logs.upsert(second, 1, folder, ["k"], ["at"], 32) == touched and logs._version(spark, folder, 1) == after
    assert spark.read.schema(SCHEMA).parquet(*after.values()).count() == len(want)
    assert logs.upsert(spark.createDataFrame([], SCHEMA), 2, folder, ["k"], ["at"], 32) == [] and logs._version(spark, folder, 2) == after


def test_progress_is_recorded(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/progress"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10, 1, 1).write.mode("append").parquet(source)
    stream = logs.read_stream(spark, source, "id long")
    start = lambda: stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    got = [r for r in logs.watched(spark, start, folder, 30).orderBy("batch").collect() if r["rows"]]
    assert [(r["rows"], r["rows_so_far"]) for r in got] == [(10, 10), (10, 20), (10, 30)]
    assert got[-1]["seconds_left"] == 0 and got[0]["seconds_left"] > 0 and all(r["rows_per_second"] > 0 for r in got)
    # Nothing is left to read: a second run adds no rows.
    assert logs.watched(spark, start, folder, 30).agg(F.sum("rows")).first()[0] == 30


def test_a_failure_is_raised_and_recorded(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(5).write.parquet(source)
    bad = logs.read_stream(spark, source, "id long").select(F.raise_error(F.lit("no good")).cast("long").alias("x"))
    with pytest.raises(Exception, match="no good"):
        logs.watched(spark, lambda: bad.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(), f"{tmp_path}/progress")


@pytest.mark.parametrize("provider", [None, *session.STATE_ON_DISK.values()])
def test_a_log_resumes_after_a_failure(spark, tmp_path, provider):
    source, target, at = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for k in range(4):
        spark.range(10 * k, 10 * k + 15, 1, 1).selectExpr("id % 40 as k", "id as v").write.mode("append").parquet(source)
    name = next(iter(session.STATE_ON_DISK))
    before = spark.conf.get(name)
    spark.conf.set(name, provider or before)
    try:
        stream = logs.read_stream(spark, source, "k long, v long")
        broken = stream.withColumn("v", F.when(F.col("k") == 27, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
        with pytest.raises(Exception, match="killed"):
            logs.append_new(broken, target, at, ["k"])
        held = spark.read.schema("k long, v long").parquet(target).count()
        assert 0 < held < 40
        for _ in range(2):
            logs.append_new(stream, target, at, ["k"])
            assert sorted(r.k for r in spark.read.parquet(target).collect()) == list(range(40))
        spark.createDataFrame([(3, 0), (41, 1), (None, 2), (None, 3)], "k long, v long").coalesce(1).write.mode("append").parquet(source)
        logs.append_new(stream, target, at, ["k"])
        assert sorted((r.k for r in spark.read.parquet(target).collect()), key=str) == sorted([*range(40), 41, None], key=str)
    finally:
        spark.conf.set(name, before)


def test_manifest(spark, tmp_path):
    path = f"{tmp_path}/manifest"
    tables.write_manifest(spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "name string, size long, digest string"), path, "name")
    told = "".join(p.read_text() for p in (tmp_path / "manifest").glob("part-*"))
    assert json.loads(told) == {"a": {"digest": "x", "size": 1}, "b": {"size": 2}} and told.index('"a"') < told.index('"b"') and "\n  " in told
    assert sorted(tables.read_manifest(spark, path, "name", "size: bigint, digest: string").collect()) == [("a", 1, "x"), ("b", 2, None)]
