"""Designs over a table's rows: what is shuffled and stored for them."""

import hashlib

import pytest

from quillspark.operators import design, numbering


def test_points_store_no_hash(spark, monkeypatch):
    """Ranges are dealt by eight bytes, and places are stored without the hashes that order them; the points are the same."""
    seen, stored = [], numbering.stored
    monkeypatch.setattr(numbering, "stored", lambda df, name: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    df = spark.range(50).withColumnRenamed("id", "k")
    got = {r["k"]: r["u"] for r in design.row_points(df, "k", 3).collect()}
    (columns, plan), = seen
    assert columns == ["k", "dim", "_jitter", "_place"]
    assert "rangepartitioning(dim" in plan and "_begin" in plan.split("rangepartitioning(")[1].split(")")[0]
    hashes = [[hashlib.sha256(f"42:{j}:{k}".encode()).hexdigest() for k in range(50)] for j in range(3)]
    assert got == {k: [(sorted(h).index(h[k]) + int(h[k][51:], 16) / (1 << 52)) / 50 for h in hashes] for k in range(50)}


def test_a_repeated_key_fails(spark):
    with pytest.raises(Exception, match="several rows of 1"):
        design.row_points(spark.createDataFrame([(1,), (1,), (2,)], "k long"), "k", 2).collect()
