"""Wide CSV rows against the csv module, and folders of a known number of files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from quillspark.sources import wide


def test_fields_equal_the_csv_module(spark, tmp_path):
    rng = random.Random(1)
    rows = [[rng.choice(["", "a", "b c", 'q"u', "x,y", '"', ",", "ü", "1.5", " lead", "z" * 9000]) for _ in range(7)] for _ in range(300)]
    with open(tmp_path / "t.csv", "w", newline="") as f:
        csv.writer(f).writerows([[f"c{k}" for k in range(7)], *rows])
    got, names = wide.wide_rows(spark, [f"file://{tmp_path}/t.csv"])
    assert names == [f"c{k}" for k in range(7)]
    assert [[x or "" for x in r["cells"]] for r in got.collect()] == rows


def test_rows_unfold_by_their_header(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"r{k}.csv").write_text(f"id,q1_p,other,q0_t,q0_p\n{k},0.5,x,\"a,b\",\n")
    rows, names = wide.wide_rows(spark, wide.expected_files(spark, f"file://{tmp_path}", "*.csv", 2))
    got = wide.unfolded(rows, names, {"id": "int"}, r"q(\d+)_(\w)", {"p": "double", "t": "string"}).orderBy("id", "item").collect()
    assert [tuple(r) for r in got] == [(0, 0, None, "a,b"), (0, 1, 0.5, None), (1, 0, None, "a,b"), (1, 1, 0.5, None)]
    with pytest.raises(ValueError, match="nothing"):
        wide.unfolded(rows, names, {"nothing": "int"}, r"q(\d+)_(\w)", {"p": "double"})


def test_other_numbers_of_files_and_fields_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n")
    for n in (0, 2):
        with pytest.raises(ValueError, match="files"):
            wide.expected_files(spark, f"file://{tmp_path}", "*.csv", n)
    with pytest.raises(Exception, match="a row of 1 fields"):
        wide.wide_rows(spark, [f"file://{tmp_path}/a.csv"])[0].agg(F.max("cells")).collect()
