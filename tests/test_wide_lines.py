"""Files of wide lines: the header in front, all rows, and nothing wide in a sort."""

from pyspark.sql import functions as F

from quillspark.sources import wide


def test_headers_lead_and_rows_are_sorted_narrow(spark, tmp_path):
    df = spark.range(0, 100, 1, 7).select((F.col("id") + 1).alias("k"))
    lines = wide.lines(df, "k,twice", F.concat_ws(",", "k", F.col("k") * 2), F.pmod("k", F.lit(8)), 8)
    lines.write.text(f"file://{tmp_path}/t")
    files = sorted((tmp_path / "t").glob("part-*"))
    found = [f.read_text().splitlines() for f in files]
    # Where no row goes there is the header still.
    assert len(files) == 8 and all(f[0] == "k,twice" and f.count("k,twice") == 1 for f in found)
    assert all({int(x.split(",")[0]) % 8 for x in f[1:]} == {k} for k, f in enumerate(found))
    assert sorted(int(x.split(",")[1]) for f in found for x in f[1:]) == [2 * k for k in range(1, 101)]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "concat_ws" in plan.split("Sort [")[0] and "concat_ws" not in plan.split("Sort [")[1]


def test_no_rows(spark, tmp_path):
    wide.lines(spark.range(0).toDF("k"), "k", F.col("k").cast("string"), F.pmod("k", F.lit(4)), 4).write.text(f"file://{tmp_path}/t")
    assert [f.read_text() for f in sorted((tmp_path / "t").glob("part-*"))] == ["k\n"] * 4
