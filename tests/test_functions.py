"""Kernels and expressions on small hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import arrays, labels, special, stance, text
from quillspark.operators import checks, compaction, design, models, numbering, pairs, phrases, resampling, sensitivity, stats
from quillspark.plans import designs
from quillspark.sources import tables


def one(spark, column, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_design_anchors():
    first = design.latin_hypercube(300, 8)[0]
    assert designs.LANGUAGES[min(int(first[0] * 14), 13)] == "german"
    assert min(int(first[3] * 5), 4) == 4
    assert designs.KEY_TYPES[min(int(first[6] * 4), 3)] == "numeric_zero_index"
    # Rows of one language over eight models, three precisions, six personas.
    assert sum(min(int(u * 14), 13) == 2 for u in design.latin_hypercube(300, 8)[:, 0]) * 144 == 3024
    assert (design.latin_hypercube(300, 8) == design.latin_hypercube(300, 8)).all()
    for k in range(8):
        assert sorted(np.floor(design.latin_hypercube(300, 8)[:, k] * 300).astype(int)) == list(range(300))


def test_thinking_tags(spark):
    cases = {"a <think>b</think> c": ("b", "a  c", True), "x <THINK>y\nz": ("y\nz", "x", True), "plain": ("", "plain", False), "<think>1</think>m<think>2</think>": ("1\n2", "m", True)}
    for x, (hidden, visible, has) in cases.items():
        got = one(spark, text.hidden_and_visible(F.col("x")), row=(x,))
        assert (got["hidden"], got["visible"], got["has_hidden"]) == (hidden, visible, has)


def test_unicode_words(spark):
    assert one(spark, text.word_count(F.col("x")), row=("Été naïve l'eau 3-4",)) == 4


def test_permuted_options(spark):
    keys, names = F.array(*map(F.lit, "1234")), F.array(*map(F.lit, "abcd"))
    assert one(spark, text.options(keys, names, F.lit(3))) == "4. d\n3. c\n2. b\n1. a"


def test_softmax_and_entropy(spark):
    p = one(spark, arrays.softmax(F.array(*[F.lit(float(k)) for k in (1, 2, 3, 4)])))
    assert abs(sum(p) - 1) < 1e-12 and p.index(max(p)) == 3
    assert one(spark, arrays.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(float("nan"))))) == pytest.approx(math.log(2))
    assert one(spark, arrays.margin(F.array(F.lit(0.7)))) is None
    assert one(spark, arrays.canonical(F.array(F.lit(0.0), F.lit(0.0)), F.lit(2))) is None


def test_calibration_bins(spark):
    assert [one(spark, labels.decile(F.lit(p))) for p in (0.0, 0.5, 0.999, 1.0)] == [0, 5, 9, 9]


def test_stances(spark):
    options = ["1", "2", "3", "4"], ["strongly disagree", "disagree", "agree", "strongly agree"]
    cases = {"I strongly disagree": 0, "I disagree.": 1, "agree\nno, strongly agree": 3, "Answer: 2": 1, "2. maybe": 1, "nothing": None, "": None, None: None, "disagree then agree": 2}
    cases |= {"agree. Strongly disagree": 0, "**3.** fine": 2, "**3. fine": 2, "Option 4": 3, "Choice = 11": None, "2) strongly agree": 3, "disagreeable": None, "1\n2\n3": 2, "a\nb\nagree\nc\nd\ne\nf\ng": None}
    cases |= {"My stance is: 2": None, "Position: **4**": 3, "choice - 1": 0, "I strongly\nagree": None, "see 2. above": None, "so 3. agree": 2, "Answer: 1\nanswer: 2\r\n": 1, "1) agree or 2": 2, "ANSWER 3": 2, "strongly agree, option 1": 0}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", stance.explicit_stance(F.col("x"), *options).alias("v")).collect()
    assert {r["x"]: r["v"] for r in got} == cases


def test_chi_square_tail_of_many_strata(spark):
    from quillspark.operators import sensitivity

    for x, k in ((200.0, 100), (3000.0, 3), (10.0, 1), (0.0, 5), (500.0, 400), (90.0, 64)):
        got = one(spark, sensitivity.log10_tail(F.lit(x), F.lit(k)))
        assert got == pytest.approx(special.chi2_log10_tail(x, k), rel=1e-9, abs=1e-9)


def test_lines_keep_their_digits(spark):
    assert one(spark, text.last_lines(F.col("x"), 3), row=("a\n1 b 1\n2) c 2\n3",)) == ["1 b 1", "2) c 2", "3"]
    assert one(spark, text.hidden_and_visible(F.col("x"))["hidden"], row=("<think>0 a 0</think>x<think>1 b 1</think>",)) == "0 a 0\n1 b 1"


def test_p_values_as_text(spark):
    logs = [0.0, -0.5, -1.506, -2.0, -3.3, -3.9999, -4.0, -17.6, float("nan"), None]
    got = [r["v"] for r in spark.createDataFrame([(v,) for v in logs], "x double").select(labels.p_text(F.col("x")).alias("v")).collect()]
    assert got == [f"{10**v:.3g}" for v in logs[:6]] + ["1e-4", "1e-18", "n/a", "n/a"]


def test_repeated_keys_of_a_side_fail(spark):
    df = spark.createDataFrame([(1, "l", 1.0, 9.0), (1, "l", 5.0, 2.0), (1, "r", 3.0, 3.0)], "k int, s string, a double, b double")
    with pytest.raises(Exception, match="several rows"):
        pairs.matched(df, ["k"], F.col("s"), "l", "r", ["a", "b"]).collect()
    assert pairs.matched(df.where("a > 1"), ["k"], F.col("s"), "l", "r", ["a"]).collect()[0].asDict() == {"k": 1, "a_left": 5.0, "a_right": 3.0}


def test_special_functions():
    assert special.f_log_tail(3.0, 2, 10) == pytest.approx(math.log(0.0953674), abs=1e-5)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.chi2_log10_tail(10.0, 1) == pytest.approx(math.log10(math.exp(-5)))
    assert special.chi2_log10_tail(3000.0, 3) < -600
    odds, p = special.fisher_exact_greater(8, 2, 1, 5)
    assert odds == 20 and p == pytest.approx(0.0244755, abs=1e-6)


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, float("nan"))], "k int, p double")
    got = {r["k"]: r["q_value"] for r in stats.benjamini_hochberg(df, [], "p").collect()}
    assert got[1] == pytest.approx(0.03) and got[2] == pytest.approx(0.04) and got[3] == pytest.approx(0.04) and got[4] is None and got[5] is None


def test_additive_anova_by_hand(spark):
    rows = [(a, b, 2.0 * a + 3 * b + e) for a in range(2) for b in range(3) for e in (-0.5, 0.5)]
    df = spark.createDataFrame(rows, "a int, b int, y double").withColumn("s", F.lit("x"))
    got = {r["term"]: r for r in sensitivity.anova_by(df, ["s"], ["a", "b"], "y").collect()}
    assert got["a"]["ss"] == pytest.approx(12.0) and got["b"]["ss"] == pytest.approx(72.0) and got["residual"]["ss"] == pytest.approx(3.0)
    assert got["residual"]["df"] == 8 and got["a"]["df"] == 1 and got["b"]["df"] == 2


def test_resampling_does_not_hang_on_partitions(spark):
    df = spark.createDataFrame([("g", k, float(k % 7)) for k in range(40)], "g string, c int, d double")
    a, b = (resampling.bootstrap_mean(x, ["g"], F.col("d"), ["c"], 500).first() for x in (df, df.repartition(7)))
    assert a == b and a["ci_low"] < a["mean"] < a["ci_high"]


def test_compaction_variants(spark):
    log = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (2, 1, "x"), (2, 2, None), (3, 1, "x")], "k int, seq int, error string")
    bad = F.col("error").isNotNull()
    assert {r["k"] for r in compaction.any_success(log, ["k"], bad).collect()} == {1, 2}
    assert {r["k"] for r in compaction.latest_success(log, ["k"], ["seq"], bad).collect()} == {2}
    assert {(r["k"], r["seq"]) for r in compaction.first_wins(log, ["k"], ["seq"]).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(checks.ConstraintError):
        checks.assert_unique(df, ["k"])
    with pytest.raises(checks.ConstraintError):
        checks.require_columns(df, ["k"], exact=True)
    once = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    for late in (pairs.one_to_one(df, once, ["k"]), pairs.one_to_one(once, df, ["k"]), pairs.many_to_one(once, df, ["k"])):
        with pytest.raises(Exception, match="several rows of"):
            late.collect()
    assert sorted(map(tuple, pairs.one_to_one(once, once, ["k"]).collect())) == [(1, "a", "a"), (2, "b", "b")]
    assert pairs.many_to_one(df, once.withColumnRenamed("v", "w.x"), ["k"]).orderBy("v").collect() == [(1, "a", "a"), (1, "b", "a")]
    assert checks.unbalanced(df, ["v"], 1).count() == 0


def test_phrases_redact(spark):
    p = phrases.document_phrases(F.col("x"), 2, F.array(F.lit("red")), ["the"])
    assert set(one(spark, p, row=("The blue red sky the the",))) == {"blue", "the blue", "sky", "sky the"}


def test_candidate_labels(spark):
    probs = F.create_map(F.lit("A"), F.lit(0.2), F.lit("B"), F.lit(0.6))
    out = arrays.candidate_distribution(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("Yes"), F.lit(" NO")), probs, F.array(F.lit("no"), F.lit("yes")))
    assert one(spark, out) == pytest.approx([0.75, 0.25])
    assert one(spark, arrays.candidate_distribution(F.array(F.lit("A")), F.array(F.lit("x")), probs, F.array(F.lit("no")))) is None


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,f,v\n1,None,NaN\n2,,2.5\n3,NA,\n")
    got = {r["k"]: (r["f"], r["v"]) for r in tables.read_table(spark, f"file://{tmp_path}/t.csv", "k int, f string, v double").collect()}
    assert got == {1: ("None", None), 2: (None, 2.5), 3: ("NA", None)}
    assert tables.table_path(spark, "t", [f"file://{tmp_path}"]).endswith("t.csv")
    with pytest.raises(FileNotFoundError):
        tables.table_path(spark, "none", [f"file://{tmp_path}"])
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert tables.read_log(spark, f"file://{tmp_path}/log.jsonl", "a int", strict=False).count() == 2
    with pytest.raises(Exception):
        tables.read_log(spark, f"file://{tmp_path}/log.jsonl", "a int", strict=True).collect()
    (tmp_path / "corpus.jsonl").write_text('{"id": 1, "text": "x", "label": true, "target_groups": ["a", "b"]}\n{"id": 2, "text": "y", "label": false, "target_groups": ["a"]}\n')
    assert [(r["target"], r["item_index"]) for r in tables.read_corpus(spark, f"file://{tmp_path}/corpus.jsonl").orderBy("id").collect()] == [("a", 1), ("a", 2)]
    with pytest.raises(ValueError):
        tables.numeric_projection(spark.range(1), ["id", "nothing"])


def test_write_once(spark, tmp_path):
    path = f"file://{tmp_path}/once"
    first = tables.write_once(spark.range(3).toDF("a"), path, lambda t: t.count() == 3)
    again = tables.write_once(spark.range(3, 6).toDF("a"), path, lambda t: t.count() == 3)
    assert sorted(r["a"] for r in first.collect()) == sorted(r["a"] for r in again.collect()) == [0, 1, 2]


def test_points_of_rows(spark):
    rows = spark.range(97).selectExpr("id * 3 as k", "'x' as u", "1 as dim").repartition(5)
    u = np.array([r.u for r in design.row_points(rows, "k", 4).collect()])
    assert u.shape == (97, 4)
    for k in range(4):
        assert sorted(np.floor(u[:, k] * 97 + 1e-9).astype(int)) == list(range(97))
    assert abs(np.corrcoef(u.T) - np.eye(4)).max() < 0.4
    assert design.row_points(rows.where("k < 0"), "k", 4).collect() == []
    with pytest.raises(Exception, match="several rows of"):
        design.row_points(rows.unionAll(rows.limit(1)), "k", 4).collect()


def test_places_within_groups(spark):
    rows = [(k, "hot" if k % 3 else None if k % 2 else "b", 100 - k // 2) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, g string, o int").repartition(7)
    got = {r.k: r.at for r in numbering.numbered_within(df, ["g"], ["o", "k"], "at").collect()}
    for g in ("hot", "b", None):
        own = sorted((o, k) for k, own, o in rows if own == g)
        assert [got[k] for _, k in own] == list(range(len(own)))
    assert sorted(r.at for r in numbering.numbered_within(df, [], ["k"], "at").collect()) == list(range(60))
    assert numbering.numbered_within(df.where("k < 0"), ["g"], ["k"], "at").collect() == []
    scored = sensitivity.without_block(df.withColumn("s", F.col("o").cast("double")), ["g"], "k", "s", "a")
    means = {g: sum(o for _, own, o in rows if own == g) / sum(own == g for _, own, _ in rows) for g in ("hot", "b", None)}
    assert scored.count() == 60 and all(r.a == pytest.approx(means[r.g]) for r in scored.collect())


def test_positional_alignment_of_all_items(spark):
    source = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), ("b", 1, "z")], "g string, id int, v string")
    rows = spark.createDataFrame([("a", 1, "y"), ("a", 2, "other"), ("b", 1, "z")], "g string, at int, v string")
    met = pairs.positional(rows, source, "g", "at", ["id"], ["v"])
    assert sorted((r.g, r.at, r.aligned) for r in met.collect()) == [("a", 1, True), ("a", 2, False), ("b", 1, True)]
    for bad, told in ((rows.unionAll(spark.createDataFrame([("b", 2, "z")], rows.schema)), "no item at"), (rows.where("g = 'a'"), "no row for the item at")):
        with pytest.raises(Exception, match=told):
            pairs.positional(bad, source, "g", "at", ["id"], ["v"]).collect()
