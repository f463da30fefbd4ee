"""The text operators against brute force on small fixtures, with awkward rows among them."""

import io
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, components, counts, jaccard, langid, lines, media, packing, pieces, tokens, urls, warc

DOCS = "doc_id long, text string, source string"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, base.upper().replace("W", "w"), "b"), (5, None, None), (6, "", "x"), (7, "  \n\t ", "x"), (8, "one two three", "x"), (9, "ONE two\nthree", "x"),
        (10, words(6000, 2), "long"), (11, "a", None), (12, "one two three four", "x"), (None, "no id here at all", "x"), (13, words(100, 3), "c"), (13, words(100, 4), "c"), (14, base, "a"), (14, base, "a"),
    ]


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()


def brute_components(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(seed=0, n=160):
    """Families of copies at all degrees of change, and a passage that many share."""
    rng, out = random.Random(seed), []
    passage = words(30, 999)
    for k in range(n):
        if k % 4 and out:
            own = rng.choice(out)[1].split()
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
        else:
            own = words(rng.randrange(1, 150), 1000 + k).split()
        out.append((k, " ".join(own) + (" " + passage if k % 3 == 0 else "")))
    return out


@pytest.mark.parametrize("rows", [corpus(), corpus(7), [(i, t) for i, t, _ in awkward()]])
def test_jaccard_is_exact(spark, rows):
    got = jaccard.jaccard_components(spark.createDataFrame([(i, t, "z") for i, t in rows], DOCS)).collect()
    want = brute_components(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in got) == sorted((i is None, i or 0, len(shingles(t))) for i, t in rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want


@pytest.mark.parametrize(("square", "one_in"), [(1024, 16), (7, 1)])
def test_jaccard_large_group_across_components(spark, monkeypatch, square, one_in):
    """Copies of copies that drift: the group's smallest id links to few of them; with small squares and told frequent cells too."""
    monkeypatch.setattr(jaccard, "SQUARE", square)
    monkeypatch.setattr(jaccard, "SAMPLE_ONE_IN", one_in)
    own, rows = words(100, 5, 10_000).split(), []
    for k in range(80):
        own = list(own)
        own[(k * 7) % 100] = f"y{k}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(words(60, 300 + k).split() + rows[0][1].split()[:20])) for k in range(40)]
    got = jaccard.jaccard_components(spark.createDataFrame([(i, t, "z") for i, t in rows], DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_sketches_bound_the_difference():
    for a, b in ((range(100), range(20, 110)), (range(600), range(300)), (range(5), range(5, 9))):
        x, y = (jaccard.mix(np.array(list(v), np.uint64)) for v in (a, b))
        assert jaccard.bits_apart(jaccard.bit_sketch(x), jaccard.bit_sketch(y)) <= len(set(a) ^ set(b))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_components(docs).count() == 0
    assert packing.pack(docs).count() == 0
    assert lines.dedup_lines(docs).count() == 0
    assert counts.count_edited(docs).count() == 0
    assert langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit("x")))).count() == 0
    assert pieces.encode(docs).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert media.copies(spark.createDataFrame([], "media_id long, image binary")).count() == 0
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (5, 5), (None, 3), *[(k, k + 1) for k in range(100, 130)]]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 11: 10, 12: 10} | {k: 100 for k in range(101, 131)}


def test_packing_holds_every_id_once(spark):
    rows = awkward()
    library = tokens.encoder(tokens.default_tokenizer())
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), window=256, open_windows=4, merge_group=2).collect()
    want = sorted(zlib.crc32(tokens.packed([*library.by_library(t or ""), 1])) for _, t, _ in rows)
    assert sum(r["length"] for r in got) == sum(len(library.by_library(t or "")) + 1 for _, t, _ in rows)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or at < 256 and at & (at - 1) == 0
    whole = [r["ids_crc32"] for r in got if r["length"] == r["doc_tokens"]]
    assert set(whole) <= set(want)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    ids = tokens.packed([*library.by_library(rows[9][1]), 1])
    for r in by_doc[10]:
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])


@pytest.mark.parametrize("text", ["a  b", "a \nb", "\n\n x", "don't I'll", "x\t y", "hi <|endoftext|> x", "é b 日本語 🙂", "   ", "\0 a"])
def test_ids_equal_the_library(text):
    own = tokens.encoder(tokens.default_tokenizer())
    assert own.ids(text) == own.by_library(text)


def test_ids_equal_the_library_on_whole_texts(spark):
    own = tokens.encoder(tokens.default_tokenizer())
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in [*texts, " " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "\t" * 300_000 + " x"]:
        assert own.ids(text) == own.by_library(text)


def test_redactions_of_a_long_text_are_quick():
    text = "".join(f"name{k}@mail.org 1234567{k} " for k in range(100_000))
    found = counts.redactions(text)
    assert len(found) == 200_000 and counts.redactions("a@b.co 12345678 x123456@y.org") == [(0, 6, "<mail>"), (16, 29, "<mail>"), (7, 15, "<number>")]


def test_share_of_a_large_language():
    assert 0 < langid.share_of(500, 10**12) * 10**12 / langid._ALL <= 501 and langid.share_of(500, 20) == langid._ALL


def test_counts_after_edits():
    own, rng = tokens.encoder(tokens.default_tokenizer()), random.Random(1)
    for text in ["", "a", "  \n\n x   y", "one two  three\n\n\nfour 'll don't", words(200, 8), "é" * 50 + " ü ß"]:
        tree, now = counts.CountTree(text, lambda x: len(own.ids(x)) if x else 0, rng.choice([8, 40, 256])), text
        for _ in range(40):
            a = rng.randrange(len(now) + 1)
            b, new = min(len(now), a + rng.choice([0, 0, 1, 3, 30, 400])), rng.choice(["", "x", " ", "  ", "\n", "'ll", "hello world ", "é1!", " a b c d e f g h i j k" * 5])
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            assert tree.text == now and tree.total == (len(own.by_library(now)) if now else 0)


def test_counts_encode_only_regions(spark):
    text = words(2000, 9) + " mail me@example.com " + words(2000, 10)
    r = counts.count_edited(spark.createDataFrame([(1, text, "a"), (2, None, None)], DOCS)).orderBy("doc_id").collect()
    assert r[0]["n_edits"] == 1 and 0 < r[0]["n_encoded_again"] <= 3 < r[0]["n_leaves"] and r[1]["tokens_before"] == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def edited(s, k, rng):
    for _ in range(k):
        i, way = rng.randrange(len(s) + 1), rng.randrange(3)
        s = s[:i] + (rng.choice("abé") + s[i:] if way == 0 else s[i + 1 :] if way == 1 else rng.choice("abé") + s[i + 1 :])
    return s


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng, pairs = random.Random(most), []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 30)))
        pairs.append((a, edited(a, rng.randrange(0, 6), rng)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    assert [r["d"] for r in got] == [min(most + 1, levenshtein(r["a"], r["b"])) for r in got]


def brute_lines(rows):
    """(id, kept text, lines dropped, lines) of (id, text) rows by comparing every two lines."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i is None, i, p))
    order = lambda x: (x[0], x[1] or 0, x[2])
    near = {b for b in first for a in first if len(a) >= 32 and len(b) >= 32 and a != b and order(first[a]) < order(first[b]) and within(a, b, 2)}
    out = []
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for p, x in enumerate(parts) if not x.strip(" ") or (first[x] == (i is None, i, p) and x not in near)]
        out.append((i, None if t is None else "\n".join(kept), len(parts) - len(kept), sum(bool(x.strip(" ")) for x in parts)))
    return out


def test_line_dedup(spark):
    rng, rows = random.Random(3), []
    stock = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(33, 70))) for _ in range(25)]
    for i in range(40):
        rows.append((i, "\n".join(edited(rng.choice(stock), rng.randrange(0, 4), rng) if rng.random() < 0.8 else rng.choice(["short", "", "  "]) for _ in range(6)), "s"))
    rows += [(50, None, "s"), (51, "", "s"), (None, stock[0], "s"), (52, stock[1] + "\n" + stock[1], "s"), (52, stock[1] + "\n" + stock[1], "s")]
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit(-1))).collect()
    want = [(i is None, i or 0, kept is None, kept or "") for i, kept, _, _ in brute_lines([r[:2] for r in rows])]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in got) == sorted(want)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    found = langid.identify(docs, model).where("held_out").select("lang", "lang_pred", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found) and sum(r["rejected"] for r in found) <= 0.01 * len(found)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 345 !!", "x"), (None, "the and of", "x"), (4, "это совсем другой язык и другие буквы", "x")], DOCS)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3)) and not got[None]["held_out"] and got[4]["rejected"]


def test_language_id_does_not_hang_on_neighbours(spark):
    """Scores of all texts of the table and of short ones, beside others in any order, are those that each has alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    short = "si no a ok de la le chat der und el x y non oui ja nein yes the it is es ist est para por mit avec with sin sans ohne".split()
    texts = [r["text"] or "" for r in docs.select("text").collect()] + short + ["", "12", "de la", "le chat"]
    alone = [model.predict([t]) for t in texts]
    for seed in (1, 2):
        order = list(range(len(texts)))
        random.Random(seed).shuffle(order)
        lang, score, rejected = model.predict([texts[k] for k in order])
        assert lang == [alone[k][0][0] for k in order] and rejected.tolist() == [alone[k][2][0] for k in order]
        assert np.allclose(score, [alone[k][1][0] for k in order], rtol=0, atol=1e-12)


def test_own_columns_may_differ_in_case(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the line\nand more", "a"), (2, "el gato", "b")], DOCS).withColumns({"N_Lines": F.lit(1), "Held_Out": F.lit(2), "a.b": F.lit(3), "Verdict": F.lit(4)})
    lines.dedup_lines(docs).write.parquet(f"{tmp_path}/lines")
    langid.identify(docs, langid.train(["the cat " * 9, "el gato " * 9] * 5, ["en", "es"] * 5, steps=5)).write.parquet(f"{tmp_path}/lang")
    captures = docs.select("*", F.lit("http://a.org/x").alias("url"), F.lit("2024-01-05").alias("fetched"))
    entries = spark.createDataFrame([("l", False, "d:a.org", "add", "2024-01-01")], "list string, allow boolean, key string, action string, day string").withColumn("day", F.col("day").cast("date"))
    urls.filter_urls(captures, entries).write.parquet(f"{tmp_path}/urls")
    got = spark.read.parquet(f"{tmp_path}/urls")
    assert got.count() == 2 and "a.b" in got.columns and {r["verdict"] for r in got.select("verdict").collect()} == {"block"}


def test_mail_addresses_in_linear_time():
    old = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab.+-@@ _") for _ in range(rng.randrange(40)))
        assert [m.span() for m in counts.addresses(text)] == [m.span() for m in old.finditer(text)], text
    began = time.perf_counter()
    for text in ("x" * 4_000_000 + "@", "@" + "x" * 4_000_000, "x@" * 1_000_000, "a@b" * 1_000_000, "a@b.c+" * 500_000):
        list(counts.addresses(text))
    assert time.perf_counter() - began < 10


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    odd = [(1, "hello  world\n\nfoo  bar ", ""), (2, "", ""), (3, None, ""), (4, " ", ""), (5, "日本語 é漢字 \t x", ""), (6, "a" * 300 + " b", ""), (7, "x" * 30, ""), (8, "\n", ""), (9, "▁ hi", ""), (10, "🙂🙂 ok", ""), (None, words(300, 12), ""), (11, words(3000, 13), "")]
    texts = {i: t for i, t, _ in odd}
    found = pieces.encode(spark.createDataFrame(odd, DOCS))
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {i: model.encode(t) if t else [] for i, t in texts.items()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(found).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in texts.items())


def test_pieces_of_all_documents_equal_the_library(spark):
    """Ids by small blocks, and the lattice's own cuts, so that no fallback stands in for it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    table = pieces.load(pieces.default_model())
    assert pieces.in_order(table)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, block_chars=1 << 18).collect()}
    assert got == {i: model.encode(t) if t else [] for i, t in texts.items()}
    own = sorted({s for t in texts.values() for w in pieces.words_of(t or "") for s in pieces.segments_of(w, table) if 1 < len(s) <= 62})[::7]
    found = pieces.cut_words(spark.createDataFrame([(w,) for w in own], "word string"), pieces.piece_table(spark, table), "bpe", table.longest, [])
    cuts = {r["word"]: r["cuts"] for r in found.collect()}
    for w in own:
        parts = [w[a:b] for a, b in zip(c, c[1:])] if (c := cuts.get(w)) else list(w)
        assert [k for x in parts for k in ([table.table[x][0]] if x in table.table else [k for c in x for k in pieces.spelled(c, table)])] == pieces.merged(w, table)


def test_pieces_fold_a_segment_once(spark, monkeypatch):
    """In however many blocks it lies; the blocks' segments are shuffled once for folding and for the join."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    folded, plain = [], pieces.cut_words
    monkeypatch.setattr(pieces, "cut_words", lambda words, *more: folded.append(words) or plain(words, *more))
    texts = {i: f"internationalization of blocks{i % 3}, xqzv" for i in range(40)}
    found = pieces.encode(spark.createDataFrame([(i, t, "") for i, t in texts.items()], DOCS), block_chars=1)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {i: model.encode(t) for i, t in texts.items()}
    own = [r["word"] for r in folded[0].collect()]
    assert "▁internationalization" in own and len(own) == len(set(own))
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_as_words_and_segments():
    """The cuts in numpy against the rule by words, with texts that have none, and a model without any pair."""
    rng = random.Random(3)
    odd = [None, "", " ", "\n", "▁", "a", "é", "🙂", "\x00 \x00", " \n ▁\n\n  x"]
    texts = odd + ["".join(rng.choice(["a", "the", "ing", " ", "  ", "\n", "▁", "é", "日本", "🙂", "ß", ",", "\t", "\x00", "Q"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    for table in (pieces.load(pieces.default_model()), pieces.Pieces("bpe", {"a": (0, -1.0)}, {}, 1, [])):
        for some in (texts, texts[::-1], odd[:2], []):
            found, ends = pieces.cut_texts(some, table)
            expected = [[s for w in pieces.words_of(t or "") for s in pieces.segments_of(w, table)] for t in some]
            assert found.to_pylist() == [s for x in expected for s in x]
            assert ends.tolist() == list(itertools.accumulate(map(len, expected)))


def test_pieces_out_of_order_go_by_the_heap(spark):
    """abc is made of bc, which comes after it: in the order of pieces it would be missed."""
    table = pieces.Pieces("bpe", {"a": (0, -9.0), "b": (1, -9.0), "c": (2, -9.0), "abc": (3, -1.0), "bc": (4, -2.0)}, {}, 5, [])
    assert not pieces.in_order(table)
    assert pieces.merged("abc", table) == [3]
    assert pieces.segments_of("abca", table) == ["abc", "a"]


def test_viterbi_fold(spark):
    table = pieces.load(pieces.default_model(), "unigram")
    rows = [(1, "hello world internationalization", ""), (2, "🙂x y", ""), (3, "▁▁ a", "")]
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(spark.createDataFrame(rows, DOCS), kind="unigram").collect()}
    assert got == {i: [k for w in pieces.words_of(t) for k in (pieces.spelled(w, table) if len(w) == 1 else pieces.long_word(w, table))] for i, t, _ in rows}


def found_nearest(df, **more):
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).round(3)
    x[100:160] = x[7]
    x[300:500] = rng.normal(size=(1, 16)) + rng.normal(size=(200, 16)) * 0.01
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1020, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = found_nearest(df, factor=1.0, shard_rows=100, block_rows=8)
    for q in range(0, 700, 20):
        s = (x * x[q]).sum(1)
        want = sorted((-float(s[i]), i) for i in range(700) if i != q)[:20]
        assert got[q] == [(i, -v) for v, i in want]
    assert set(got) == set(range(0, 700, 20))


def test_nearest_ties_dimensions_and_huge_vectors(spark):
    flat = [(0, [1.0, 0.0])] + [(i, [1.0, i / 10]) for i in range(1, 400)]
    got = found_nearest(spark.createDataFrame(flat, "vec_id long, embedding array<double>"), factor=1.0, shard_rows=64)
    assert got[0] == [(i, 1.0) for i in range(1, 21)]
    mixed = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 1.0, 1.0]), (20, [5.0]), (21, [7.0]), (22, [-7.0]), (23, [2.0, 0.0, 0.0])]
    got = found_nearest(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"))
    assert got == {0: [(1, 6.0), (23, 2.0)], 20: [(21, 35.0), (22, -35.0)]}
    huge = [(0, [1e160, 0.0]), (1, [1.0, 1.0]), (2, [3e140, 5.0]), (3, [2e140, 0.0])]
    got = found_nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    assert got[0] == [(2, 3e300), (3, 2e300), (1, 1e160)]


def test_nearest_recall_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found_nearest(e)
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
        hit, total = hit + len(want & {i for i, _ in got[int(ids[q])]}), total + 20
    assert hit >= 0.95 * total


def test_warc_normaliser_round_trip():
    payloads = [b"", b"x", b"WARC/1.1\r\n\r\n" * 3, bytes(range(256)) * 5000]
    whole = b"".join(warc.record(k, "http://a/\r\nb", p, 3 if k == 1 else None, str(k)) for k, p in enumerate(payloads))
    target, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(zlib.compress(whole, wbits=31)), target, index, 3)[0] == 4
    import json

    for k, line in enumerate(index.getvalue().splitlines()):
        e = json.loads(line)
        fields, block = warc.read_member(target.getvalue()[e["offset"] : e["offset"] + e["length"]])
        assert block == (b"" if k == 1 else payloads[k]) and fields["warc-type"] == ("revisit" if k == 1 else "response")
    with pytest.raises(EOFError):
        warc.normalise(io.BytesIO(zlib.compress(whole[:-30], wbits=31)), io.BytesIO(), io.BytesIO())


def test_warc_decisions(spark, tmp_path):
    pages = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (7, "u", "é"), (7, "u", "é"), (None, "u", "alone")]
    got = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"] or -1, r["payload_bytes"]) for r in warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    folder = tmp_path / "warc"
    spans = warc.write_archives(warc.decided(spark.createDataFrame(pages, "page_id long, url string, html string")), str(folder), 2)
    spans.collect()
    fields = [f for x in folder.glob("*.warc.gz") for f, _, _ in warc.records(x.open("rb"))]
    known = [f["warc-record-id"] for f in fields]
    assert len(known) == 8 and len(set(known)) == 7 and {f["warc-refers-to"] for f in fields if "warc-refers-to" in f} <= set(known)
    assert got == sorted([(1, "revisit", 5, 4), (5, "response", -1, 4), (3, "revisit", 5, 4), (2, "revisit", 4, 0), (4, "response", -1, 0), (7, "response", -1, 2), (7, "response", -1, 2), (-1, "response", -1, 5)])


def test_url_filters(spark):
    entries = [("bad", False, "d:b.com", "add", "2024-01-10"), ("bad", False, "d:b.com", "remove", "2024-02-01"), ("bad", False, "d:b.com", "add", "2024-02-01"), ("bad", False, "d:b.com", "remove", "2024-03-01"), ("good", True, "p:x.b.com/en", "add", "2024-01-20"), ("one", False, "u:x.b.com/en/y?q=1", "add", "2024-01-25"), ("bad", False, None, "add", "2024-01-01"), ("none", False, "d:c.com", "remove", "2024-01-01")]
    e = spark.createDataFrame(entries, "list string, allow boolean, key string, action string, d string").withColumn("day", F.to_date("d")).drop("d")
    urls_ = [(1, "http://x.B.com./en/y", "2024-01-09", "none"), (2, "https://u@x.b.com:80/de", "2024-01-10", "block"), (3, "http://x.b.com/en/y", "2024-01-20", "allow"), (4, "http://x.b.com/en/y?q=1#f", "2024-02-15", "block"), (5, "http://b.com", "2024-02-01", "block"), (6, "http://b.com", "2024-03-01", "none"), (7, None, "2024-02-01", "none"), (8, "nonsense", "2024-02-01", "none"), (9, "http://b.com", None, "none"), (5, "http://b.com", "2024-02-01", "block"), (10, "http://notb.com/", "2024-02-01", "none")]
    c = spark.createDataFrame([(i, u, d, "old") for i, u, d, _ in urls_], "id int, url string, fetched string, verdict string")
    got = sorted((r["id"], r["verdict"]) for r in urls.filter_urls(c, e).collect())
    assert got == sorted((i, v) for i, _, _, v in urls_)


def test_url_filters_deep_paths_and_clashing_columns(spark):
    e = spark.createDataFrame([("x", False, "p:b.com/1/2/3/4/5/6/7/8/9", "add")], "list string, allow boolean, key string, action string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    names = ["top", "best", "u", "d", "_u", "_d", "key", "span", "active", "since", "list"]
    rows = [(k, u, "2024-02-01", *names) for k, u in enumerate(["http://b.com/1/2/3/4/5/6/7/8/9", "http://b.com/1/2/3/4/5/6/7/8/9/x?q", "http://b.com/1/2/3/4/5/6/7/8", "http://b.com"])]
    got = urls.filter_urls(spark.createDataFrame(rows, ["id", "url", "fetched", *names]), e).orderBy("id").collect()
    assert [r["verdict"] for r in got] == ["block", "block", "none", "none"] and all(r[n] == n for r in got for n in names)


def test_media_copies(spark):
    rng = np.random.default_rng(2)

    def image(seed):
        t = np.random.default_rng(seed).random((24, 24)) * 200
        return np.clip(media._blur(media._resized(t, 23 / 95.0)[:96, :96]), 0, 255)

    base = image(1)
    rows = [(1, base), (2, base), (3, base[6:90, 9:88] * 0.8 + 20), (4, base + rng.normal(0, 2, base.shape)), (5, image(2)), (6, np.full((64, 64), 9.0)), (7, np.full((64, 64), 9.0))]
    df = spark.createDataFrame([(i, bytearray(media.write_pgm(np.rint(np.clip(x, 0, 255))))) for i, x in rows] + [(8, None), (9, bytearray(b"no image")), (None, None)], "media_id long, image binary")
    got = {r["media_id"]: r["component_id"] for r in media.copies(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, None: None}


def reached(x, c, edits):
    """(place in c, character of x) after 0 to ``edits`` edits, each as late as possible."""
    front, out = {(0, 0)}, set()
    for _ in range(edits + 1):
        slid = set()
        for i, j in front:
            while i < len(x) and j < len(c) and x[i] == c[j]:
                i, j = i + 1, j + 1
            slid.add((i, j))
        out |= {(j, x[i : i + 1]) for i, j in slid}
        front = {(i + a, j + b) for i, j in slid for a, b in ((1, 1), (1, 0), (0, 1)) if i + a <= len(x) and j + b <= len(c)}
    return out


def test_near_lines_share_a_place_of_any_pivot(spark):
    """What lets large groups part: exhaustive over short strings, and the expression equals the plain walk."""
    words_ = ["".join(w) for n in range(6) for w in itertools.product("ab", repeat=n)] + ["".join(w) for w in itertools.product("abc", repeat=3)]
    apart = {(x, y): levenshtein(x, y) for x in words_ for y in words_}
    for c in words_:
        at = {x: reached(x, c, 2) for x in words_}
        assert all(at[x] & at[y] for (x, y), d in apart.items() if d <= 2 < apart[y, c] and c not in (x, y))
    rng, rows = random.Random(8), []
    for _ in range(200):
        c = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 25)))
        rows.append((c, edited(c, rng.randrange(0, 5), rng)))
    got = spark.createDataFrame(rows, "c string, x string").select("c", "x", lines._reached(F.col("x"), F.col("c"), 2).alias("at")).collect()
    assert all({(f["j"], f["own"]) for f in r["at"]} == reached(r["x"], r["c"], 2) for r in got)


def test_line_dedup_parts_large_groups(spark):
    """Thousands of lines that share segments: variants by a word, by a letter, and by their second half."""
    rng = random.Random(5)
    base = words(40, 77)
    found = [base]
    for k in range(1500):
        own = base.split()
        own[rng.randrange(len(own))] = "".join(rng.choice("abcdefgh") for _ in range(7))
        found.append(" ".join(own))
    found += [edited(base, rng.randrange(1, 4), rng) for _ in range(300)]
    found += [base[: len(base) // 2] + words(20, 100 + k) for k in range(600)]
    found += [edited(rng.choice(found), rng.randrange(1, 4), rng) for _ in range(300)]
    rng.shuffle(found)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(found)], DOCS)
    gone = {r["doc_id"] for r in lines.dedup_lines(df).collect() if r["n_dropped"]}

    counts_ = [np.bincount([ord(c) % 64 for c in t], minlength=64) for t in found]
    matrix = np.stack(counts_)
    want = set()
    for i in range(len(found)):
        near = np.flatnonzero(np.abs(matrix[:i] - matrix[i]).sum(1) <= 4)
        if any(found[j] == found[i] or within(found[j], found[i], 2) for j in near):
            want.add(i)
    assert gone == want


def within(a, b, k):
    """Whether two strings are within k edits: the walk reaches both ends."""
    front = {(0, 0)}
    for _ in range(k + 1):
        slid = set()
        for i, j in front:
            while i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            slid.add((i, j))
        if (len(a), len(b)) in slid:
            return True
        front = {(i + x, j + y) for i, j in slid for x, y in ((1, 1), (1, 0), (0, 1)) if i + x <= len(a) and j + y <= len(b)}
    return False


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one line that is long enough to count here\nx", "s")], DOCS)
    for name in ("doc", "th", "lost", "_gone", "h1", "line", "place"):
        got = lines.dedup_lines(df.withColumn(name, F.lit("mine"))).collect()
        assert got[0][name] == "mine" and got[0]["n_lines"] == 2
