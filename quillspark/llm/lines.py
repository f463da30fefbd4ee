"""Operator 4, line dedup: a segment-partition edit join over the distinct lines of a corpus.

A line occurrence is dropped if the same line occurs earlier, or if another line within ``max_edits``
character edits has its first occurrence earlier; earlier is by (doc_id, hash of the text, line number).
Lines of fewer than ``min_chars`` characters count as equal only when they are the same; blank lines stay.

*Join.* Lengths fall into blocks of :data:`BLOCK`; a block fixes ``max_edits + 1`` disjoint segments of one length, the
last of them counted from the end. Of two lines within the threshold the shorter one's segments are touched by at most
``max_edits`` edits, so the longer one holds one of them unchanged, shifted by no more than the edits before it. Every
line emits its segments as index keys of its block, and as probes the shifted ones, and those of the block below where
its length is in reach of that. Keys are 64-bit hashes; those that one line alone holds go at once.

*Groups.* A line goes if ANY earlier line is near, so pairs are a means only. A key's group of at most ``most`` lines is
paired within. The lines of a larger one are cut again without the shared segment, and their second keys extend the
first, so lines that share one passage and differ elsewhere part at once. A group that stays large has its earliest
line as pivot: every other line is verified against it, which settles those near it, and then splits by where it leaves
the pivot: the places that it reaches after 0, 1 or 2 edits (each as late as possible), with its own character there.
Two lines within two edits share such a place, or the later one is near the pivot (tests hold it exhaustively over
short strings; beyond two edits there is no split). So variants of one line that differ by a word part too. What then
meets must agree in letter counts, and is compared by a banded bit-parallel edit distance: one word holds the band.
All of it is DataFrame expressions; no group of lines is gathered, no Python runs on rows.

Defined cases: null text stays null with no lines; empty text is one blank line; rows with the same doc_id and
the same text count as one occurrence and get the same result; a null doc_id sorts after all others; an empty
table gives no rows; other columns are carried by :func:`dedup_lines` whatever their names, except ``n_lines`` and
``n_dropped``, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import free, small, stored

#: Lengths of a block.
BLOCK = 16
#: Letters that are counted for the filter, 7 bits each.
_LETTERS = "enaotris"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shared(a: Column, b: Column, size: Column, from_end: bool) -> Column:
    """How many characters, at most ``size``, the beginnings (or ends) of two strings share: by halving steps."""
    steps = F.reverse(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) + 1)).cast("int"))))

    def part(x: Column, n: Column) -> Column:
        return F.substr(x, F.char_length(x) - n + 1, n) if from_end else F.substr(x, F.lit(1), n)

    def step(p: Column, k: Column) -> Column:
        n = p + F.expr("1").cast("int") * F.pow(F.lit(2), k).cast("int")
        return F.when((n <= size) & (part(a, n) == part(b, n)), n).otherwise(p)

    return F.aggregate(steps, F.lit(0), step)


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings if it is at most ``most``, else ``most + 1``.

    Shared beginnings and ends go first. Then a bit vector of the ``2 * most + 1`` diagonals moves down one
    row a column; the distance is followed along the lowest diagonal and then along the last row.
    """
    lo = F.least(F.char_length(a), F.char_length(b))
    width, mask, top = 2 * most + 1, (1 << 2 * most + 1) - 1, 2 * most
    wide = F.abs(F.char_length(a) - F.char_length(b)) > most

    def trimmed(p: Column) -> Column:
        return _let(F.struct(p.alias("p"), _shared(a, b, lo - p, True).alias("s")), cut)

    def cut(t: Column) -> Column:
        def middle(x: Column) -> Column:
            # The same end on both keeps the distance and makes the first string longer than the band is deep.
            return F.split(F.concat(F.substr(x, t["p"] + 1, F.char_length(x) - t["p"] - t["s"]), F.lit("\u0001" * (most + 1))), "")

        return _let(F.struct(middle(a).alias("x"), middle(b).alias("y")), fold)

    def fold(t: Column) -> Column:
        x, y = t["x"], t["y"]
        n = F.size(x)
        start = F.struct(F.lit(mask & ~((1 << width - most - 1) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(most).cast("long").alias("d"))

        def column(acc: Column, i: Column) -> Column:
            equal = None
            for k in range(width):
                at = i - most + k
                bit = F.when((at >= 0) & (at < n) & (F.get(x, at) == F.get(y, i)), F.lit(1 << k)).otherwise(0).cast("long")
                equal = bit if equal is None else equal.bitwiseOR(bit)

            def diagonal(eq: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                return (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask).cast("long"))

            def flip(v: Column) -> Column:
                return v.bitwiseXOR(F.lit(mask).cast("long"))

            def horizontal(d0: Column) -> Column:
                hp = acc["vn"].bitwiseOR(flip(d0.bitwiseOR(acc["vp"])))
                return _let(F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(acc["vp"]).alias("hn")), finish)

            def finish(h: Column) -> Column:
                down = F.shiftright(h["d0"], 1)
                place = F.pow(F.lit(2.0), F.lit(top - 1) - (i - (n - most))).cast("long")
                on_last = F.when(h["hp"].bitwiseAND(place) != 0, 1).when(h["hn"].bitwiseAND(place) != 0, -1).otherwise(0)
                step = F.when(i < n - most, F.when(h["d0"].bitwiseAND(F.lit(1 << top).cast("long")) == 0, 1).otherwise(0)).otherwise(on_last)
                return F.struct(h["hn"].bitwiseOR(flip(down.bitwiseOR(h["hp"]))).alias("vp"), down.bitwiseAND(h["hp"]).alias("vn"), (acc["d"] + step).alias("d"))

            return _let(_let(equal, diagonal), horizontal)

        return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, column, lambda acc: F.least(acc["d"], F.lit(most + 1)).cast("int"))

    return F.when(wide, F.lit(most + 1)).otherwise(_let(_shared(a, b, lo, False), trimmed))


def _keys(line: Column, n: Column, edits: int, least: int) -> Column:
    """(probe, key, at, size) of a line: its segments in its own block, shifted ones there, and both in the block below if in reach."""
    parts = edits + 1

    def of(block: Column, below: bool) -> list[Column]:
        size = F.floor(block / parts).cast("int")
        out = []
        for k in range(parts):
            for shift in range(max(1, edits) if 0 < k < edits else 1):
                begins = n - size if k == edits else size * k + shift
                begins = begins if isinstance(begins, Column) else F.lit(begins)
                key = F.xxhash64(F.lit(k), block, F.substr(line, begins + 1, size))
                out.append(F.struct(F.lit(below or shift > 0).alias("probe"), key.alias("key"), begins.cast("int").alias("at"), size.alias("size")))
        return out

    own = (n - F.pmod(n, F.lit(BLOCK))).cast("int")
    lower = F.when((n - own < edits) & (own - BLOCK >= least - least % BLOCK), F.array(*of(own - BLOCK, True))).otherwise(F.array().cast("array<struct<probe:boolean,key:bigint,at:int,size:int>>"))
    return F.concat(F.array(*of(own, False)), lower)


def _reached(x: Column, c: Column, edits: int) -> Column:
    """Where ``x`` leaves ``c`` after 0 to ``edits`` edits, each made as late as possible: (place in ``c``, character of ``x``)."""
    start = F.struct(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))).alias("front"), F.array().cast("array<struct<j:int,own:string>>").alias("at"))

    def slide(f: Column) -> Column:
        a, b = F.substr(x, f["i"] + 1, F.char_length(x)), F.substr(c, f["j"] + 1, F.char_length(c))
        run = _let(F.struct(a.alias("a"), b.alias("b")), lambda t: _shared(t["a"], t["b"], F.least(F.char_length(t["a"]), F.char_length(t["b"])), False))
        return _let(run, lambda r: F.struct((f["i"] + r).alias("i"), (f["j"] + r).alias("j")))

    def step(acc: Column, _: Column) -> Column:
        def both(slid: Column) -> Column:
            left = F.transform(slid, lambda f: F.struct(f["j"].alias("j"), F.substr(x, f["i"] + 1, F.lit(1)).alias("own")))
            return F.struct(spread(slid).alias("front"), F.array_union(acc["at"], left).alias("at"))

        return _let(F.transform(acc["front"], slide), both)

    def spread(slid: Column) -> Column:
        ways = F.flatten(F.transform(slid, lambda f: F.array(*[F.struct((f["i"] + di).alias("i"), (f["j"] + dj).alias("j")) for di, dj in ((1, 1), (1, 0), (0, 1))])))
        return F.array_distinct(F.filter(ways, lambda f: (f["i"] <= F.char_length(x)) & (f["j"] <= F.char_length(c))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(edits)), start, step, lambda acc: acc["at"])


def _letters(line: Column, n: Column) -> Column:
    """Counts of some letters modulo 128, packed into a long."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(_LETTERS):
        count = n - F.char_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(F.pmod(count, F.lit(128)).cast("long"), 7 * k))
    return out


def _letters_apart(a: Column, b: Column) -> Column:
    total = F.lit(0).cast("long")
    for k in range(len(_LETTERS)):
        x, y = (F.shiftright(v, 7 * k).bitwiseAND(F.lit(127).cast("long")) for v in (a, b))
        total = total + F.least(F.pmod(x - y, F.lit(128)), F.pmod(y - x, F.lit(128)))
    return total


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each line occurrence that isn't blank: its place, its text, length and two hashes."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.where(F.length(F.trim("line")) > 0)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "th", "pos").alias("place")
    return rows.select("doc", "th", "pos", place, "line", F.char_length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(9), "line").alias("h2"))


def once(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """One occurrence of each distinct line: what doesn't repeat, and of the rest the first."""
    joined = lines.join(small(repeated.select("h1", "h2", "n", "first")), ["h1", "h2", "n"], "left")
    return joined.where(F.col("first").isNull() | (F.col("place") == F.col("first"))).drop("first")


def _met(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of groups (key) with two lines or more and an index key, and the group's ``members``."""
    rows = stored(rows, f"line-{name}")
    live = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("probe").alias("probes")).where("members > 1 and not probes").select("key", "members")
    return stored(rows.join(small(stored(live, "line-live")), "key"), "line-met")


def _refined(met: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """Groups extended by the keys of what is left of a line without the segment that the group shares."""
    rows = met.join(texts.select("h1", "line"), "h1")
    rest = F.concat(F.substr("line", F.lit(1), F.col("at")), F.substr("line", F.col("at") + F.col("size") + 1, F.char_length("line")))
    rows = rows.select("h1", "place", "probe", "key", F.inline(F.array(F.struct(rest.alias("rest")))))
    rows = rows.select("h1", "place", F.col("probe").alias("p"), F.col("key").alias("k"), F.inline(_keys(F.col("rest"), F.char_length("rest"), max_edits, BLOCK)))
    return rows.select(F.xxhash64("k", "key").alias("key"), (F.col("p") | F.col("probe")).alias("probe"), "h1", "place")


def _parted(groups: DataFrame, texts: DataFrame, max_edits: int) -> tuple[DataFrame, DataFrame]:
    """Large groups split by where their lines leave the group's earliest; and the lines that are near that."""
    pivots = groups.groupBy("key").agg(F.min(F.struct("place", "h1")).alias("top")).select("key", F.col("top.h1").alias("pivot"))
    pivots = stored(pivots, "line-pivots")
    about = groups.select("key", "h1", "place").distinct().join(small(pivots), "key").where("h1 <> pivot")
    heads = stored(texts.join(small(stored(pivots.select(F.col("pivot").alias("h1")).distinct(), "line-ids")), "h1", "left_semi").select(F.col("h1").alias("pivot"), F.col("line").alias("c")), "line-heads")
    both = about.join(texts.select("h1", F.col("line").alias("x")), "h1").join(small(heads, weight=F.octet_length("c")), "pivot")
    near = banded_distance(F.col("x"), F.col("c"), max_edits) <= max_edits
    left = F.transform(_reached(F.col("x"), F.col("c"), 2), lambda f: F.xxhash64("key", f["j"], f["own"]))
    split = stored(both.select("h1", "place", near.alias("near"), F.explode(left).alias("key")), "line-split")
    # Only lines before one that is still open can be its witness.
    open_ = split.groupBy("key").agg(F.min("place").alias("lo"), F.max(F.when(~F.col("near"), F.col("place"))).alias("hi")).where("lo < hi").select("key", "hi")
    kept = split.join(small(stored(open_, "line-open")), "key").where("place <= hi")
    return kept.select("key", "h1", "place"), split.where("near").select("h1").distinct()


def near_later(lines: DataFrame, max_edits: int, min_chars: int, most: int = 64) -> DataFrame:
    """(h1): lines with a near line before them; ``lines`` has each distinct line once: line, n, h1, place."""
    own = lines.where(F.col("n") >= min_chars).select("h1", F.col("n").cast("int").alias("n"), "place", "line")
    met = _met(own.select("h1", "place", F.inline(_keys(F.col("line"), F.col("n"), max_edits, min_chars))), "keys")
    ids = stored(met.select("h1").distinct(), "line-ids")
    texts = stored(own.join(small(ids), "h1", "left_semi").select("h1", F.inline(F.array(F.struct("line", "n", _letters(F.col("line"), F.col("n")).alias("letters"))))), "line-texts")
    names, settled = ("key", "h1", "place"), None
    members = met.where(F.col("members") <= most).select(*names)
    if met.where(F.col("members") > most).limit(1).count():
        second = _met(_refined(met.where(F.col("members") > most), texts, max_edits), "second")
        large = F.col("members") > most if max_edits <= 2 else F.lit(False)
        parts, settled = _parted(second.where(large), texts, max_edits)
        settled = stored(settled, "line-settled")
        members = members.unionByName(second.where(~large).select(*names)).unionByName(parts)
    # A line has a bounded number of keys; two lines meet in the least of those that they share, and there alone.
    own_keys = members.groupBy("h1", "place").agg(F.collect_set("key").alias("keys"))
    members = stored(own_keys.join(texts.select("h1", "n", "letters"), "h1"), "line-members")
    if settled is not None:
        members = members.join(small(settled.withColumn("settled", F.lit(True))), "h1", "left")
    else:
        members = members.withColumn("settled", F.lit(None).cast("boolean"))
    x, y = (members.select(F.explode("keys").alias("key"), *[F.col(c).alias(f"{c}_{side}") for c in members.columns]) for side in ("x", "y"))
    wanted = (F.col("place_x") < F.col("place_y")) & (F.abs(F.col("n_x") - F.col("n_y")) <= max_edits) & (_letters_apart(F.col("letters_x"), F.col("letters_y")) <= 2 * max_edits)
    once_ = x["key"] == F.array_min(F.array_intersect("keys_x", "keys_y"))
    paired = x.join(y.where("settled_y is null"), (x["key"] == y["key"]) & wanted & once_)
    pairs = stored(paired.select(F.col("h1_x").alias("a"), F.col("h1_y").alias("b")).distinct(), "line-pairs")
    p, q = texts.select(F.col("h1").alias("a"), F.col("line").alias("x")), texts.select(F.col("h1").alias("b"), F.col("line").alias("y"))
    near = pairs.join(p, "a").join(q, "b").where(banded_distance(F.col("x"), F.col("y"), max_edits) <= max_edits).select(F.col("b").alias("h1"))
    return (near if settled is None else near.unionByName(settled)).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2, min_chars: int = 32) -> DataFrame:
    """``docs`` with the kept lines in the text column, and new columns ``n_lines`` and ``n_dropped`` (blank lines not counted)."""
    lines = lines_of(docs, id_col, text_col)
    firsts = stored(lines.groupBy("h1", "h2", "n").agg(F.min("place").alias("first"), F.count("*").alias("times")), "line-firsts")
    repeated = stored(firsts.where("times > 1"), "line-repeated")
    later = small(stored(near_later(once(lines, repeated), max_edits, min_chars).withColumn("near", F.lit(True)), "line-later"))
    marked = firsts.join(later, "h1", "left").where("times > 1 or near").select("h1", "h2", "n", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.drop("line").join(small(stored(marked, "line-marked")), ["h1", "h2", "n"]).where(F.col("near") | (F.col("place") > F.col("first")))
    doc, th, lost = free(docs.columns, "doc", "th", "lost")
    gone = stored(gone.groupBy(F.col("doc").alias(doc), F.col("th").alias(th)).agg(F.collect_set("pos").alias(lost)), "line-gone")
    text = F.col(text_col).cast("string")
    held = docs.join(small(gone, weight=4 * F.size(lost)), F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(th)), "left")
    kept = F.when(F.col(lost).isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains(F.col(lost), k)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)), F.lit(0))
    counted = {"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long")}
    return held.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in counted], *[v.alias(k) for k, v in counted.items()])


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: all documents, two edits; the kept text of each."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "text")
