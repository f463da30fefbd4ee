"""Operator 9, n-gram Jaccard join: a parity-sketch join of word-shingle sets, exact for the threshold.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D, A-Z lower-cased; a document's set holds its
distinct shingles of five words as 64-bit hashes (a document with fewer words: all of them as one).

*Sketch.* In a size band with ``m`` cells each shingle falls into one cell, and a cell holds the XOR of its
shingles' hashes: a sketch whose Hamming distance in cells is at most the symmetric difference of the sets.
Two sets of similarity 0.75 or more differ in at most ``d = (|A| + |B|) / 7`` shingles, hence in ``d`` cells.

*Pigeonhole.* All cells of a band have one global order. A document emits its first ``d + 1`` non-empty
cells (``d`` for its largest partner). At most ``d`` of them differ in a partner, so one is the same there,
and whichever of the two prefixes ends first, the other holds that cell too: each linked pair meets in a
bucket. The order is free, so cells that a sample of documents shows to be frequent (passages that many
documents share) come last; most documents never emit them.

*Verify.* A bucket isn't expanded into its pairs. Sorted by size, it parts where the next set is more than 4/3 as large
as the one before, as no link crosses that. Each member of a part is paired with its smallest id, and the members that
have the same smallest id are a bundle. A task reads its buckets sorted and holds the ids of one part; buckets of
frequent cells, of bounded number, are not dealt by their key at all but parted by size class (a set goes to its own and
the one above, so that any two that may link share one): their smallest ids are partial aggregates. The pairs are first held against parity sketches of single bits, one or more a
shingle, whose Hamming distance also bounds the symmetric difference from below; what passes is tested on the full
sets. Links give components. Only bundles whose members are still in several components go on: of the pairs across
components that the bit sketches allow, some of each two components are tested, more of them each round, until none
is left. A bundle is dealt in squares of :data:`SQUARE` by as many members, so none is a task of its own. So every pair that meets in a bucket ends in one component, or fails a sketch or the test itself.

Bands are ``8**k``; a pair of sets on two sides of a band's end meets in the upper band. Documents with equal
sets within a partition of the input are linked at once and only the first of them emits cells.

Defined cases: null text, or text without words, has an empty set and links to nothing; rows that share a
doc_id are one node of the graph, each keeps a row; a null doc_id has a null component; an empty table gives
no rows; other columns are ignored. Shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small, stored
from quillspark.llm.components import connected

WORDS = 5
#: Frequent cells that are told to all tasks: at most so many, from a document in so many.
FREQUENT_CELLS, SAMPLE_ONE_IN = 65_536, 16
#: Members of a bundle that meet as many others in one go.
SQUARE = 1024
#: Pairs of which a task drops the repeated ones in one go.
PAIRS = 500_000
#: Text that is hashed in one go.
_CHUNK = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(5).integers(1 << 62, size=256, dtype=np.uint64) | np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.random.default_rng(6).integers(1 << 62, size=64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size + 4 * len(texts[at] or "") < _CHUNK):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        yield from _hashed(parts, words)


def _hashed(parts: list[bytes], words: int) -> Iterator[np.ndarray]:
    b = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    up, down = _places(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up, dtype=np.uint64)])
    edge = np.diff(np.concatenate([[0], (~_SEPARATOR[b]).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    upto = np.searchsorted(first, ends)
    if len(word) >= words:
        n = len(word) - words + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += word[k : k + n] * _PLACES[k]
        rolled = mix(rolled)
    lo = 0
    for hi in upto.tolist():
        k = hi - lo
        if k >= words:
            yield np.unique(rolled[lo : hi - words + 1])
        elif k:
            yield mix((word[lo:hi] * _PLACES[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k))
        else:
            yield np.zeros(0, np.uint64)
        lo = hi


def cells_of(size: int, scale: int) -> Iterator[int]:
    """Numbers of cells of the bands in which a set of this size meets its partners."""
    band = max(1, (size.bit_length() - 1) // 3 if size else 0)  # below 64, below 512, ...
    for k in (band, band + 1) if size * 4 // 3 >= 8 ** (band + 1) else (band,):
        yield (1 << 20 if k == 1 else 8**k * 4) * scale


def emitted(shingles: np.ndarray, frequent: np.ndarray, scale: int = 1, whole: bool = False) -> tuple[np.ndarray, bool]:
    """The bucket keys of a set; False if too few of its cells are filled for them to be proof."""
    n = len(shingles)
    need = (n + 4 * n // 3) // 7 + 1
    out, proof = [], True
    for m in cells_of(n, scale):
        cell = (shingles >> np.uint64(11)) % np.uint64(m)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        held = np.bitwise_xor.reduceat(shingles[order], starts)
        cell, held = cell[starts][held != 0], held[held != 0]
        proof &= len(held) >= need
        key = mix(held ^ mix(cell * np.uint64(2 * m + 1))).view(np.int64)
        if not whole and len(key) > need:
            late = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key if len(frequent) else np.zeros(len(key), bool)
            key = key[np.argsort(late, kind="stable")[:need]]
        out.append(key)
    return np.concatenate(out), proof


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles at each of at least one bit a shingle, a power of two of them."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    place = (shingles >> np.uint64(17)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference: Hamming distance, the longer sketch folded to the shorter."""
    n = min(len(x), len(y))

    def folded(z: bytes) -> int:
        v, size = int.from_bytes(z, "little"), len(z)
        while size > n:
            size //= 2
            v = (v >> 8 * size) ^ (v & ((1 << 8 * size) - 1))
        return v

    return (folded(x) ^ folded(y)).bit_count()


_ROW = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
_ROW_DDL = "kind byte, a long, b long, n long, bits binary"
#: Rows between the stages: a document (a: id, n: size, bits: its sketch if it emits cells), a link (a, b), a bucket's
#: member (first a: bucket, then a: the smallest id of its part; b: id), a document whose cells prove nothing, a member of a
#: frequent cell's bucket (a: bucket; b: id).
DOC, LINK, MEMBER, WEAK, HOT = range(5)


def _rows(kind: int, a, b, n, bits=None) -> pa.RecordBatch:
    a = pa.array(a, pa.int64())
    bits = pa.nulls(len(a), pa.binary()) if bits is None else pa.array(bits, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), a, pa.array(b, pa.int64()), pa.array(n, pa.int64()), bits], schema=_ROW)


def _sketches(frequent: np.ndarray, scale: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 512):
                sizes, links, members, weak, bits = [], [], [], [], []
                for doc, x in zip(ids[lo : lo + 512], shingle_sets(texts[lo : lo + 512].to_pylist(), words), strict=True):
                    sizes.append(len(x))
                    bits.append(None)
                    if doc is None or not len(x):
                        continue
                    same = seen.setdefault((len(x), int(x.sum(dtype=np.uint64)), int(mix(x + np.uint64(77)).sum(dtype=np.uint64))), doc)
                    if same != doc:
                        links.append((doc, same))
                        continue
                    keys, proof = emitted(x, frequent, scale)
                    members.append((keys, doc, len(x)))
                    bits[-1] = bit_sketch(x)
                    if not proof:
                        weak.append(doc)
                yield _rows(DOC, ids[lo : lo + 512], [None] * len(sizes), sizes, bits)
                if links:
                    yield _rows(LINK, *zip(*links, strict=True), [0] * len(links))
                if weak:
                    yield _rows(WEAK, weak, weak, [0] * len(weak))
                if members:
                    count = [len(k) for k, _, _ in members]
                    key, doc, n = np.concatenate([k for k, _, _ in members]), np.repeat([d for _, d, _ in members], count), np.repeat([n for _, _, n in members], count)
                    hot = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key if len(frequent) else np.zeros(len(key), bool)
                    for kind, own in ((MEMBER, ~hot), (HOT, hot)):
                        if own.any():
                            yield _rows(kind, key[own], doc[own], n[own])

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sizes allow a similarity of 0.75."""
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a part of a bucket: the part's smallest id. Rows come sorted by a, n and b; other kinds pass.

    Held are the ids of the part that is open, and of the pairs at most twice :data:`PAIRS`.
    """
    open_ = [np.zeros(0, np.int64)] * 3
    held, rows = np.zeros((2, 0), np.int64), 0

    def paired(key: np.ndarray, doc: np.ndarray, n: np.ndarray, last: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """The pairs of all parts that have ended, and the rows of the one that has not."""
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (3 * n[1:] > 4 * n[:-1])]))
        end = len(key) if last else starts[-1]
        rest = [x[end:] for x in (key, doc, n)]
        doc, starts = doc[:end], starts[starts < end]
        if not len(doc):
            return np.zeros((2, 0), np.int64), rest
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, end)))
        return np.stack([least, doc])[:, least != doc], rest

    for b in batches:
        is_member = pa.compute.equal(b.column(0), MEMBER)
        if (other := b.filter(pa.compute.invert(is_member))).num_rows:
            yield other
        own = [c.to_numpy(zero_copy_only=False) for c in b.filter(is_member).columns[1:4]]
        if not len(own[0]):
            continue
        pairs, open_ = paired(*[np.concatenate([x, y]) for x, y in zip(open_, own, strict=True)], False)
        # Copies meet in many buckets: pairs go on once in so many.
        held = np.concatenate([held, pairs], axis=1)
        if held.shape[1] >= rows + PAIRS:
            held = np.unique(held, axis=1)
            if (rows := held.shape[1]) >= PAIRS:
                yield _rows(MEMBER, held[0], held[1], np.zeros(rows, np.int64))
                held, rows = held[:, :0], 0
    if len(open_[0]):
        held = np.concatenate([held, paired(*open_, True)[0]], axis=1)
    if held.shape[1]:
        held = np.unique(held, axis=1)
        yield _rows(MEMBER, held[0], held[1], np.zeros(held.shape[1], np.int64))


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), "<u8").reshape(len(bits), -1)


def _candidates(n: np.ndarray, comp: np.ndarray, bits: list[bytes], side: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows of other components, and of another side if any, whose size and sketch allow a link."""
    size = np.array([len(b) for b in bits])
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        own = _words([bits[i] for i in at])
        twice = np.flatnonzero(size == 2 * length)
        more = _words([bits[i] for i in twice]) if len(twice) else np.zeros((0, 2 * own.shape[1]), "<u8")
        both = np.concatenate([own, more[:, : own.shape[1]] ^ more[:, own.shape[1] :]])
        where = np.concatenate([at, twice])
        sizes, comps = n[where], comp[where]
        for k in range(len(at)):
            rest = slice(k + 1, None)
            able = (comps[rest] != comps[k]) & _near(sizes[rest], sizes[k])
            if side is not None:
                able &= side[where][rest] != side[where[k]]
            hit = np.flatnonzero(able) + k + 1
            if len(hit):
                apart = np.bitwise_count(both[hit] ^ both[k]).sum(axis=1, dtype=np.int64)
                hit = hit[7 * apart <= sizes[hit] + sizes[k]]
            if len(hit):
                yield int(where[k]), where[hit]


_NEXT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each square (the first three columns) from sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in range(3)])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            if held and tuple(keys[:, lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = tuple(keys[:, lo])
    if held:
        yield pa.Table.from_batches(held)


def _between(most: int):
    """In each square, pairs of different components that may link: ``most`` of each two components at most, and if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _squares(batches):
            row, column, doc, n, comp, side = (table.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6))
            seen: dict[tuple, int] = {}
            out: list[tuple] = []
            for x, others in _candidates(n, comp, table.column(7).to_pylist(), side if row[0] != column[0] else None):
                for y in others.tolist():
                    pair = (min(comp[x], comp[y]), max(comp[x], comp[y]))
                    seen[pair] = count = seen.get(pair, 0) + 1
                    if count <= most:
                        out.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
            if out:
                a, b = zip(*out, strict=True)
                more = any(c > most for c in seen.values())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([more] * len(a))], schema=_NEXT)

    return run


def squares(open_: DataFrame) -> DataFrame:
    """Members (a, b, n, component, bits) of bundles, dealt so that every two of a bundle meet in a square (a, i, j)."""
    sizes = open_.groupBy("a").agg(F.ceil(F.count("*") / SQUARE).alias("parts"))
    dealt = open_.join(sizes, "a").withColumn("side", F.pmod(F.xxhash64("b"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("a", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "b", "n", "component", "side", "bits")
    return dealt.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")


def _linked(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)  # pairs come sorted by a, so a set is often that of the row before
        for b in batches:
            keep = []
            first = b.column(2)
            for lo in range(0, b.num_rows, 256):
                for k, y in enumerate(shingle_sets(b.column(3)[lo : lo + 256].to_pylist(), words), lo):
                    if (text := first[k].as_py()) != last:
                        last, x = text, next(shingle_sets([text], words))
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(len(y) > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = pa.compute.add(b.column(2), b.column(3)).to_pylist()
        keep = [7 * bits_apart(x.as_py(), y.as_py()) <= n for n, x, y in zip(sizes, b.column(4), b.column(5), strict=True)]
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def possible(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bit sketches are near enough for a link."""
    sketches = found.where((F.col("kind") == DOC) & F.col("bits").isNotNull())
    x = sketches.select("a", F.col("n").alias("na"), F.col("bits").alias("x"))
    y = sketches.select(F.col("a").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_possible, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose documents' full sets link."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    # Texts travel, not sets: hashes don't compress.
    texts = stored(docs.join(small(ids), "id", "left_semi").select("id", "text"), "jaccard-texts")
    x, y = texts.toDF("a", "x"), texts.toDF("b", "y")
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_linked(words), "a long, b long").distinct()


def _frequent(docs: DataFrame, words: int, scale: int) -> np.ndarray:
    """Cells that four or more documents of a sample hold, the most frequent of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                keys = [emitted(x, np.zeros(0), scale, whole=True)[0] for x in shingle_sets(b.column(1)[lo : lo + 512].to_pylist(), words) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], names=["key"])

    sample = docs.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(SAMPLE_ONE_IN)) == 0))
    counts = sample.mapInArrow(run, "key long").groupBy("key").count().where("count >= 4")
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("count"), "key").limit(FREQUENT_CELLS).collect()], np.int64))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scale = 1
    while True:
        frequent = _frequent(docs, words, scale)
        keyed = docs.mapInArrow(_sketches(frequent, scale, words), _ROW_DDL)
        # Only a bucket's members must meet; other rows are dealt evenly.
        spread = F.when(F.col("kind") != MEMBER, F.xxhash64("a", "b")).otherwise(F.col("a"))
        found = stored(keyed.repartition(spread).sortWithinPartitions("a", "n", "b").mapInArrow(_bundles, _ROW_DDL), "jaccard")
        if found.where(F.col("kind") == WEAK).limit(1).count() == 0:
            break
        scale *= 4  # with more cells fewer shingles share one; with one each, all are proof
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9)
    hot = found.where(F.col("kind") == HOT).select(F.col("a").alias("key"), "n", "b", F.explode(F.array(size_class, size_class + 1)).alias("class"))
    least = stored(hot.groupBy("key", "class").agg(F.min("b").alias("a"), F.count("*").alias("members")).where("members > 1").select("key", "class", "a"), "jaccard-firsts")
    hot = hot.join(small(least), ["key", "class"]).where("a <> b").select("a", "b")
    bundles = stored(found.where(F.col("kind") == MEMBER).select("a", "b").unionByName(hot).distinct(), "jaccard-bundles")
    pairs = stored(possible(found, bundles), "jaccard-pairs")
    links = stored(found.where(F.col("kind") == LINK).select("a", "b").unionByName(verified(docs, pairs, words)), "jaccard-links")
    components = connected(links)
    # A bundle's smallest id has been tested against all its members; two members in different components have not.
    members = stored(bundles.join(bundles.groupBy("a").count().where("count > 1").select("a"), "a", "left_semi"), "jaccard-members")
    sketches = found.where((F.col("kind") == DOC) & F.col("bits").isNotNull()).select(F.col("a").alias("b"), "n", "bits")
    most = 16
    while True:
        placed = members.join(components.withColumnRenamed("node", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
        mixed = placed.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("a")
        open_ = placed.join(mixed, "a", "left_semi").select("a", "b", "component").join(sketches, "b").select("a", "b", "n", "component", "bits")
        tests = stored(squares(open_).mapInArrow(_between(most), "a long, b long, more boolean"), "jaccard-between")
        more = stored(verified(docs, tests.select("a", "b").distinct(), words), "jaccard-links")
        if more.limit(1).count():
            components = connected(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        if tests.where("more").limit(1).count() == 0:
            break
        most *= 16
    sizes = found.where(F.col("kind") == DOC).select(F.col("a").alias("node"), F.col("n").alias("n_shingles"))
    return sizes.join(components, "node", "left").select(F.col("node").alias(id_col), "n_shingles", F.coalesce("component", "node").alias("component_id"))


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
