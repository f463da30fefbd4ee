"""Operator 8, approximate nearest neighbours: a vantage-point tree a shard, for largest inner products.

Largest inner products are nearest neighbours after one more coordinate: with M the largest norm of all vectors, a
vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), and the squared distance is
|q|^2 + M^2 - 2 q.x. Rows go to the nearest of some pivots, one for about ``shard_rows`` rows and :data:`PIVOTS`
at most; where more rows are near one pivot, they are dealt over several shards. Each shard builds a tree once (a vantage point and the median distance
to it split a node, leaves are small) and stores it with its distance range from the pivot. A query searches the shards
of its own pivot first. The k-th distance found there, divided by ``factor``, is what another shard, by the triangle
inequality on its pivot and range, must be able to beat to be visited, and likewise a node of a tree: ``factor`` 1 is
exact search, a larger one prunes more. All index rows take part. A leaf's rows that may count are scored from the
original vectors, so the k best and their ties are decided by those scores and ids alone.

Both sides of a meeting are of bounded size: a shard, and about ``block_rows`` of its visitors. How many shards a
query visits hangs on the data: few where vectors form clusters, all of them where they are spread evenly.

Within a shard equal vectors are one point that keeps its smallest ids, k + 1 of them at most: no answer needs
more. Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, as queries or
candidates; rows with a null id take none either; vectors of several dimensions are searched each among their own;
repeated ids are candidates each, but for those of the query's own id; fewer candidates than k give fewer rows; scores
beyond the range of doubles are infinite; empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored

LEAF, PIVOTS = 128, 1024
#: Relative slack of distances and scores that are only compared to decide what is looked at.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    return rows.where(good)


def lifted(x: np.ndarray, scale: float, largest: float | None) -> np.ndarray:
    """Vectors over ``scale`` with their last coordinate: that of rows for the ``largest`` norm, 0 for queries (None)."""
    x = x / scale
    last = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(0, largest**2 - (x**2).sum(axis=1)))
    return np.concatenate([x, last[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T))


class Tree:
    """Points in an order by which each node is a range; a node: (lo, hi, vantage row, radius, inner, outer)."""

    def __init__(self, x: np.ndarray, seed: int = 0) -> None:
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        self.root = self._build(x, 0, len(x), rng) if len(x) else -1

    def _build(self, x: np.ndarray, lo: int, hi: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi, -1, 0.0, 0.0, 0.0, -1, -1))
        if hi - lo <= LEAF:
            return me
        own = self.order[lo:hi]
        vantage = int(own[rng.integers(len(own))])
        d = np.sqrt(((x[own] - x[vantage]) ** 2).sum(axis=1))
        mid = (hi - lo) // 2
        part = np.argpartition(d, mid)
        self.order[lo:hi] = own[part]
        d = d[part]
        inner = self._build(x, lo, lo + mid, rng)
        outer = self._build(x, lo + mid, hi, rng)
        self.nodes[me] = (lo, hi, vantage, float(d[:mid].max()), float(d[mid:].min()), float(d[mid:].max()), inner, outer)
        return me

    def visit(self, x: np.ndarray, queries: np.ndarray, bound: Callable[[np.ndarray], np.ndarray], factor: float, leaf: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Call ``leaf`` with queries and the rows of each leaf that may hold one nearer than ``bound`` of the query."""

        def go(node: int, active: np.ndarray) -> None:
            if node < 0 or not len(active):
                return
            lo, hi, vantage, radius, near, far, inner, outer = self.nodes[node]
            if inner < 0:
                return leaf(active, self.order[lo:hi])
            d = np.sqrt(((queries[active] - x[vantage]) ** 2).sum(axis=1))
            inside = d <= (radius + near) / 2
            for first in (True, False):
                # Each query's nearer side first, then the other with what was found there.
                for child, mine in ((inner, inside == first), (outer, inside != first)):
                    at, own = d[mine], active[mine]
                    least = np.maximum(0, at - radius) if child == inner else np.maximum(0, np.maximum(near - at, at - far))
                    go(child, own[least * factor <= bound(own) + SLACK * (at + radius + far)])

        go(self.root, np.arange(len(queries)))


class Best:
    """The k best (score, id) of each query among what was offered; ties go to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """One or more candidates a query, in any order."""
        if not len(query):
            return
        order = np.argsort(query, kind="stable")
        query, score, ids = query[order], score[order], ids[order]
        rows, starts, counts = np.unique(query, return_index=True, return_counts=True)
        k, most = self.score.shape[1], counts.max()
        place = np.repeat(np.arange(len(rows)), counts), np.arange(len(query)) - np.repeat(starts, counts) + k
        s, i = np.full((len(rows), k + most), -np.inf), np.full((len(rows), k + most), np.iinfo(np.int64).max)
        s[:, :k], i[:, :k] = self.score[rows], self.ids[rows]
        s[place], i[place] = score, ids
        pick = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows], self.ids[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)


def search(tree: Tree, points: np.ndarray, x: np.ndarray, kept: list[np.ndarray], q: np.ndarray, me: np.ndarray, scale: float, k: int, factor: float, limit: np.ndarray) -> Best:
    """The k best rows of a shard for each query, which ``limit`` (a distance) and what is found on the way bound."""
    queries, best = lifted(q, scale, None), Best(len(q), k)
    norms = (queries**2).sum(axis=1)
    # Every point has the same norm, the largest one's: |q|^2 + M^2 - 2 q.x
    square = float((points[0] ** 2).sum()) if len(points) else 0.0
    copies, starts = np.array([len(i) for i in kept], int), np.concatenate([[0], np.cumsum([len(i) for i in kept])]).astype(int)
    names = np.concatenate(kept) if kept else np.zeros(0, np.int64)

    def bound(own: np.ndarray) -> np.ndarray:
        kth = best.score[own, -1] / scale / scale
        return np.minimum(limit[own], np.sqrt(np.maximum(0, norms[own] + square - 2 * kth)))

    def leaf(own: np.ndarray, rows: np.ndarray) -> None:
        near = queries[own] @ points[rows].T
        least = np.maximum(best.score[own, -1] / scale / scale, (norms[own] + square - limit[own] ** 2) / 2) - SLACK * (norms[own] + square)
        a, b = np.nonzero(near >= least[:, None])
        if not len(a):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            score = (x[rows[b]] * q[own[a]]).sum(axis=1)
        n = copies[rows[b]]
        a, score, at = np.repeat(own[a], n), np.repeat(score, n), np.repeat(starts[rows[b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = names[at] != me[a]
        best.offer(a[other], score[other], names[at][other])

    tree.visit(points, queries, bound, factor, leaf)
    return best


def _vectors(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


def _shard(k: int, scale: float, largest: float) -> Callable[[pa.Table], pa.Table]:
    """Build one shard's tree: the stored index."""

    def build(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), _vectors(table["x"], table.num_rows)
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
        kept = [ids[a : min(b, a + k + 1)] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        x = x[starts]
        points = lifted(x, scale, largest)
        d = table["d"].to_numpy()
        return pa.table({"pivot": table["pivot"][:1], "sub": table["sub"][:1], "near": [float(d.min())], "far": [float(d.max())], "index": pa.array([pickle.dumps((Tree(points), points, x, kept))], pa.binary())})

    return build


_SHARD = "pivot long, sub long, near double, far double, index binary"
_FOUND = "query_id long, vec_id long, score double, bound double"


def _searched(k: int, factor: float, scale: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        if index.num_rows and queries.num_rows:
            tree, points, x, kept = pickle.loads(index["index"][0].as_py())
            me, q = queries["id"].to_numpy(), _vectors(queries["x"], queries.num_rows)
            best = search(tree, points, x, kept, q, me, scale, k, factor, queries["bound"].to_numpy())
            at, place = np.nonzero(best.ids != np.iinfo(np.int64).max)
            largest = float((points[0] ** 2).sum())
            kth = np.sqrt(np.maximum(0, (q / scale) ** 2 @ np.ones(q.shape[1]) + largest - 2 * best.score[:, -1] / scale / scale))
            out = [me[at], best.ids[at, place], best.score[at, place], kth[at]]
        return pa.table([pa.array(c) for c in out], names=["query_id", "vec_id", "score", "bound"])

    return run


def _placed(pivots: np.ndarray, scale: float, largest: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nearest pivot and its distance, beside the first two columns: id, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                d = distances(lifted(_vectors(part.column(1), part.num_rows), scale, largest), pivots)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(own.astype(np.int64)), pa.array(d[np.arange(len(d)), own])], names=["id", "x", "pivot", "d"])

    return run


def _visits(pivots: np.ndarray, shards: list, scale: float, factor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query (id, x, its own pivot, bound) with every other shard that its bound doesn't rule out."""
    owner, sub, near, far = (np.array([s[c] for s in shards]) for c in ("pivot", "sub", "near", "far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                q = lifted(_vectors(part.column(1), part.num_rows), scale, None)
                d = distances(q, pivots)[:, owner]
                own, bound = part.column(2).to_numpy(), part.column(3).to_numpy()
                least = np.maximum(0, np.maximum(d - far, near - d))
                at, shard = np.nonzero((least * factor <= bound[:, None] + SLACK * (d + far)) & (owner != own[:, None]))
                taken = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(owner[shard].astype(np.int64)), pa.array(sub[shard].astype(np.int64)), pa.array(bound[at])], names=["id", "x", "pivot", "sub", "bound"])

    return run


def _meet(index: DataFrame, visits: DataFrame, block_rows: int, run: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Search each shard for its visitors (id, x, pivot, sub, bound), about ``block_rows`` of them at a time."""
    visits = stored(visits, "vantage-visits")
    # As many rows as shards.
    counts = F.broadcast(visits.groupBy("pivot", "sub").agg(F.ceil(F.count("*") / block_rows).alias("blocks")))
    dealt = visits.join(counts, ["pivot", "sub"]).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")))
    left = index.join(counts, ["pivot", "sub"]).select("pivot", "sub", "index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    keys = ("pivot", "sub", "block")
    return left.groupBy(*keys).cogroup(dealt.select(*keys, "id", "x", "bound").groupBy(*keys)).applyInArrow(run, _FOUND)


def _nearest(points: DataFrame, is_query: Column, n: int, scale: float, k: int, factor: float, shard_rows: int, block_rows: int) -> DataFrame:
    """query_id, vec_id, score: candidates from all shards, of vectors of one dimension."""
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + (v / scale) * (v / scale)))
    largest = points.agg(F.max(norm)).first()[0]
    chosen = points.orderBy(F.xxhash64(F.lit("pivot"), "id", "x")).limit(min(PIVOTS, -(-n // shard_rows))).collect()
    pivots = lifted(np.array([r["x"] for r in chosen], float), scale, largest)
    placed = stored(points.mapInArrow(_placed(pivots, scale, largest), "id long, x array<double>, pivot long, d double"), "vantage-placed")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / (2 * shard_rows)).alias("subs"))
    dealt = placed.join(F.broadcast(sizes), "pivot").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")))  # as many rows as pivots
    index = stored(dealt.groupBy("pivot", "sub").applyInArrow(_shard(k, scale, largest), _SHARD), "vantage")
    shards = [r.asDict() for r in index.select("pivot", "sub", "near", "far").collect()]
    run = _searched(k, factor, scale)
    queries = placed.where(is_query).select("id", "x").mapInArrow(_placed(pivots, scale, None), "id long, x array<double>, pivot long, d double")
    queries = stored(queries.select("id", "x", F.col("pivot").alias("home")), "vantage-queries")
    at_home = queries.join(index.select(F.col("pivot").alias("home"), "sub"), "home").select("id", "x", F.col("home").alias("pivot"), "sub", F.lit(float("inf")).alias("bound"))
    first = stored(_meet(index, at_home, block_rows, run), "vantage-first")
    # A pivot's shards each have a k-th distance; the least of them bounds the query's.
    bounds = first.groupBy(F.col("query_id").alias("id")).agg(F.min("bound").alias("bound"))
    told = queries.join(bounds, "id", "left").select("id", "x", "home", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    others = told.mapInArrow(_visits(pivots, shards, scale, factor), "id long, x array<double>, pivot long, sub long, bound double")
    return first.unionByName(_meet(index, others, block_rows, run)).select("query_id", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.1, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query row among all other rows."""
    points = usable(vectors, id_col, vec_col)
    sizes = points.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).collect()
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for s in sizes:  # a table has few dimensions
        scale = s["largest"] if not 1e-100 < s["largest"] < 1e100 else 1.0
        found = found.unionByName(_nearest(points.where(F.size("x") == s["n"]), is_query, s["rows"], scale, k, factor, shard_rows, block_rows))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    """The query: rows whose vec_id is divisible by 20 against all rows, 20 neighbours each."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
