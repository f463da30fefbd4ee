"""Operator 11, vector code compression: product codes of integer vectors by Lloyd's rounds with Hamerly's bounds.

Components become integers, vectors equal consecutive parts, and each part position has a codebook whose entries start
as the parts of the smallest ids. A round assigns every part to its nearest entry and moves every entry to the floored
mean of its parts. Beside each part stand, from round to round, its entry, an upper bound of the distance to it and a
lower bound of the distance to any other. Both are widened by how far entries moved. Only where the upper bound, made
exact first, isn't strictly below the lower bound (or below half the way to the nearest other entry) are all entries
scanned in integers, so ties always go to the lower index. Bounds are rounded outwards, so no scan is left out wrongly.

A round is one pass over a stored table, whose tasks write the parts with their new bounds and, as rows of the same
table, their sums by entry; the sums of all tasks are one row an entry. The table before is deleted.

Defined cases: vectors that are null or hold a null, NaN or infinite component are left out; null ids come after all
others, rows of equal id stand in order of their vectors; with fewer rows than entries the codebook is that short; null
labels are one label; an empty table gives no rows; other columns are ignored, whatever their names. Vectors of unequal
length, or of a length that the parts don't divide, and components beyond 65536 (whose squares could leave 64 bits)
are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import delete, small, stored

_MOST = 1 << 16
#: Bounds are widened by this share, beyond what double rounding can take from them.
_SLACK = 1e-12


@dataclass
class Round:
    """What a pass needs: codebooks [part, entry, place], how far each entry moved since the pass before."""

    books: np.ndarray
    moved: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def apart(self) -> np.ndarray:
        """Half the distance from each entry to the nearest other one, rounded down."""
        d = self.books[:, :, None].astype(float) - self.books[:, None]
        d = (d * d).sum(axis=3)
        d[:, np.arange(d.shape[1]), np.arange(d.shape[1])] = np.inf
        return np.sqrt(d.min(axis=2)) / 2 * (1 - _SLACK)

    def after(self, sums: np.ndarray, counts: np.ndarray) -> "Round":
        """Entries at their parts' floored means; unused ones stay."""
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.books)
        d = (books - self.books).astype(float)
        return Round(books, np.sqrt((d * d).sum(axis=2)) * (1 + _SLACK))

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of integers its nearest entry (ties: the lower), that squared distance and the second one (or -1)."""
    d = np.empty((len(x), len(book)), np.int64)
    for k, entry in enumerate(book):
        y = x - entry
        d[:, k] = np.einsum("ij,ij->i", y, y)
    best = d.argmin(axis=1)
    first = d[np.arange(len(x)), best]
    if len(book) == 1:
        return best, first, np.full(len(x), -1)
    d[np.arange(len(x)), best] = np.iinfo(np.int64).max
    return best, first, d.min(axis=1)


def assign(x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, now: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries, upper and lower bounds of parts [row, part, place] after a pass, and how many parts were scanned in full."""
    rows, parts, _ = x.shape
    code, upper, lower = (np.zeros((rows, parts), np.int64), np.full((rows, parts), np.inf), np.full((rows, parts), -np.inf)) if state is None else (a.copy() for a in state)
    scanned, apart = 0, now.apart
    for p in range(parts):
        book, c, u, low = now.books[p], code[:, p], upper[:, p], lower[:, p]
        if state is not None and len(now.moved):
            moved = now.moved[p]
            order = np.argsort(moved)
            most = np.full(len(book), moved[order[-1]])
            if len(book) > 1:
                most[order[-1]] = moved[order[-2]]
            u[:] = (u + moved[c]) * (1 + _SLACK)
            low[:] = low - most[c] - np.abs(low) * _SLACK
        bound = np.maximum(low, apart[p][c])
        loose = np.flatnonzero(~(u < bound)) if state is not None else np.arange(rows)
        if state is not None and len(loose):
            y = x[loose, p] - book[c[loose]]
            u[loose] = np.sqrt(np.einsum("ij,ij->i", y, y).astype(float)) * (1 + _SLACK)
            loose = loose[~(u[loose] < bound[loose])]
        if len(loose):
            c[loose], first, second = nearest(x[loose, p], book)
            u[loose] = np.sqrt(first.astype(float)) * (1 + _SLACK)
            low[loose] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(float)) * (1 - _SLACK))
            scanned += len(loose)
    return code, upper, lower, scanned


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): vectors without null or non-finite components, as floored multiples."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("x"))
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("id", "label", F.transform("x", lambda x: F.when(F.abs(x) <= _MOST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component beyond {_MOST}"))).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if len(flat) != len(column) * width or any(n != width for n in np.diff(column.offsets.to_numpy())):
        raise ValueError(f"vectors of {width} components were expected")
    return flat.reshape(len(column), width)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()).cast(kind))


_STATE = "code array<tinyint>, upper array<double>, lower array<double>"
_SUMS = "part int, entry int, n long, sums array<long>, scanned long"


def step(table: DataFrame, now: Round, label_type: str, begun: bool) -> DataFrame:
    """One pass: rows (id, label, v, code, upper, lower), and after them each task's rows (part, entry, n, sums, scanned)."""
    told = table.sparkSession.sparkContext.broadcast(now)
    parts, entries, width = now.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = told.value
        sums, n, scanned = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
        kinds: pa.DataType | None = None
        for b in batches:
            kinds = b.schema.field(1).type
            if not b.num_rows:
                continue
            x = _matrix(b.column(2), parts * width, np.int64).reshape(-1, parts, width)
            state = tuple(_matrix(b.column(k), parts, t) for k, t in ((3, np.int64), (4, float), (5, float))) if begun else None
            code, upper, lower, more = assign(x, state, now)
            scanned += more
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(code, pa.int8()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), *none], names=names)
        if kinds is not None:
            m = parts * entries
            p, e = np.divmod(np.arange(m), entries)
            counted = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n.ravel()), _lists(sums.reshape(m, width), pa.int64()), pa.array([scanned, *[0] * (m - 1)])]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, t) for t in (pa.int64(), kinds, pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.float64()), pa.list_(pa.float64()))] + counted, names=names)

    names = ["id", "label", "v", "code", "upper", "lower", "part", "entry", "n", "sums", "scanned"]
    columns = ["id", "label", "v", *(["code", "upper", "lower"] if begun else [])]
    return table.where("v is not null").select(*columns).mapInArrow(run, f"id long, label {label_type}, v array<int>, {_STATE}, {_SUMS}")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Round, list[int]]:
    """(id, label, codes, error) of all kept vectors, the final codebooks, and how many parts each pass scanned in full."""
    if not 1 <= entries <= 128 or parts < 1 or rounds < 0:
        raise ValueError("entries: 1 to 128; parts: 1 or more; rounds: 0 or more")
    label_type = df.schema[label_col].dataType.simpleString()
    table = stored(integers(df, id_col, vector_col, label_col, scale), "codes")
    first = [r["v"] for r in table.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return table.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), Round(np.zeros((parts, 0, 0), np.int64)), []
    if len({len(v) for v in first}) > 1 or not first[0] or len(first[0]) % parts:
        raise ValueError(f"vectors of one length that {parts} parts divide are expected")
    width = len(first[0]) // parts
    now = Round(np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2))
    scans = []
    for k in range(rounds):
        before, table = table, stored(step(table, now, label_type, k > 0), "codes")
        delete(before)
        sums, n = np.zeros_like(now.books), np.zeros(now.books.shape[:2], np.int64)
        # A row a part position and entry.
        by_place = table.where("part is not null").groupBy("part", "entry").agg(F.sum("n"), F.sum("scanned"), *[F.sum(F.col("sums")[j]) for j in range(width)])
        scans.append(0)
        for r in by_place.collect():
            n[r[0], r[1]], sums[r[0], r[1]] = r[2], r[4:]
            scans[-1] += r[3]
        now = now.after(sums, n)
    final = table.sparkSession.sparkContext.broadcast(now)
    begun = rounds > 0

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = final.value.books
        for b in batches:
            x = _matrix(b.column(2), parts * width, np.int64).reshape(-1, parts, width)
            state = tuple(_matrix(b.column(k), parts, t) for k, t in ((3, np.int64), (4, float), (5, float))) if begun else None
            code = assign(x, state, final.value)[0]
            y = x - books[np.arange(parts), code]
            error = np.einsum("ijk,ijk->i", y, y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(code, pa.int32()), pa.array(error)], names=["id", "label", "codes", "error"])

    columns = ["id", "label", "v", *(["code", "upper", "lower"] if begun else [])]
    out = table.where("v is not null").select(*columns).mapInArrow(coded, f"id long, label {label_type}, codes array<int>, error long")
    return out, now, scans


def op11_codes(spark, sf_dir: str) -> DataFrame:
    """The query: codes of all embeddings, errors by vector and by label."""
    rows, books, _ = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = stored(rows, "codes-out")
    by_label = stored(rows.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "codes-labels")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = rows.join(small(by_label), F.col("label").eqNullSafe(F.col("own")))
    return joined.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round as two tables: assigned parts, then entries."""
    out = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"piece AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM piece WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        out.append(f"near{k} AS MATERIALIZED (SELECT r, p, min(d)::BIGINT AS d, arg_min(e, d * 1000 + e) AS e FROM (SELECT r, p, e, {distance} AS d FROM piece JOIN book{k} USING (p)) GROUP BY r, p)")
        if k < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            out.append(f"mean{k} AS MATERIALIZED (SELECT p, e, list({mean} ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM near{k} JOIN piece USING (r, p)) GROUP BY ALL) GROUP BY ALL)")
            out.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))")
    out.append(f"coded AS MATERIALIZED (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r)")
    out.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})")
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), digest"


ORACLE_SQL = _sql()
