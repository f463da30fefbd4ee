"""Ridge regressions by folds and sets of features, all from one reading of the rows.

A design's columns are terms (words and pairs of words, 1 + ln of their count), a column a category and, for each
number, its value and whether it is missing. What a training fold changes are linear maps of these: a term's inverse
document frequency, a number's median where it is missing, its mean and deviation. So each fold's normal equations are
the sum of all folds' products less its own, mapped; products of columns are summed by the tasks' own cells and added
up. A fold is solved in a task of its own from a matrix of the columns' squared number, whatever the number of rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.numbering import group_folds
from quillspark.operators.stats import errors
from quillspark.sources.scratch import stored

_WORD = re.compile(r"\b\w\w+\b")
#: Cells that a task sums before it sends them.
_CELLS = 1 << 21


def terms_of(text: str | None) -> Counter:
    """Words of two characters or more, lower-cased, and pairs of neighbouring ones."""
    own = _WORD.findall((text or "").lower())
    return Counter(own) + Counter(f"{a} {b}" for a, b in zip(own, own[1:], strict=False))


@dataclass
class Design:
    """The columns after the constant: terms, (category column, level), numbers, their missing marks; the target is the last."""

    terms: dict[str, int]
    levels: dict[tuple[int, str], int]
    numbers: int
    frequency: np.ndarray  # of each term by fold
    rows: np.ndarray  # by fold
    medians: np.ndarray  # of each number over the rows outside each fold

    @property
    def width(self) -> int:
        return 2 + len(self.terms) + len(self.levels) + 2 * self.numbers

    def row(self, text: str | None, categories: Sequence[str | None], numbers: Sequence[float | None]) -> dict[int, float]:
        """A row's own columns, the constant among them."""
        out = {0: 1.0}
        for t, n in terms_of(text).items():
            if (k := self.terms.get(t)) is not None:
                out[1 + k] = 1 + math.log(n)
        at = 1 + len(self.terms)
        for c, x in enumerate(categories):
            if (k := self.levels.get((c, "" if x is None else x))) is not None:
                out[at + k] = 1.0
        at += len(self.levels)
        for j, x in enumerate(numbers):
            if x is None or not math.isfinite(x):
                out[at + self.numbers + j] = 1.0
            else:
                out[at + j] = float(x)
        return out

    def scale(self, fold: int) -> np.ndarray:
        """Inverse document frequencies outside a fold; 0 for terms of fewer than two documents there."""
        df, n = self.frequency.sum(axis=0) - self.frequency[fold], self.rows.sum() - self.rows[fold]
        return np.where(df >= 2, np.log((1 + n) / (1 + df)) + 1, 0.0)

    def solve(self, cross: np.ndarray, fold: int, text: bool, categories: Sequence[int], numbers: Sequence[int], alpha: float) -> np.ndarray:
        """Weights of the design's own columns (constant first), from the products of the rows outside a fold."""
        t, c, m = len(self.terms), len(self.levels), self.numbers
        scale = np.ones(self.width)
        scale[1 : 1 + t] = self.scale(fold)
        g = cross * scale[:, None] * scale
        at, gone = 1 + t + c, 1 + t + c + m
        for j in range(m):  # the value where there is one, else the median
            g[at + j] += self.medians[fold, j] * g[gone + j]
            g[:, at + j] += self.medians[fold, j] * g[:, gone + j]
        n = max(g[0, 0], 1.0)
        centred = g - np.outer(g[0], g[0]) / n
        deviation = np.sqrt(np.maximum(np.diag(centred)[at:gone] / n, 0))
        unit = np.ones(self.width)
        unit[at:gone] = 1 / np.where(deviation > 0, deviation, 1.0)
        own = [*(range(1, 1 + t) if text else []), *(1 + t + k for (col, _), k in self.levels.items() if col in categories), *(at + j for j in numbers)]
        own = np.array(sorted(own), int)
        x = centred[np.ix_(own, own)] * unit[own][:, None] * unit[own]
        w = np.linalg.solve(x + alpha * np.eye(len(own)), centred[own, -1] * unit[own]) * unit[own] if len(own) else np.zeros(0)
        out = np.zeros(self.width - 1)
        out[own] = w
        out[0] = g[0, -1] / n - (g[0, own] / n) @ w
        out[1 : 1 + t] *= scale[1 : 1 + t]
        out[gone : gone + m] = self.medians[fold] * out[at:gone]
        return out


def _design(rows: DataFrame, folds: int, text: bool, categories: int, numbers: int, terms: int) -> Design:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(uses: Counter, docs: Counter) -> pa.RecordBatch:
            keys = list(docs)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([uses[k] for k in keys], pa.int64()), pa.array([docs[k] for k in keys], pa.int64())], names=["fold", "term", "uses", "docs"])

        uses, docs = Counter(), Counter()
        for b in batches:
            for fold, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t, n in terms_of(own).items():
                    uses[fold, t] += n
                    docs[fold, t] += 1
            if len(docs) > 200_000:
                yield out(uses, docs)
                uses, docs = Counter(), Counter()
        yield out(uses, docs)

    by_fold = [F.sum(F.when(F.col("fold") == f, F.col("docs")).otherwise(0)).alias(f"f{f}") for f in range(folds)]
    told: list = []
    if text:
        found = rows.select("fold", "text").mapInArrow(counted, "fold int, term string, uses long, docs long").groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"), *by_fold)
        told = found.where("docs >= 2").orderBy(F.desc("uses"), "term").limit(terms).collect()
    levels = sorted({(c, r[0] or "") for c in range(categories) for r in rows.select(F.col("categories")[c]).distinct().collect()})
    medians = [F.percentile_approx(F.when(F.col("fold") != f, F.nullif(F.col("numbers")[j], F.lit(float("nan")))), 0.5, 10_000) for f in range(folds) for j in range(numbers)]
    figures = rows.agg(*[F.count(F.when(F.col("fold") == f, 1)) for f in range(folds)], *medians).first()
    frequency = np.array([[r[f"f{f}"] for r in told] for f in range(folds)], float).reshape(folds, len(told))
    return Design({r["term"]: k for k, r in enumerate(told)}, {x: k for k, x in enumerate(levels)}, numbers, frequency, np.array(figures[:folds]), np.array([x or 0.0 for x in figures[folds:]], float).reshape(folds, numbers))


def _products(rows: DataFrame, design: Design) -> DataFrame:
    """(fold, cell, value): sums of products of columns, the upper triangle row by row."""
    told = rows.sparkSession.sparkContext.broadcast(design)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = told.value, told.value.width
        keys, values, held = [], [], 0

        def out() -> pa.RecordBatch:
            cells, place = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([np.zeros(0), *values]), len(cells)).astype(float)
            fold, cell = np.divmod(cells, width * width)
            return pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(cell), pa.array(sums)], names=["fold", "cell", "value"])

        for b in batches:
            for fold, truth, text, categories, numbers in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                row = own.row(text, categories, numbers)
                row[width - 1] = truth
                at = np.array(sorted(row))
                x = np.array([row[k] for k in at])
                i, j = np.triu_indices(len(at))
                keys.append((fold * width + at[i]) * width + at[j])
                values.append(x[i] * x[j])
                held += len(i)
                if held > _CELLS:
                    yield out()
                    keys, values, held = [], [], 0
        yield out()

    return rows.select("fold", "truth", "text", "categories", "numbers").mapInArrow(run, "fold int, cell long, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value"))


def grouped_ridge(df: DataFrame, target: str, group: str, feature_sets: dict[str, dict], folds: int = 10, alpha: float = 10.0, terms: int = 5000) -> DataFrame:
    """(features, group, fold, truth, predicted): held-out predictions of each named set of features, groups never split.

    A set may name a ``text`` column (the same in all sets), ``categories`` and ``numbers``. Rows without a finite target
    are left out. Terms: those of two documents or more, the ``terms`` most used; in each fold those of two documents
    outside it. Null categories are a level; levels that a fold hasn't seen weigh nothing.
    """
    texts = {s["text"] for s in feature_sets.values() if s.get("text")}
    if len(texts) > 1:
        raise ValueError("one text column is expected")
    categories = sorted({c for s in feature_sets.values() for c in s.get("categories", [])})
    numbers = sorted({c for s in feature_sets.values() for c in s.get("numbers", [])})
    text = F.col(texts.pop()) if texts else F.lit(None)
    rows = df.select(
        F.col(group), F.col(target).cast("double").alias("truth"), text.cast("string").alias("text"), F.array(*[F.col(c).cast("string") for c in categories]).cast("array<string>").alias("categories"), F.array(*[F.col(c).cast("double") for c in numbers]).cast("array<double>").alias("numbers")
    ).where(F.abs("truth") < float("inf"))
    rows = stored(rows, "ridge-input")
    k = min(folds, rows.select(group).distinct().count())
    if k < 2:
        raise ValueError("two groups or more are expected")
    told = group_folds(rows, group, k)
    rows = stored(rows.join(told.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g"), "ridge-rows")
    design = _design(rows, k, any(s.get("text") for s in feature_sets.values()), len(categories), len(numbers), terms)
    products = stored(_products(rows, design), "ridge-products")
    width, names = design.width, list(feature_sets)
    sets = [(bool(s.get("text")), [categories.index(c) for c in s.get("categories", [])], [numbers.index(c) for c in s.get("numbers", [])]) for s in feature_sets.values()]
    shared = df.sparkSession.sparkContext.broadcast(design)

    def solved(key: tuple, whole: pa.Table, own: pa.Table) -> pa.Table:
        cross = np.zeros(width * width)
        cross[whole.column("cell").to_numpy()] = whole.column("value").to_numpy()
        np.subtract.at(cross, own.column("cell").to_numpy(), own.column("value").to_numpy())
        cross = cross.reshape(width, width)
        cross = cross + np.triu(cross, 1).T
        fold = key[0].as_py()
        weights = [shared.value.solve(cross, fold, *s, alpha) for s in sets]
        return pa.table({"fold": pa.array([fold] * len(sets), pa.int32()), "place": pa.array(range(len(sets)), pa.int32()), "weights": pa.array([w.tolist() for w in weights], pa.list_(pa.float64()))})

    # Every fold's task has the sums of all folds and its own; both have at most a row a pair of columns.
    whole = products.groupBy("cell").agg(F.sum("value").alias("value")).select(F.explode(F.array(*map(F.lit, range(k)))).alias("_fold"), "cell", "value")
    found = whole.groupBy("_fold").cogroup(products.groupBy("fold")).applyInArrow(solved, "fold int, place int, weights array<double>").collect()
    weights = np.zeros((k, len(sets), width - 1))
    for r in found:
        weights[r["fold"], r["place"]] = r["weights"]
    shared_weights = df.sparkSession.sparkContext.broadcast(weights)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value, shared_weights.value
        for b in batches:
            got = []
            for fold, text, categories, numbers in zip(*[b.column(k).to_pylist() for k in (1, 3, 4, 5)], strict=True):
                row = own.row(text, categories, numbers)
                got.append((w[fold][:, list(row)] @ np.array(list(row.values()))).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.list_(pa.float64()))], names=[group, "fold", "truth", "predicted"])

    kind = rows.schema[group].dataType.simpleString()
    predicted = rows.select(group, "fold", "truth", "text", "categories", "numbers").mapInArrow(predict, f"`{group}` {kind}, fold int, truth double, predicted array<double>")
    each = F.posexplode("predicted").alias("_place", "predicted")
    return predicted.select(group, "fold", "truth", each).select(F.array(*map(F.lit, names))[F.col("_place")].alias("features"), group, "fold", "truth", "predicted")


def ablation(df: DataFrame, target: str, group: str, feature_sets: dict[str, dict], folds: int = 10, alpha: float = 10.0, terms: int = 5000) -> DataFrame:
    """Held-out errors of a ridge for each named set of features, with the correlation of truth and prediction."""
    held = stored(grouped_ridge(df, target, group, feature_sets, folds, alpha, terms), "ridge-held")
    correlation = held.groupBy(F.col("features").alias("_f")).agg(F.corr("truth", "predicted").alias("correlation"))
    return errors(held, ["features"], "truth", "predicted").join(correlation, F.col("features") == F.col("_f")).drop("_f")
