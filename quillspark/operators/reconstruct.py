"""Weights of a linear scorer, found again from answers and scores: minimum-norm least squares on one-hot answers.

A row holds one chosen answer an item and the scores that a scorer gave. Its one-hot columns, the scores and a constant
make a Gram matrix that adds up over rows: tasks sum their own upper triangle, a grouped sum adds the tasks', and a
table of (columns + scores)² cells, whatever the number of rows, reaches the driver. Everything else follows from it:
means, the centred normal equations, their minimum-norm solution, and the fit with tied columns, for which the matrix
is multiplied by the tie's map instead of reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    """Sums over rows: ``cross`` of the columns 1, one-hot answers, scores; answers an item; names of the scores."""

    cross: np.ndarray
    answers: int
    targets: tuple[str, ...]

    @property
    def rows(self) -> int:
        return int(self.cross[0, 0])

    @property
    def items(self) -> int:
        return (len(self.cross) - 1 - len(self.targets)) // self.answers

    def centred(self, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Normal matrix and right side about the means, and the means."""
        k, y = self.items * self.answers, 1 + self.items * self.answers + self.targets.index(target)
        x, n = slice(1, k + 1), max(1, self.rows)
        sums, total = self.cross[0, x], self.cross[0, y]
        return self.cross[x, x] - np.outer(sums, sums) / n, self.cross[x, y] - sums * total / n, sums / n, total / n


@dataclass
class Scorer:
    """``weights`` [item, answer] and ``bias`` of a score; rank and number of the columns of its fit."""

    weights: np.ndarray
    bias: float
    rank: int
    columns: int

    def predicted(self, choices: Column) -> Column:
        """The score of a column of chosen answers; an answer outside the item's has no weight."""
        answers = self.weights.shape[1]
        told = F.array(*[F.lit(float(w)) for w in self.weights.ravel()])
        weight = F.transform(choices, lambda c, i: F.when((c >= 0) & (c < answers), F.get(told, i * answers + c)).otherwise(0.0))
        return F.aggregate(weight, F.lit(self.bias), lambda a, w: a + F.coalesce(w, F.lit(0.0)))


def gram(df: DataFrame, choices: str, targets: Sequence[str], items: int, answers: int) -> Gram:
    """The Gram matrix of all rows whose scores are all finite; ``choices`` is an array of ``items`` answers from 0.

    Answers that are null or not below ``answers``, and items beyond the array, set no column.
    """
    width = 1 + items * answers + len(targets)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            lists, n = b.column(0), b.num_rows
            z = np.zeros((n, width))
            z[:, 0] = 1
            flat = np.asarray(lists.flatten().fill_null(-1))
            sizes = np.diff(np.asarray(lists.offsets))
            sizes[np.asarray(lists.is_null())] = 0
            row = np.repeat(np.arange(n), sizes)
            item = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ok = (flat >= 0) & (flat < answers) & (item < items)
            z[row[ok], 1 + item[ok] * answers + flat[ok]] = 1
            for j in range(len(targets)):
                z[:, width - len(targets) + j] = np.asarray(b.column(1 + j))
            total += z.T @ z
        values = total[upper]
        cells = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values[cells])], names=["cell", "value"])

    finite = [F.col(t).isNotNull() & (F.abs(t) < float("inf")) for t in targets]
    rows = df.select(F.col(choices).cast("array<int>").alias("_c"), *[F.col(t).cast("double").alias(t) for t in targets])
    for f in finite:
        rows = rows.where(f)
    out = np.zeros((width, width))
    for cell, value in rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect():
        i, j = upper[0][cell], upper[1][cell]
        out[i, j] = out[j, i] = value
    return Gram(out, answers, tuple(targets))


def minimum_norm(sums: Gram, target: str, tie: np.ndarray | None = None, tolerance: float = 1e-10) -> Scorer:
    """The fit of least norm with an intercept. ``tie`` [one-hot column, column] makes each column of the fit a sum of one-hot ones.

    Directions whose share of the largest eigenvalue is below ``tolerance`` count as not determined.
    """
    normal, right, means, mean = sums.centred(target)
    tie = np.eye(len(normal)) if tie is None else tie
    values, vectors = np.linalg.eigh(tie.T @ normal @ tie)
    used = values > tolerance * max(values.max(initial=0.0), np.finfo(float).tiny)
    coefficients = vectors[:, used] @ ((vectors[:, used].T @ (tie.T @ right)) / values[used])
    weights = tie @ coefficients
    return Scorer(weights.reshape(sums.items, sums.answers), float(mean - means @ weights), int(used.sum()), tie.shape[1])


def ties(weights: np.ndarray, tolerance: float = 0.01) -> np.ndarray:
    """The reduced columns that free weights suggest.

    Items of four answers whose weights mirror each other within twice the tolerance, and that aren't all near zero, get
    two columns, each an answer less its mirror; of other items the answers with a weight of at least the tolerance stay.
    """
    items, answers = weights.shape
    out = []

    def column(*places: tuple[int, int, float]) -> None:
        c = np.zeros((items, answers))
        for item, answer, sign in places:
            c[item, answer] = sign
        out.append(c.ravel())

    for j, w in enumerate(weights):
        if answers == 4 and abs(w[0] + w[3] - w[1] - w[2]) < 2 * tolerance and abs(w).sum() > 4 * tolerance:
            column((j, 0, 1.0), (j, 3, -1.0))
            column((j, 1, 1.0), (j, 2, -1.0))
        else:
            for k in np.flatnonzero(abs(w) >= tolerance):
                column((j, k, 1.0))
    return np.array(out).T if out else np.zeros((weights.size, 0))


def reconstruct(df: DataFrame, choices: str, targets: Sequence[str], items: int, answers: int = 4, tolerance: float = 0.01) -> dict[str, tuple[Scorer, Scorer]]:
    """For each score the free fit and the one with tied columns, from one reading of the rows."""
    sums = gram(df, choices, targets, items, answers)
    out = {}
    for t in targets:
        free = minimum_norm(sums, t)
        out[t] = (free, minimum_norm(sums, t, ties(free.weights, tolerance)))
    return out


def as_table(df: DataFrame, found: dict[str, tuple[Scorer, Scorer]]) -> DataFrame:
    """(target, item, answer, weight, bias, columns, rank) of the tied fits: a row a weight."""
    rows = [(t, i, k, float(w), s.bias, s.columns, s.rank) for t, (_, s) in found.items() for i, own in enumerate(s.weights) for k, w in enumerate(own)]
    return df.sparkSession.createDataFrame(rows, "target string, item int, answer int, weight double, bias double, columns int, rank int")
