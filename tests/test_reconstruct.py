"""Reconstructed scorers against least squares over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import reconstruct


def one_hot(choices, items, answers=4):
    x = np.zeros((len(choices), items * answers))
    for i, row in enumerate(choices):
        for j, c in enumerate(row[:items]):
            if c is not None and 0 <= c < answers:
                x[i, j * answers + c] = 1
    return x


def plain(x, y):
    coef, _, rank, _ = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)
    return coef, y.mean() - x.mean(0) @ coef, rank


def frame(spark, choices, *scores):
    return spark.createDataFrame([(c, *map(float, s)) for c, *s in zip(choices, *scores, strict=True)], "c array<int>, " + ", ".join(f"y{k} double" for k in range(len(scores)))).repartition(5)


@pytest.mark.parametrize("rows", [300, 12])
def test_free_fit_is_least_squares_of_least_norm(spark, rows):
    """With few rows too, where most weights aren't determined."""
    rng = np.random.default_rng(rows)
    choices = rng.integers(-1, 5, size=(rows, 6)).tolist()
    choices[3] = [None, 2, 1]
    y = rng.normal(size=(2, rows))
    df = frame(spark, choices, *y)
    sums = reconstruct.gram(df.unionByName(spark.createDataFrame([([1, 1], None, 1.0), ([1], float("nan"), 2.0)], df.schema)), "c", ["y0", "y1"], 6, 4)
    x = one_hot(choices, 6)
    assert sums.rows == rows
    for k in range(2):
        got, (coef, bias, rank) = reconstruct.minimum_norm(sums, f"y{k}"), plain(x, y[k])
        assert np.allclose(got.weights.ravel(), coef, atol=1e-8) and abs(got.bias - bias) < 1e-8 and got.rank == rank
        rows_ = df.select("c", got.predicted(F.col("c"))).collect()
        assert np.allclose([r[1] for r in rows_], one_hot([r[0] for r in rows_], 6) @ coef + bias, atol=1e-8)


def test_tied_fit_is_least_squares_on_tied_columns(spark):
    rng = np.random.default_rng(4)
    choices = rng.integers(0, 4, size=(400, 5)).tolist()
    w = np.array([[-3.0, -1, 1, 3], [0, 0, 0, 0], [1, 0, 0, 2], [2, 2, -2, -2], [0, 0, 0, 1]])
    x = one_hot(choices, 5)
    y = x @ w.ravel() + 0.3 + 1e-4 * rng.normal(size=400)
    free, tied = reconstruct.reconstruct(frame(spark, choices, y), "c", ["y0"], 5)["y0"]
    columns = []
    for j, own in enumerate(plain(x, y)[0].reshape(5, 4)):
        if abs(own[3] + own[0] - own[2] - own[1]) < 0.02 and abs(own).sum() > 0.04:
            columns += [x[:, 4 * j] - x[:, 4 * j + 3], x[:, 4 * j + 1] - x[:, 4 * j + 2]]
        else:
            columns += [x[:, 4 * j + k] for k in range(4) if abs(own[k]) >= 0.01]
    coef, bias, _ = plain(np.column_stack(columns), y)
    assert tied.columns == len(columns) < 20 and free.columns == 20
    assert np.allclose(x @ tied.weights.ravel() + tied.bias, np.column_stack(columns) @ coef + bias, atol=1e-7)
    assert np.allclose(tied.weights[0], w[0], atol=1e-3) and np.allclose(tied.weights[3], w[3], atol=1e-3) and (tied.weights[1] == 0).all()


def test_one_reading_of_the_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = frame(spark, [[k % 4, k % 3] for k in range(50)], range(50), range(50))
    reconstruct.reconstruct(df.mapInArrow(counted, df.schema), "c", ["y0", "y1"], 2)
    assert seen.value == 50


def test_no_rows(spark):
    df = spark.createDataFrame([], "c array<int>, y0 double")
    free, tied = reconstruct.reconstruct(df, "c", ["y0"], 3)["y0"]
    assert free.rank == 0 and not free.weights.any() and tied.columns == 0 and tied.weights.shape == (3, 4)
