"""Vector codes against plain Lloyd rounds and against SQL."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, parts, entries, rounds):
    """Full scans in every round; first rows come first."""
    x = np.floor(4096 * np.array(vectors, float)).astype(np.int64).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if k == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                if len(own := x[code[:, p] == e, p]):
                    books[p, e] = own.sum(axis=0) // len(own)
    return code, d.min(axis=2).sum(axis=1), books


def clustered(n, width, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return (centres[rng.integers(12, size=n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


@pytest.mark.parametrize(("parts", "entries", "rounds", "kind"), [(4, 16, 6, "clusters"), (2, 5, 3, "noise"), (8, 16, 6, "ties"), (1, 1, 2, "noise"), (2, 7, 0, "noise")])
def test_codes_are_those_of_full_scans(spark, parts, entries, rounds, kind):
    rng = np.random.default_rng(3)
    x = {"clusters": clustered(400, 8, 1), "noise": rng.normal(size=(300, 8)).astype(np.float32), "ties": (rng.integers(0, 3, size=(300, 8)) / 4096).astype(np.float32)}[kind]
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], SCHEMA).repartition(5)
    rows, now, scans = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    got = {r["id"]: (r["codes"], r["error"]) for r in rows.collect()}
    code, error, books = plain(x, parts, entries, rounds)
    assert got == {i: (code[i].tolist(), int(error[i])) for i in range(len(x))}
    assert now.books.tolist() == books.tolist()
    assert len(scans) == rounds


def test_bounds_save_scans(spark):
    x = clustered(3000, 16, 5)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    scans = codes.compress(df, parts=2, entries=16, rounds=6)[2]
    assert scans[0] == 6000 and scans[-1] < 3000


def test_bounds_hold_at_every_step():
    rng = np.random.default_rng(0)
    x = rng.integers(-500, 500, size=(400, 2, 4))
    now, state = codes.Round(x[:9].transpose(1, 0, 2).copy()), None
    for _ in range(8):
        code, upper, lower, _ = codes.assign(x, state, now)
        d = np.sqrt(((x[:, :, None] - now.books[None]) ** 2).sum(axis=3))
        own = np.take_along_axis(d, code[:, :, None], 2)[:, :, 0]
        assert (code == d.argmin(axis=2)).all() and (upper >= own).all()
        np.put_along_axis(d, code[:, :, None], np.inf, 2)
        assert (lower <= d.min(axis=2)).all()
        state = (code, upper, lower)
        sums, n = np.zeros_like(now.books), np.zeros(now.books.shape[:2], np.int64)
        for p in range(2):
            np.add.at(sums[p], code[:, p], x[:, p])
            n[p] = np.bincount(code[:, p], minlength=9)
        now = now.after(sums, n)


def test_awkward_rows(spark):
    good = [(i, [i / 7, -i / 3, 1.0, 0.5], i % 2 or None) for i in range(6)]
    bad = [(20, None, 1), (21, [1.0, None, 0.0, 0.0], 1), (22, [float("nan"), 0.0, 0.0, 0.0], 1), (23, [float("inf"), 0.0, 0.0, 0.0], 2)]
    twice = [(3, good[3][1], 1), (None, [0.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame([*good, *bad, *twice], SCHEMA).withColumns({"code": F.lit("x"), "Upper": F.lit(1)})
    rows = codes.compress(df, parts=2, entries=16, rounds=3)[0].collect()
    assert sorted((r["id"] is None, r["id"]) for r in rows) == [(False, i) for i in (0, 1, 2, 3, 3, 4, 5)] + [(True, None)]
    # As many entries as rows; the second parts are all alike, so ties go to the lowest.
    assert all(r["error"] == 0 for r in rows)
    assert [r["codes"] for r in rows if r["id"] == 3] == [[3, 0], [3, 0]]
    empty = codes.compress(spark.createDataFrame([], SCHEMA))
    assert empty[0].collect() == [] and empty[1].sha256 == hashlib.sha256(b"").hexdigest()


def test_awkward_lengths(spark):
    with pytest.raises(ValueError, match="parts"):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], SCHEMA), parts=2)
    with pytest.raises(Exception, match="expected"):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0, 3.0, 4.0], 0)], SCHEMA), parts=2)[0].collect()

