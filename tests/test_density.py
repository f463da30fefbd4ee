"""Density clusters against a tree built in plain Python, on points whose neighbours are all known."""

import itertools
import math

import numpy as np

from quillspark.operators import density


def plain(points, least, core, k, rungs):
    """The same ladder and tree over all pairs."""
    n = len(points)
    # Rungs are weights themselves, so distances must be rounded alike.
    d = [[math.sqrt(0.0 + (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])) for q in points] for p in points]
    near = {tuple(sorted((i, j))) for i in range(n) for j in sorted((x for x in range(n) if x != i), key=lambda x: (d[i][x], min(i, x), max(i, x)))[:k]}
    ends = {i: sorted(d[a][b] for a, b in near if i in (a, b)) for i in range(n)}
    w = {(a, b): max(d[a][b], *(ends[x][min(len(ends[x]), core) - 1] for x in (a, b))) for a, b in near}
    labels = []
    for most in rungs:
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for (a, b), v in w.items():
            if v <= most and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        labels.append([find(i) for i in range(n)])
    top, inverse = len(rungs) - 1, [1 / r for r in rungs] + [0.0]
    nodes = [{c: own.count(c) for c in set(own) if own.count(c) >= least} for own in labels]
    cluster, under, own = {}, {}, {}
    for level in range(top, -1, -1):
        up = {c: labels[level + 1][c] for c in nodes[level]} if level < top else {}
        for c, size in nodes[level].items():
            if level == top:
                cluster[level, c] = (level, c)
                under[level, c] = None
            elif sum(up[x] == up[c] for x in nodes[level]) == 1:
                cluster[level, c] = cluster[level + 1, up[c]]
            else:
                cluster[level, c] = (level, c)
                under[level, c] = cluster[level + 1, up[c]]
            own[cluster[level, c]] = own.get(cluster[level, c], 0) + size * (inverse[level] - inverse[level + 1])
    roots = [c for c in under if under[c] is None]
    whole = {c for c in roots if nodes[top][c[1]] == n}

    def best(c):
        below = [best(x) for x in under if under[x] == c]
        if own[c] >= sum(b[0] for b in below) and c not in whole:
            return own[c], [c]
        return sum(b[0] for b in below), list(itertools.chain(*(b[1] for b in below)))

    out = [-1] * n
    for r in roots:
        for level, c in best(r)[1]:
            for i in range(n):
                if labels[level][i] == c:
                    out[i] = c
    return out


def blobs(n, seed):
    rng = np.random.default_rng(seed)
    # Far from the origin, where near points fall to one side of a projection in one table or another.
    centres = np.array([[0, 0], [6, 0], [6.9, 1.2], [0, 7]]) + 30
    return np.vstack([centres[rng.integers(4, size=n)] + rng.normal(size=(n, 2)) * 0.4, rng.uniform(27, 40, size=(n // 8, 2))])


def frame(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, x array<double>").repartition(3)


def test_clusters_equal_a_plain_tree(spark):
    points, least = blobs(444, 1), 15
    df = frame(spark, points)
    # Wide buckets and a window over all rows: every pair is a candidate.
    edges = density.reachability(density.neighbours(df, "id", "x", 12, tables=4, window=500, bucket=1e6), 5)
    rungs = density.ladder(edges, 8)
    got = {r["id"]: r["cluster"] for r in density.density_clusters(df, "id", "x", least, 5, 12, 8, tables=4, window=500, bucket=1e6).collect()}
    want = plain([tuple(p) for p in points], least, 5, 12, rungs)
    assert [got[i] for i in range(len(points))] == want
    assert len(set(want) - {-1}) >= 3 and -1 in want


def test_bounded_candidates_find_most_neighbours(spark):
    points = blobs(400, 3)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    true = {tuple(sorted((i, int(j)))) for i in range(len(points)) for j in np.argsort(d[i], kind="stable")[:5]}
    found = {(r["a"], r["b"]) for r in density.neighbours(frame(spark, points), "id", "x", 12, tables=12, window=24, bucket=0.7).collect()}
    assert len(true & found) >= 0.9 * len(true)
    assert len(found) <= 12 * len(points)


def test_awkward_rows(spark):
    same = [(i, [1.0, 1.0]) for i in range(30)] + [(40 + i, [50.0, 50.0 + i]) for i in range(3)] + [(None, [0.0, 0.0]), (99, None), (3, [1.0, 1.0])]
    got = {r["id"]: r["cluster"] for r in density.density_clusters(spark.createDataFrame(same, "id long, x array<double>"), "id", "x", 10, 3, 8, 4, window=64).collect()}
    assert set(got) == {*range(30), 40, 41, 42} and all(got[i] == 0 for i in range(30))
    empty = density.density_clusters(spark.createDataFrame([], "id long, x array<double>"), "id", "x")
    assert empty.collect() == []
    assert [tuple(r) for r in density.density_clusters(spark.createDataFrame([(7, [1.0])], "id long, x array<double>"), "id", "x").collect()] == [(7, -1)]
