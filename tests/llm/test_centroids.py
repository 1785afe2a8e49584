import hashlib
import random

import numpy as np
import pytest

from tablekeep.llm.centroids import candidates, cluster, hilbert, nearest

SCHEMA = "vec_id long, embedding array<double>"


def expected(rows, clusters, rounds, dim):
    kept = []
    for i, x in rows:
        if x is None or len(x) != dim or any(v is None or not np.isfinite(v) for v in x):
            continue
        kept.append((i, [int(np.floor(256 * v)) for v in x]))
    def digest(i):
        return hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()

    packed = lambda v: np.array(v, "<i8").tobytes()
    first = sorted(kept, key=lambda r: (digest(r[0]), packed(r[1])))[:clusters]
    centroids = [list(v) for _, v in first]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        for k, own in groups.items():
            centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *assign(v)) for i, v in kept]
    sums = {}
    for _, d, k in found:
        sums[k] = sums.get(k, 0) + d
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, sums[k], sum(sums.values()), shown[k]) for i, d, k in found), key=repr)


def found(spark, rows, clusters=5, rounds=3, dim=4):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster(frame, clusters, rounds, dim).collect()), key=repr)


def vectors(seed, count, dim=4, scale=1.0):
    pick = random.Random(seed)
    return [(i, [pick.gauss(pick.choice([-2, 0, 3]), 0.4) * scale for _ in range(dim)]) for i in range(count)]


@pytest.mark.parametrize("dim", [1, 4, 70])
def test_rounds_by_brute_force(spark, dim):
    rows = vectors(dim, 300, dim)
    assert found(spark, rows, dim=dim) == expected(rows, 5, 3, dim)


def test_awkward_vectors(spark):
    rows = vectors(2, 40)
    rows += [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 0.0, 0.0])]
    rows += [(54, [float("nan")] * 4), (55, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [rows[0], (3, [9.0, 9.0, 9.0, 9.0])]  # a repeated row, and an id a second time
    rows += [(60 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(100)]  # a third are the same vector
    assert found(spark, rows) == expected(rows, 5, 3, 4)


def test_large_components_are_exact(spark):
    near = [(i, [2.0**45 + i * 1.0, 0.0, -(2.0**45), i * 3.0]) for i in range(30)]
    assert found(spark, near) == expected(near, 5, 3, 4)
    with pytest.raises(Exception, match="does not fit"):
        found(spark, [(1, [2.0**45] * 4), (2, [-(2.0**45)] * 4), (3, [0.0] * 4)], clusters=1)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e300] * 4)])


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(4, 3)
    assert found(spark, rows) == expected(rows, 5, 3, 4)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[4, 0], [0, 0], [0, 0], [8, 0]])
    number, distance = nearest(np.array([[2, 0], [0, 0], [6, 0]]), centroids)
    assert number.tolist() == [0, 1, 0] and distance.tolist() == [4, 0, 4]


def test_candidates_hold_every_nearest_centroid():
    pick = np.random.default_rng(5)
    for _ in range(200):
        dim = int(pick.integers(1, 8))
        centroids = pick.integers(-20, 20, (12, dim))
        x = pick.integers(-4, 4, (20, dim)) + pick.integers(-20, 20, dim)
        apart = ((x[:, None] - centroids) ** 2).sum(axis=2)
        ties = np.unique(np.nonzero(apart == apart.min(axis=1)[:, None])[1])
        assert set(ties) <= set(candidates(x.min(axis=0), x.max(axis=0), centroids))


def test_the_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hilbert(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_clashing_columns(spark):
    rows = vectors(6, 30)
    frame = spark.createDataFrame(
        [(*r, 1, "a", 2.0) for r in rows], f"{SCHEMA}, id int, v string, distance double"
    )
    got = sorted((tuple(r) for r in cluster(frame, 5, 3, 4).collect()), key=repr)
    assert got == expected(rows, 5, 3, 4)
