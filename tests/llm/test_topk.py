import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekeep.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, k, factor=64):
    """(query id, rank, vec_id, score), as often as they occur: each row is a query and a candidate."""
    kept = []
    for vec_id, vector in rows:
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        scaled = [math.floor(factor * Fraction(float(np.float32(x)))) for x in vector]
        kept.append((math.inf if vec_id is None else vec_id, scaled))
    out = Counter()
    for row, (query, q) in enumerate(kept):
        if query == math.inf or query % 20:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v)), i)
            for other, (i, v) in enumerate(kept)
            if other != row and len(v) == len(q)
        )
        for rank, (s, i) in enumerate(scored[:k]):
            out[query, rank + 1, None if i == math.inf else i, -s] += 1
    return out


def found(spark, rows, k, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    result = topk.top_k(df, F.col("id") % 20 == 0, k=k, **options)
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect())


def vectors(seed, n, dim, spread=1.0):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 64])
@pytest.mark.parametrize("blocks", [{}, {"candidates": 40, "queries": 4}])
def test_against_all_pairs(spark, dim, blocks):
    rows = vectors(dim, 230, dim)
    assert found(spark, rows, 20, **blocks) == expected(rows, 20)


def test_ties_and_one_common_vector(spark):
    rows = [(i, [0.5, -0.25, 1.0, 0.0]) for i in range(150)] + [(i + 150, v) for i, v in vectors(1, 60, 4)]
    assert found(spark, rows, 5, candidates=30, queries=3) == expected(rows, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]),
        (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (20, [0.0, 1.0, 0.0]), (40, []), (6, []),
        (7, [0.5, 0.5]), (7, [0.5, 0.5]), (60, [0.0, 0.0]), (80, [0.0, 1e12]), (8, [1000.0, -999.5]),
    ]
    assert found(spark, rows, 20) == expected(rows, 20)


def test_repeated_rows_and_ids_are_rows_of_their_own(spark):
    rows = vectors(4, 40, 3) + [(20, [1.0, 2.0, 3.0])] * 3 + [(20, [0.5, 0.5, 0.5]), (7, [1.0, 1.0, 1.0])]
    assert found(spark, rows, 6) == expected(rows, 6)
    assert found(spark, rows, 6, candidates=10, queries=2) == expected(rows, 6)
    assert found(spark, [(20, [1.0])] * 30, 20) == expected([(20, [1.0])] * 30, 20)


def test_fewer_candidates_than_asked_for_and_none(spark):
    assert found(spark, vectors(2, 4, 8), 20) == expected(vectors(2, 4, 8), 20)
    assert found(spark, [(20, [1.0])], 20) == Counter()
    assert found(spark, [(1, [1.0]), (2, [2.0])], 20) == Counter()
    assert found(spark, [], 20) == Counter()


def test_bounds_hold_and_get_finer():
    random_ = np.random.default_rng(3)
    a, b = random_.integers(-60, 60, (30, 64)).astype(float), random_.integers(-60, 60, (40, 64)).astype(float)
    exact = a @ b.T
    last = np.inf
    for segments in topk.SEGMENTS:
        bound = topk.segment_statistics(a, segments) @ topk.segment_statistics(b, segments).T
        assert (bound >= exact - 1e-6).all() and (bound <= last + 1e-6).all()
        last = bound


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**21 - i), float(i), 3.0]) for i in range(45)]
    assert found(spark, rows, 3) == expected(rows, 3)


@pytest.mark.parametrize("size", [2.0**21, 4e6, 2.0**27, 2.0**40, 1e30])
def test_long_vectors_of_large_components(spark, size):
    """Sums beyond 64 bits on the way, and scores that just fit because the large parts cancel."""
    pick = random.Random(int(size) % 97)
    rows = []
    for i in range(50):
        x = [float(np.float32(pick.gauss(0, 1))) for _ in range(766)]
        rows.append((100 * i + 1 if i else 20, [size, size if i else -size, *x]))
    assert found(spark, rows, 5, candidates=20) == expected(rows, 5)


def test_a_score_that_fits_no_long_is_an_error(spark):
    rows = [(20, [4e6] * 768), (33, [4e6] * 768), (34, [1.0] * 768)]
    with pytest.raises(Exception, match="score of 20 and 33 does not fit"):
        found(spark, rows, 1)
    low = [(20, [4e6] * 768), (33, [-4e6] * 768), (34, [1.0] * 768)]
    assert found(spark, low, 1) == expected(low, 1)
    with pytest.raises(Exception, match="score of 20 and 33 does not fit"):
        found(spark, low, 2)


def test_clashing_columns(spark):
    rows = vectors(9, 30, 4)
    df = spark.createDataFrame(
        [(*r, 1, 2, b"x", 3.0) for r in rows], f"{SCHEMA}, id int, row int, v binary, score double"
    )
    result = topk.top_k(df, F.col("id") % 20 == 0, k=4)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect())
    assert got == expected(rows, 4)
