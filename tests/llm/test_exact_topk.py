"""Exact top-k search against brute force in whole numbers."""

import math
import random

import pytest

from bidflow.llm import exact_topk
from bidflow.llm.queries import oracle_sql
from tests.compare import SF_DIR, database, rows


def plain(vectors, k=5, every=50):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append(v)
    whole = {i: [math.floor(256 * x) for x in min(vs)] for i, vs in whole.items()}
    out = []
    for i, q in whole.items():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole.items() if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def search(spark, vectors, **more):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "'x' as lst", "1 as part", "2 as stripe", "'q' as query", "0 as rank", "'s' as score")
    return sorted(tuple(r) for r in exact_topk.search(table, **more).collect())


def some(seed, n, dim, spread=1.0, shift=0.0):
    rng = random.Random(seed)
    return [[rng.gauss(shift, spread) for _ in range(dim)] for _ in range(n)]


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROWS", 40)
    monkeypatch.setattr(exact_topk, "QUERIES", 3)
    vectors = list(enumerate([*some(1, 260, 7, 0.2), *some(2, 60, 3), *some(3, 4, 1), [], []]))
    copies = [(1000 + k, vectors[50][1]) for k in range(60)]  # ties
    odd = [(2000, None), (2001, [0.1] * 6 + [None]), (2002, [math.nan] * 7), (2050, [math.inf] + [0.0] * 6), (2100, [0.0] * 7), (None, [1.0] * 7), (-50, [-0.5] * 7), vectors[3], vectors[3], (2150, [0.5, 0.5])]
    assert search(spark, vectors + copies + odd) == plain(vectors + copies + odd)


@pytest.mark.parametrize("shift", [0.0, 0.6, -0.6])
def test_skewed_vectors(spark, shift):
    vectors = list(enumerate(some(5, 900, 16, 0.3, shift)))
    assert search(spark, vectors, k=7, every=30) == plain(vectors, 7, 30)


def test_large_components(spark):
    vectors = list(enumerate(some(6, 40, 4)))
    vectors += [(100 + k, [x * 1e6 for x in v]) for k, v in enumerate(some(7, 60, 4))]  # beyond what a double adds up exactly
    assert search(spark, vectors, every=20) == plain(vectors, every=20)
    huge = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [1.0, 1.0])]
    assert [(r[2], r[3]) for r in search(spark, huge)] == [(3, (1 << 61) + 65536), (1, 1 << 61), (2, 5 * 65536 - (1 << 61))]


def test_no_limit_without_enough_candidates(spark):
    assert search(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (50, [0.0, 1.0])]) == plain([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (50, [0.0, 1.0])])
    assert search(spark, [(0, [1.0])]) == search(spark, [(1, [1.0]), (2, [1.0])]) == search(spark, []) == []


def test_query_equals_sql(spark):
    assert rows(exact_topk.op12_exact_topk(spark, SF_DIR).toPandas()) == rows(database().sql(oracle_sql()["op12_exact_topk"]).df())
