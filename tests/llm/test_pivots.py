import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.vector_cases import noisy, order, score, table, whole
from tidejoin.llm import pivots as P
from tidejoin.llm import vectors as V

KEY = lambda r: tuple((x is None, x or 0) for x in r)


def brute(rows, every, k):
    known = [(i, v) for i, e, _ in rows if (v := whole(e)) is not None]
    out = []
    for at, (i, v) in enumerate(known):
        if i is not None and i % every == 0:
            found = sorted(((score(v, w), j) for other, (j, w) in enumerate(known) if other != at), key=order)[:k]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out, key=KEY)


@pytest.mark.parametrize(("seed", "k"), [(1, 5), (2, 1), (3, 40)])
def test_matches_brute_force(spark, monkeypatch, seed, k):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "CHUNK", 4)
    monkeypatch.setattr(P, "BATCH", 3)
    rows = noisy(seed, 60)
    found = P.top_k(table(spark, rows).repartition(3), F.col("id") % 5 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=KEY) == brute(rows, 5, k)


def test_clusters_are_left_out(spark):
    """Far clusters are ruled out by their ranges, and candidates by their bounds, with the same result."""
    rng = random.Random(5)
    middles = [[rng.choice((-8, 8)) for _ in range(8)] for _ in range(6)]
    rows = [(i, [m + rng.random() for m in middles[i % 6]], 0) for i in range(240)]
    found = P.top_k(table(spark, rows), F.col("id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=KEY) == brute(rows, 10, 5)

    vec = np.array([whole(e) for _, e, _ in rows], float)
    points = P.choose_pivots(vec, 6)
    far, near = V.nearest(vec, points)
    lists = {"list": np.arange(6, dtype=np.int32), "n": np.bincount(near, minlength=6), "square": np.array([(vec[near == c] ** 2).sum(1).max() for c in range(6)])}
    lists |= {name: np.array([f(far[near == c], axis=0) for c in range(6)]) for name, f in (("low", np.min), ("high", np.max))}
    for i in (0, 7, 100):
        outside = np.maximum(lists["low"] - far[i], far[i] - lists["high"]).max(1, initial=0)
        bounds = P.upper(outside, (vec[i] ** 2).sum(), lists["square"])
        best = [(vec[near == c] @ vec[i]).max() for c in range(6)]
        assert (bounds >= best).all() and (bounds < np.sort(vec @ vec[i])[-6]).any()


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    vec = np.floor(256 * rng.normal(size=(300, 12)))
    points = P.choose_pivots(vec, 9)
    assert len(points) == 9 and len(P.choose_pivots(np.ones((5, 3)), 4)) == 1 and len(P.choose_pivots(np.zeros((0, 3)), 4)) == 0
    far, _ = V.nearest(vec, points)
    bound = np.abs(far[:, None] - far[None]).max(2)
    square = (vec * vec).sum(1)
    assert (P.upper(bound, square[:, None], square[None]) >= vec @ vec.T).all()


def test_products_beyond_doubles():
    big = np.array([[2**60, 3], [-(2**40), 1]])
    assert V.products(big, np.array([1, 2**30])).tolist() == [2**60 + 3 * 2**30, 2**30 - 2**40]
    assert V.products(big, np.array([2**60, 0])).tolist() == [2**63 - 1, -(2**63)]


def test_empty_tables(spark):
    empty = table(spark, [])
    assert P.top_k(empty, F.col("id") % 5 == 0).count() == 0
    assert P.top_k(table(spark, [(0, None, 0), (5, [float("nan")], 0)]), F.col("id") % 5 == 0).count() == 0
    assert P.top_k(table(spark, [(0, [1.0], 0)]), F.col("id") % 5 == 0).count() == 0
    assert [tuple(r) for r in P.top_k(table(spark, [(0, [], 0), (1, [1.0], 0)]), F.col("id") % 5 == 0).collect()] == [(0, 1, 1, 0)]
    with pytest.raises(ValueError):
        P.top_k(empty, F.col("id") == 0, 0)
