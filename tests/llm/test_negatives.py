import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.vector_cases import noisy, order, score, table, whole
from tidejoin.llm import negatives as N
from tidejoin.llm import vectors as V

KEY = lambda r: tuple((x is None, x or 0) for x in r)
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, positives, negatives, low=30, high=90):
    known = [(i, v, label) for i, e, label in rows if (v := whole(e)) is not None and label is not None]
    out = []
    for at, (i, v, label) in enumerate(known):
        if i is None or i % every:
            continue
        scored = [(score(v, w), j, other) for n, (j, w, other) in enumerate(known) if n != at]
        for p, pid, _ in sorted((x for x in scored if x[2] == label), key=order)[:positives]:
            found = sorted((x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p), key=order)[:negatives]
            out += [(i, pid, rank, j, p, s) for rank, (s, j, _) in enumerate(found, 1)]
    return sorted(out, key=KEY)


@pytest.mark.parametrize(("seed", "positives", "negatives"), [(1, 5, 10), (2, 2, 1), (3, 30, 60)])
def test_matches_brute_force(spark, monkeypatch, seed, positives, negatives):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "CHUNK", 4)
    monkeypatch.setattr(N, "FIRST", 1)
    rows = noisy(seed, 60)
    found = N.hard_negatives(table(spark, rows).repartition(3), F.col("id") % 5 == 0, positives, negatives)
    assert found.columns == COLUMNS
    expected = brute(rows, 5, positives, negatives)
    assert len(expected) > 30 and sorted(map(tuple, found.collect()), key=KEY) == expected


def test_far_lists_and_windows(spark):
    rng = random.Random(5)
    middles = [[rng.choice((-8, 8)) for _ in range(8)] for _ in range(6)]
    rows = [(i, [m + rng.random() for m in middles[i % 6]], i % 4) for i in range(240)]
    found = N.hard_negatives(table(spark, rows), F.col("id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=KEY) == brute(rows, 10, 5, 10)


def test_bounds_hold_every_score(spark):
    rng = np.random.default_rng(4)
    vec = np.floor(256 * rng.normal(size=(300, 12))) + 400 * rng.integers(0, 3, 300)[:, None]
    points = N.fit_centroids(vec, 7)
    rows = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(vec)], "id long, vec array<long>")
    listed = N.in_lists(rows, points)
    lists = N.Lists(listed, points)
    of = {r.id: r["list"] for r in listed.collect()}
    place = {int(c): n for n, c in enumerate(lists.number)}
    at = np.array([place[of[i]] for i in range(300)])
    assert lists.n.sum() == 300
    skipped = 0
    for anchor in vec[:20]:
        least, most = lists.bounds(anchor)
        true = vec @ anchor
        assert (true >= least[at]).all() and (true <= most[at]).all()
        skipped += (most < np.sort(true)[-5]).sum()
    assert skipped > 0  # lists below the fifth score need no visit


def test_odd_and_empty_tables(spark):
    every = F.col("id") % 5 == 0
    assert N.hard_negatives(table(spark, []), every).count() == 0
    assert N.hard_negatives(table(spark, [(0, [1.0], None), (5, None, 1)]), every).count() == 0
    assert N.hard_negatives(table(spark, [(0, [1.0], 1)]), every).count() == 0
    # a score of 0 has the window 0 to 0, one below 0 none
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 2.0], 2), (4, [-0.5, 0.0], 2)]
    assert [tuple(r) for r in N.hard_negatives(table(spark, rows), every).collect()] == [(0, 1, 1, 3, 0, 0)]
    assert brute(rows, 5, 5, 10) == [(0, 1, 1, 3, 0, 0)]
